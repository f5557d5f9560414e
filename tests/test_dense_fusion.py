import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest

from textweave.operators import dense, fusion


def test_http_embedder():
    answers = [{"data": [{"index": 1, "embedding": [0, 2]}, {"index": 0, "embedding": [1, 0]}]}, {"oops": 1}, {"data": []}]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            assert body["input"] == ["a", "b"] and body["model"] == "m"
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(answers.pop(0)).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    e = dense.HttpEmbedder(f"http://127.0.0.1:{server.server_port}/", "m", 2)
    assert e.embed(["a", "b"]).tolist() == [[1, 0], [0, 2]]
    for _ in range(2):
        with pytest.raises(dense.EmbeddingError):
            e.embed(["a", "b"])
    server.shutdown()


def test_embed(spark):
    class Bad:  # local, so that workers get it by value
        dims = 3

        def embed(self, texts):
            raise dense.EmbeddingError("down")

    rows = spark.createDataFrame([(1, "fox hound"), (2, ""), (3, None)], "id long, text string")
    out = {r.id: r.vector for r in dense.embed(rows, "text", dense.HashingEmbedder(16)).collect()}
    assert np.isclose(np.linalg.norm(out[1]), 1) and not any(out[2]) and not any(out[3])
    assert all(r.vector is None for r in dense.embed(rows, "text", Bad()).collect())
    assert dense.prefixes("nomic-x") == ("search_document: ", "search_query: ") and dense.prefixes("m", "d", "q") == ("d", "q")


def test_knn_and_rollup(spark):
    rng = np.random.default_rng(3)
    v = dense.normalise(rng.normal(size=(60, 8)))
    chunks = spark.createDataFrame([(k // 3, k % 3, x.tolist()) for k, x in enumerate(v)], "id long, chunk_ix long, vector array<float>")
    q = dense.normalise(rng.normal(size=(4, 8)))
    near = dense.knn(chunks, q[0].tolist(), 10).select("id", "chunk_ix", "distance").collect()
    d = 1 - v.astype(float) @ q.T.astype(float)
    assert [(r.id * 3 + r.chunk_ix) for r in near] == np.argsort(d[:, 0])[:10].tolist()
    many = dense.knn_batch(chunks, q, [10, 11, 12, 13], 7).collect()
    for k in range(4):
        assert {r.id * 3 + r.chunk_ix for r in many if r.query_id == 10 + k} == set(np.argsort(d[:, k])[:7].tolist())
    top = dense.rollup(dense.knn(chunks, q[0].tolist(), 10).select("id", "chunk_ix", "distance"), 3).orderBy("rank").collect()
    assert len(top) == 3 and len({r.id for r in top}) == 3 and top[0].distance == near[0].distance


def test_rrf(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, rank long")
    b = spark.createDataFrame([("c", 1), ("a", 2)], "id string, rank long")
    s = {r.id: r.score for r in fusion.rrf(a, b).collect()}
    assert s["a"] == pytest.approx(1 / 61 + 1 / 62) and s["a"] > s["b"] and s["c"] > s["b"]
    docs = spark.createDataFrame([("a", "T", "md")], "id string, title string, kind string")
    r = fusion.hybrid(a, b, docs, 2).orderBy("rank").collect()
    assert [(x.id, x.title) for x in r] == [("a", "T"), ("c", "")] and fusion.pool_size(8) == 32 and fusion.over_fetch(30) == 240


def test_batch_in_blocks_of_queries(monkeypatch):
    """A task holds few products at a time, whatever the number of queries; results and ties are the same."""
    rng = np.random.default_rng(3)
    rows = np.repeat(dense.normalise(rng.normal(size=(60, 8))), 2, axis=0)
    whole = [np.concatenate(x) for x in zip(*dense.nearest(rows, rows[:31], 5))]
    monkeypatch.setattr(dense, "CELLS", 240)
    blocks = list(dense.nearest(rows, rows[:31], 5))
    assert len(blocks) == 16 and all(len(set(c.tolist())) <= 2 for _, c, _ in blocks)
    found = [{(int(r), int(c), round(float(d), 6)) for r, c, d in zip(*x)} for x in (whole, [np.concatenate(x) for x in zip(*blocks)])]
    assert found[0] == found[1] and len(found[0]) >= 31 * 5
