import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from textweave.llm import packing as pk
from textweave.llm.token_counts import default_path


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    hist = np.zeros(129, dtype=np.int64)
    hist[1:] = rng.poisson(rng.uniform(0, 30, 128) * (rng.random(128) < 0.7))
    used = np.zeros_like(hist)
    chosen = pk.plan(hist, 128)
    for pattern, times in chosen:
        assert sum(pattern) <= 128 and times > 0
        for v in pattern:
            used[v] += times
    assert (used == hist).all()
    n, tokens = sum(k for _, k in chosen), int((hist * np.arange(129)).sum())
    assert n <= sum(k for _, k in pk.best_fit(hist, 128))
    assert n <= 1.02 * max(-(-tokens // 128), int(hist[65:].sum())) + 2


def test_patterns_are_exact():
    p = pk.patterns(30)
    assert (p.sum(1) == 30).all() and len({tuple(x) for x in p}) == len(p) and (np.diff(p, axis=1) <= 0).all()


def test_empty():
    assert pk.plan(np.zeros(17, dtype=np.int64), 16) == []


def test_pack(spark):
    rows = [(k, f"word {k} " * (k % 60 + 1), "x") for k in range(300)] + [(300, None, "x"), (301, "", "x"), (302, "many words here " * 3000, "x"), (None, "no id", "x"), (5, "word 5 " * 6, "x"), (5, "word 5 " * 6, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    got = pk.pack(docs).toPandas()
    t = Tokenizer.from_file(default_path())
    want = []
    for i, text, _ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(-1 if i is None else i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got["doc_id"] = got["doc_id"].fillna(-1).astype(int)
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    g = got.sort_values(["sequence_id", "offset"])
    assert (g.groupby("sequence_id").length.cumsum() - g.length == g.offset).all() and g.groupby("sequence_id").length.sum().max() <= 1024
    assert pk.pack(docs.where("false")).count() == 0
