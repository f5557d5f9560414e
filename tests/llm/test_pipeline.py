import os
import random

import duckdb
import pytest

import corpus_pipeline
from textweave.llm import edits, queries

SF = os.environ.get("TEST_LLM_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        n.append(docs.count())
        if k < 4:
            assert docs.columns == columns
    assert n[1] < n[0] and n[2] == n[1] and n[3] < n[2] and n[4] >= n[3]
    g = docs.toPandas().sort_values(["sequence_id", "offset"])
    assert (g.groupby("sequence_id").length.cumsum() - g.length == g.offset).all()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, SF)
    order = sorted(got.columns)
    assert sorted(want.columns) == order
    cols = list(want.columns)
    assert sorted(tuple(r[c] for c in order) for r in got.collect()) == sorted(tuple(r[cols.index(c)] for c in order) for r in want.fetchall())


def test_line_stage_drops_lines_with_edits_in_most_words(spark):
    """Lines at the similarity by the exact distance alone: an alignment on words would leave them all in."""
    draw, lines = random.Random(3), []
    text = lambda n: "".join(draw.choice("abcdefghijklmnop") for _ in range(n))
    for _ in range(12):
        kept, short = [text(8) for _ in range(30)], [text(2) for _ in range(95)]
        a = " ".join(kept + short)
        b = " ".join(kept + [x[0] + "z" for x in short])
        most = edits.limit(a, b, 0.8)
        assert edits.anchored(a, b, most) > 1.25 * most and edits.edit_distance(a, b) <= most
        lines += [a, b]
    docs = spark.createDataFrame([(k, x, 0) for k, x in enumerate(lines)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert all(got[k] for k in range(0, 24, 2))
    assert sum(not got[k] for k in range(1, 24, 2)) >= 6  # the rest is beyond the radius of the candidate search
