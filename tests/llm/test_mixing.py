from collections import Counter

import duckdb
import pytest

from textweave.llm import mixing

ROWS = [(k, "w " * (k % 7 + 1), ("big", "big", "big", "mid", "small")[k % 5] if k < 400 else "tiny", "x") for k in range(410)]
ROWS += [(900, None, "mid", "x"), (901, "", None, "x"), (None, "no id", "mid", "x"), (902, "twice", "mid", "x"), (902, "twice", "mid", "x"), (903, "long " * 100_000, None, "x")]
SCHEMA = "doc_id long, text string, source string, epoch string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_order_and_mix_agree(docs):
    order = mixing.order(docs).collect()
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(r.doc_id for r in order)
    once = Counter(r.doc_id for r in order)
    assert all(once[i] >= n for i, n in Counter(r[0] for r in ROWS).items())
    for r in mixing.plan(docs).collect():
        assert r.tokens <= r.quota <= 2 * r.tokens and r.quota == r.passes * r.tokens + r.rest
        got = sum(x.n_tokens for x in order if (x.source if x.source is not None else "\x00none") == r.s)
        assert r.passes * r.tokens <= got <= r.quota


def test_budget_and_entropy(docs):
    plan = {r.s: r for r in mixing.plan(docs, budget=50, target_entropy=0.0).collect()}
    assert sum(r.weight for r in plan.values()) == pytest.approx(1)
    assert {s: r.weight for s, r in plan.items()} == pytest.approx({s: r.share for s, r in plan.items()}, abs=1e-4)  # exponent 1
    flat = [r.weight for r in mixing.plan(docs, target_entropy=99.0, max_epochs=1e9).collect()]
    assert max(flat) - min(flat) < 1e-9  # exponent 0
    few = mixing.order(docs, budget=500).collect()  # quotas that hold the longest of most sources' texts
    assert few and sum(r.n_tokens for r in few) <= 500


def test_edges(spark, docs):
    assert mixing.mix(docs.where("false")).count() == 0 and mixing.order(docs.where("false")).count() == 0
    one = docs.where("source = 'tiny'")
    assert mixing.mix(one).count() == one.count()


def test_sql(spark, tmp_path):
    rows = [r for r in ROWS if r[0] is not None and r[2] is not None]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    got = sorted(tuple(r) for r in mixing.order(spark.read.parquet(path)).collect())
    assert got == sorted(con.sql(mixing.ORACLE).fetchall())
