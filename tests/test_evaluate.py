import pytest

from textweave.operators import evaluate as ev
from textweave.sources.gold import load_gold


def test_gold(spark, tmp_path):
    path = tmp_path / "g.jsonl"
    path.write_text('{"query": "a b", "gold": "x.md", "class": "exact"}\n\n{"query": "c", "gold": ["y", "z"]}\n')
    r = load_gold(spark, str(path)).collect()
    assert [(x.gold, x["class"], x.query_id) for x in r] == [(["x.md"], "exact", 1), (["y", "z"], "conceptual", 3)]
    for bad in ("{", '{"query": "x"}', '{"gold": "x"}', "[]"):
        path.write_text("\n" + bad)
        with pytest.raises(ValueError, match="line 2"):
            load_gold(spark, str(path))


def test_grep(spark):
    corpus = spark.createDataFrame([("a", "Fox fox fox"), ("b", "fox hound"), ("c", "hound"), ("d", "zzz")], "id string, text string")
    queries = spark.createDataFrame([(1, "fox  HOUND"), (2, "nothing"), (3, " ")], "query_id long, query string")
    r = ev.grep(corpus, queries).orderBy("rank").collect()
    assert [(x.id, x.score, x.total) for x in r] == [("b", 2, 2), ("a", 1, 3), ("c", 1, 1)]


def test_best_k_before_the_shuffle(spark):
    corpus = spark.createDataFrame([(k, f"fox {k}") for k in range(40)], "id long, text string")
    r = ev.grep(corpus, spark.createDataFrame([(1, "fox")], "query_id long, query string"))
    assert "WindowGroupLimit" in r._jdf.queryExecution().executedPlan().toString()
    assert [x.id for x in r.orderBy("rank").collect()] == list(range(8))


def test_metrics(spark):
    queries = spark.createDataFrame([(1, ["b"], "exact"), (2, ["z"], "exact"), (3, ["c", "a"], "other")], "query_id long, gold array<string>, class string")
    hits = spark.createDataFrame([(q, x, k) for q in (1, 2, 3) for k, x in enumerate("abc", 1)], "query_id long, id string, rank long")
    ranks = ev.gold_ranks(queries, hits)
    assert {r.query_id: r["rank"] for r in ranks.collect()} == {1: 2, 2: None, 3: 1}
    s = {r["class"]: (r.n, r.recall, r.mrr) for r in ev.summary(ranks, 2).collect()}
    assert s == {"exact": (2, 0.5, 0.25), "other": (1, 1.0, 1.0), None: (3, 0.666667, 0.5)}
    assert [r.delta for r in ev.deltas(ranks, ranks).collect()] == [0, 0, 0]


def test_bootstrap(spark):
    lo, hi = ev.bootstrap_ci([0.1, 0.5, -0.2, 0.3, 0.0])
    assert lo <= hi and (lo, hi) == ev.bootstrap_ci([0.1, 0.5, -0.2, 0.3, 0.0]) and ev.bootstrap_ci([]) == (0.0, 0.0)
    d = spark.createDataFrame([(0, 0.5), (1, 0.5)], "i long, delta double")
    assert tuple(ev.bootstrap_frame(d, 100).first()) == (0.5, 0.5)
