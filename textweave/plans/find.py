"""find, lint and bench over a stored index."""

from __future__ import annotations

import os
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweave.operators import dense, evaluate, fusion, lexical, lint
from textweave.plans import index
from textweave.plans.config import Config
from textweave.sources import tree

AUTO_COMPACT = 200


def ensure_fresh(spark: SparkSession, config: Config, again: bool = True) -> str:
    """Brings the index up to date; a full build if it is missing or the environment asks for one."""
    if os.environ.get("TEXTWEAVE_REBUILD") or index.current(spark, config) is None:
        return "built: {} prose, {} code, {} tables".format(*index.build(spark, config)[:3])
    if not again:
        return "not refreshed"
    changed, deleted, _ = index.refresh(spark, config)
    stored = index.current(spark, config)
    if stored and stored.meta.get("writes", 0) >= AUTO_COMPACT:
        index.compact(spark, config)
    return f"refreshed: {changed} changed, {deleted} deleted"


def search(stored: index.Stored, config: Config, text: str, k: int = 8, lexical_only: bool = False, strict: bool = False, notes: list[str] | None = None) -> DataFrame:
    """(rank, relpath, title, kind, score, snippet), best first.

    Hybrid where there are vectors: pools of both sides fused; if the query cannot be embedded, lexical.
    """
    notes = notes if notes is not None else []
    docs, ix = stored.table("docs"), stored.lexical()
    vector = None
    if config.semantic and not lexical_only:
        try:
            prefix = dense.prefixes(config.model, config.doc_prefix or None, config.query_prefix or None)[1]
            vector = dense.normalise(index.embedder(config).embed([prefix + text]))[0].tolist()
        except dense.EmbeddingError as e:
            notes.append(f"words only: {e}")
    chunks = stored.table("chunks")
    if vector is None or chunks.isEmpty():
        hits = lexical.search(ix, text, k, strict, notes).withColumn("score", F.round("score", 3))
        out = hits.join(docs.select(F.col("relpath").alias("id"), "title", "kind"), "id", "left")
        out = lexical.snippets(out, docs, text, stemmed=True)
        return out.select("rank", F.col("id").alias("relpath"), "title", "kind", "score", "snippet").orderBy("rank")
    pool = fusion.pool_size(k)
    words = lexical.search(ix, text, pool, strict, notes)
    near = dense.rollup(dense.knn(chunks, vector, fusion.over_fetch(pool)).select("id", "chunk_ix", "distance"), pool)
    hits = fusion.hybrid(words, near, docs, k, "relpath").cache()
    shown = lexical.snippets(hits, docs, text, stemmed=True)
    best = near.join(chunks.select("id", "chunk_ix", F.col("text").alias("chunk")), ["id", "chunk_ix"]).select("id", "chunk")
    from textweave.functions.text import trim

    out = shown.join(best, "id", "left").withColumn("snippet", F.coalesce(trim(F.col("chunk")), F.col("snippet")))
    return out.select("rank", F.col("id").alias("relpath"), "title", "kind", F.round("score", 4).alias("score"), "snippet").orderBy("rank")


def findings(spark: SparkSession, config: Config, now: float | None = None) -> DataFrame:
    """Lint over the sources themselves, not the index; the size limit does not apply."""
    seen = tree.listing(spark, config)
    docs = tree.texts(seen.where("kind = 'md'")).select(F.col("relpath").alias("path"), "text", "mtime")
    return lint.lint(docs, now or time.time(), list(config.types), config.stale_days, seen.select(F.col("relpath").alias("path")))


def bench(spark: SparkSession, config: Config, gold: DataFrame, k: int = 8) -> dict:
    """Three arms over a gold set: metrics per class and overall, and deltas with intervals."""
    stored = index.current(spark, config)
    queries = gold.select("query_id", "query").cache()
    asked = [(r.query_id, r.query) for r in queries.collect()]  # the gold set
    ix, pool = stored.lexical(), fusion.pool_size(k)
    arms = {"grep": evaluate.grep(tree.grep_corpus(spark, config), queries, k), "lexical": lexical.search_batch(ix, queries, k)}
    if config.semantic:
        prefix = dense.prefixes(config.model, config.doc_prefix or None, config.query_prefix or None)[1]
        vectors = dense.normalise(index.embedder(config).embed([prefix + q for _, q in asked]))
        near = dense.rollup(dense.knn_batch(stored.table("chunks"), vectors, [i for i, _ in asked], fusion.over_fetch(pool)), pool, ("query_id",))
        arms["hybrid"] = fusion.top(fusion.rrf(lexical.search_batch(ix, queries, pool), near, by=("query_id",)), k, ("query_id",))
    ranks = {a: evaluate.gold_ranks(gold, hits).cache() for a, hits in arms.items()}
    out = {"k": k, "arms": {a: {r["class"] or "overall": {"n": r["n"], "recall": r["recall"], "mrr": r["mrr"]} for r in evaluate.summary(x, k).collect()} for a, x in ranks.items()}, "deltas": {}}
    for other in ("grep", "lexical"):
        if "hybrid" in ranks:
            d = [r.delta for r in evaluate.deltas(ranks["hybrid"], ranks[other]).orderBy("query_id").collect()]  # one a query
            out["deltas"][f"hybrid_minus_{other}"] = {"delta": round(sum(d) / len(d), 3) if d else 0.0, "ci95": evaluate.bootstrap_ci(d)}
    return out


def format_report(report: dict) -> str:
    lines = [f"{'arm':<10}{'class':<14}{'n':>4}  recall@{report['k']}      MRR"]
    for arm, rows in report["arms"].items():
        for name, r in sorted(rows.items()):
            bar = "█" * round(5 * r["recall"]) + "░" * (5 - round(5 * r["recall"]))
            lines.append(f"{arm:<10}{name:<14}{r['n']:>4}  {bar} {r['recall']:>4.0%}  {r['mrr']:.2f}")
    lines += [f"{name}: {d['delta']:+.3f}, 95 % [{d['ci95'][0]:+.3f}, {d['ci95'][1]:+.3f}]" for name, d in report["deltas"].items()]
    return "\n".join(lines)


def root_of(path: str | Path) -> str:
    from textweave.plans.config import find_root

    return str(find_root(path))
