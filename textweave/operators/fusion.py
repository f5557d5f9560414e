"""Reciprocal rank fusion and hybrid search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textweave.functions.text import trim

RRF_K = 60


def pool_size(k: int) -> int:
    return max(4 * k, 30)


def over_fetch(pool: int) -> int:
    return max(8 * pool, 40)


def rrf(*lists: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, id, score) of ranked lists (by, id, rank): sum of 1 / (60 + rank)."""
    rows = reduce(DataFrame.unionByName, [x.select(*by, "id", "rank") for x in lists])
    return rows.groupBy(*by, "id").agg(F.sum(F.lit(1.0) / (RRF_K + F.col("rank"))).alias("score"))


def top(scores: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Best k of (by, id, score), high scores first, ties by id."""
    rows = scores.withColumn("score", F.round("score", 9))
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id") if by else Window.orderBy(F.desc("score"), "id")
    rows = rows if by else rows.orderBy(F.desc("score"), "id").limit(k)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def hybrid(lexical: DataFrame, dense: DataFrame, docs: DataFrame, k: int = 8, id_col: str = "id", by: tuple[str, ...] = (), extra: tuple[str, ...] = ("title", "kind"), passage: DataFrame | None = None) -> DataFrame:
    """Fused hits with the documents' columns; passage(id, text): the chunk or snippet to show."""
    hits = top(rrf(lexical, dense, by=by), k, by)
    back = docs.select(F.col(id_col).alias("id"), *extra)
    out = hits.join(back, "id", "left").fillna("", list(extra))
    return out.join(passage.select("id", trim(F.col("text")).alias("passage")), "id", "left") if passage is not None else out
