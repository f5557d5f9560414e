"""Retrieval evaluation: substring arm, ranks of gold documents, recall@k, MRR, bootstrap intervals."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textweave.functions.substrings import Finder, slices

#: Counts of words in a slice of texts at most; rows that a task of grep holds at least before it drops or passes on some.
CELLS, HELD = 1 << 19, 1 << 16


def grep(corpus: DataFrame, queries: DataFrame, k: int = 8, words: Column | None = None) -> DataFrame:
    """(query_id, id, score, rank) of corpus(id, text) for a stated query set queries(query_id, query).

    words: the words of a query in lower case, where it is not cut at white space.
    Documents rank by how many words of the query they contain (as substrings, repeats count again), then
    by all occurrences, then id.  The queries are few and go to every task, which reads a text once for all
    words; only its best k of a query, and their ties, leave it.
    """
    spark = corpus.sparkSession
    split = F.filter(F.split(F.lower(F.col("query")), r"\s+") if words is None else words, lambda w: w != "")
    asked = queries.select("query_id", split.alias("words")).where("words is not null").collect()
    strings = sorted({w.encode("utf-8", "surrogatepass") for r in asked for w in r.words if w})
    place = {w: i for i, w in enumerate(strings)}
    times = np.zeros((len(strings), len(asked)))
    for j, r in enumerate(asked):
        for w in r.words:
            times[place[w.encode("utf-8", "surrogatepass")], j] += 1
    held = spark.sparkContext.broadcast((strings, times))

    def run(batches: Iterator) -> Iterator:
        strings, times = held.value
        best = _Best(k, times.shape[1])
        finder = Finder(strings)
        for batch in batches:
            for start, texts in slices(batch.column(1), max(1, CELLS // max(1, *times.shape))):
                n = finder.counts(texts)
                score, total = (np.rint(x @ times).astype(np.int64) for x in ((n > 0).astype(float), n.astype(float)))
                yield from best.add(batch.column(0), start, score, total)
        yield from best.flush()

    kind = corpus.schema["id"].dataType.simpleString()
    rows = corpus.select("id", F.lower("text").alias("t")).where("t is not null").mapInArrow(run, f"q int, id {kind}, score long, total long")
    names = spark.createDataFrame([(j, r.query_id) for j, r in enumerate(asked)], T.StructType([T.StructField("q", T.IntegerType()), T.StructField("query_id", queries.schema["query_id"].dataType)]))
    rows = rows.join(F.broadcast(names), "q")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("total"), "id")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)  # compared as it is, every task sends its best k alone
    return rows.select("query_id", "id", "score", "total", F.col("rank").cast("long").alias("rank"))


class _Best:
    """The best k of each query so far, with all that tie with the last of them."""

    def __init__(self, k: int, queries: int):
        self.k, self.least = k, np.zeros(queries, np.int64)
        self.most = max(HELD, 4 * k * queries)
        self._clear()

    def _clear(self) -> None:
        self.ids, self.q, self.score, self.total, self.key = [], *(np.zeros(0, np.int64) for _ in range(4))

    def add(self, ids, start: int, score: np.ndarray, total: np.ndarray) -> Iterator:
        """Rows of scores and totals, a column a query; ids are those from start on.  What no longer fits is passed on."""
        key = np.where(score > 0, (score << 40) + total, -1)
        if len(key) >= self.k:
            self.least = np.maximum(self.least, np.partition(key, len(key) - self.k, axis=0)[len(key) - self.k])
        row, q = np.nonzero((key >= self.least) & (key > 0))
        if len(row):
            import pyarrow as pa

            self.ids.append(ids.take(pa.array(row + start)))
            self.q, self.score, self.total, self.key = (np.concatenate([old, new]) for old, new in ((self.q, q), (self.score, score[row, q]), (self.total, total[row, q]), (self.key, key[row, q])))
        if len(self.q) > self.most:
            self._prune()
            if len(self.q) > self.most // 2:  # ties without end
                yield from self.flush()

    def _prune(self) -> None:
        import pyarrow as pa

        order = np.lexsort((-self.key, self.q))
        q = self.q[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        last = first + self.k - 1
        full = last < np.append(first[1:], len(q))
        self.least[q[first[full]]] = np.maximum(self.least[q[first[full]]], self.key[order][last[full]])
        stay = np.flatnonzero(self.key >= self.least[self.q])
        self.ids = [pa.concat_arrays(self.ids).take(pa.array(stay))]
        self.q, self.score, self.total, self.key = self.q[stay], self.score[stay], self.total[stay], self.key[stay]

    def flush(self) -> Iterator:
        if len(self.q):
            import pyarrow as pa

            self._prune()
            yield pa.RecordBatch.from_arrays([pa.array(self.q.astype(np.int32)), pa.concat_arrays(self.ids), pa.array(self.score), pa.array(self.total)], ["q", "id", "score", "total"])
            self._clear()


def containing(docs: DataFrame, passages: list[str], text_col: str, *keep: str) -> DataFrame:
    """(passage, keep...): the number of each passage, with each of docs that contains it; a text is read once for all."""
    whole = [p.encode("utf-8", "surrogatepass") for p in passages]
    some = [i for i, p in enumerate(whole) if p]
    held = docs.sparkSession.sparkContext.broadcast([whole[i] for i in some])
    number, empty = np.array(some, np.int64), [i for i, p in enumerate(whole) if not p]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        finder = Finder(held.value)
        for batch in batches:
            for start, texts in slices(batch.column(0), 1 << 12):
                text, passage, _ = finder.find(texts)
                pairs = np.unique(np.stack([text, number[passage]], 1), axis=0) if len(text) else np.zeros((0, 2), np.int64)
                pairs = np.concatenate([pairs, *(np.stack([np.arange(len(texts)), np.full(len(texts), i)], 1) for i in empty)])
                where = pa.array(pairs[:, 0] + start)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1].astype(np.int32)), *(c.take(where) for c in batch.columns[1:])], ["passage", *keep])

    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.where(F.col(text_col).isNotNull()).select(text_col, *keep).mapInArrow(run, "passage int" + kinds)


def gold_ranks(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, class, rank) of queries(query_id, class, gold array); rank null if no gold id is a hit."""
    wanted = queries.select("query_id", F.explode("gold").alias("id")).distinct()
    best = hits.join(wanted, ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return queries.select("query_id", "class").join(best, "query_id", "left")


def recall(rank: Column, k: int) -> Column:
    return F.coalesce((rank <= k).cast("double"), F.lit(0.0))


def reciprocal(rank: Column) -> Column:
    return F.coalesce(F.lit(1.0) / rank, F.lit(0.0))


def summary(ranks: DataFrame, k: int = 8, arm: str | None = None) -> DataFrame:
    """(arm, class, n, recall, mrr) per class and, with class null, overall."""
    by = [arm] if arm else []
    sets = [[*by, "class"], by]
    rows = ranks.groupingSets(sets, *by, "class") if hasattr(ranks, "groupingSets") else ranks.rollup(*by, "class")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(recall(F.col("rank"), k)), 6).alias("recall"), F.round(F.avg(reciprocal(F.col("rank"))), 6).alias("mrr"))


def deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, delta) of reciprocal ranks of two arms."""
    return a.join(b.select("query_id", F.col("rank").alias("other")), "query_id").select("query_id", (reciprocal(F.col("rank")) - reciprocal(F.col("other"))).alias("delta"))


def bootstrap_ci(values: list[float], rounds: int = 2000, seed: int = 1234) -> tuple[float, float]:
    """95 % percentile interval of the mean, repeatable; on the driver, for one value a query."""
    if not values:
        return 0.0, 0.0
    draw = random.Random(seed)
    n = len(values)
    means = []
    for _ in range(rounds):
        means.append(sum(values[draw.randrange(n)] for _ in values) / n)
    means.sort()
    return round(means[int(0.025 * rounds)], 3), round(means[int(0.975 * rounds)], 3)


def bootstrap_frame(delta: DataFrame, rounds: int = 2000) -> DataFrame:
    """(lo, hi) of the mean of delta(i, delta), i from 0: resampling by hash, in DataFrame operations."""
    n = delta.count()
    spark = delta.sparkSession
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", "round", "draw").cast("binary")), 1, 8), 16, 10).cast("long") % max(1, n)
    draws = spark.range(rounds).select(F.col("id").alias("round"), F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1)))).alias("draw")).select("round", pick.alias("i"))
    means = draws.join(F.broadcast(delta), "i").groupBy("round").agg(F.round(F.avg("delta"), 9).alias("mean"))
    order = means.withColumn("r", F.row_number().over(Window.orderBy("mean", "round")))
    at = lambda q: F.max(F.when(F.col("r") == int(q * rounds) + 1, F.col("mean")))
    return order.agg(F.round(at(0.025), 3).alias("lo"), F.round(at(0.975), 3).alias("hi"))
