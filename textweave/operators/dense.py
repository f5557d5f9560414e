"""Dense retrieval: exact nearest neighbours over unit vectors, and rollup to documents."""

from __future__ import annotations

import json
import os
import urllib.request
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Products of chunks and queries that a task holds at a time.
CELLS = 1 << 20


class EmbeddingError(RuntimeError):
    """An embedder that gave no usable answer."""


class Embedder(Protocol):
    dims: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed counts of hashed words; needs no model."""

    def __init__(self, dims: int = 256):
        self.dims = dims

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), dtype=np.float32)
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                row[h % self.dims] += 1.0 if h >> 16 & 1 else -1.0
        return out


class HttpEmbedder:
    """POSTs {"model", "input"}; the key comes from the environment variable named."""

    def __init__(self, url: str, model: str, dims: int, key_env: str | None = None, timeout: float = 60.0):
        self.url, self.model, self.dims, self.key_env, self.timeout = url, model, dims, key_env, timeout

    def embed(self, texts: list[str]) -> np.ndarray:
        headers = {"Content-Type": "application/json"}
        if self.key_env and os.environ.get(self.key_env):
            headers["Authorization"] = f"Bearer {os.environ[self.key_env]}"
        body = json.dumps({"model": self.model, "input": texts}).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, body, headers), timeout=self.timeout) as answer:
                data = json.load(answer)["data"]
            rows = [x["embedding"] for x in sorted(data, key=lambda x: x["index"])]
        except (OSError, ValueError, KeyError, TypeError) as e:
            raise EmbeddingError(str(e)) from e
        if len(rows) != len(texts):
            raise EmbeddingError(f"{len(rows)} vectors for {len(texts)} texts")
        return np.array(rows, dtype=np.float32)


def prefixes(model: str, doc: str | None = None, query: str | None = None) -> tuple[str, str]:
    """Prefixes for documents and queries; models of the nomic family have their own."""
    own = ("search_document: ", "search_query: ") if "nomic" in model.lower() else ("", "")
    return doc or own[0], query or own[1]


def normalise(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return (rows / np.where(norm == 0, 1, norm)).astype(np.float32)


def norm(c: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(c, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))


def unit(c: Column) -> Column:
    n = norm(c)
    return F.transform(c, lambda x: F.when(n == 0, x.cast("double")).otherwise(x / n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def embed(rows: DataFrame, text_col: str, embedder: Embedder, prefix: str = "", out_col: str = "vector") -> DataFrame:
    """rows with unit vectors; a batch that fails leaves nulls, so its documents stay lexical."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            try:
                vectors = normalise(embedder.embed([prefix + (t or "") for t in texts]))
                if vectors.shape[1] != embedder.dims:
                    raise EmbeddingError(f"{vectors.shape[1]} dimensions, not {embedder.dims}")
                yield pd.Series(list(vectors))
            except EmbeddingError:
                yield pd.Series([None] * len(texts))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn(out_col, F.pandas_udf(run, "array<float>")(F.col(text_col)))


def knn(chunks: DataFrame, query: list[float], over: int, vector_col: str = "vector", keys: tuple[str, ...] = ("id", "chunk_ix")) -> DataFrame:
    """The nearest over chunks with ``distance`` (1 - cosine of unit vectors)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return chunks.withColumn("distance", F.round(F.lit(1.0) - dot(F.col(vector_col), q), 9)).orderBy("distance", *keys).limit(over)


def nearest(rows: np.ndarray, queries: np.ndarray, over: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, query, distance) of the nearest rows of each query, a block of queries at a time."""
    n, wide = min(over, len(rows)), max(1, CELLS // len(rows))
    for low in range(0, len(queries), wide):
        d = np.round(1.0 - rows @ queries[low : low + wide].T, 9)
        edge = np.partition(d, n - 1, axis=0)[n - 1]
        r, c = np.nonzero(d <= edge)  # ties at the edge all go on
        yield r, low + c, d[r, c]


def knn_batch(chunks: DataFrame, queries: np.ndarray, query_ids: list, over: int, vector_col: str = "vector", id_col: str = "id", ix_col: str = "chunk_ix") -> DataFrame:
    """(query_id, id, chunk_ix, distance): nearest over chunks of each of a set of query vectors.

    A batch of chunks meets the queries in blocks of up to CELLS products; only its best ``over`` rows a query leave it.
    """
    spark = chunks.sparkSession
    q = spark.sparkContext.broadcast((np.asarray(queries, dtype=np.float64), list(query_ids)))
    kind = {f.name: f.dataType.simpleString() for f in chunks.schema}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        matrix, names = q.value[0], np.array(q.value[1])
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(2)
            m = v.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
            for r, c, d in nearest(m, matrix, over):
                yield pa.RecordBatch.from_arrays([pa.array(names[c]), batch.column(0).take(pa.array(r)), batch.column(1).take(pa.array(r)), pa.array(d)], ["query_id", "id", "chunk_ix", "distance"])

    id_kind = "long" if all(isinstance(x, (int, np.integer)) for x in query_ids) else "string"
    rows = chunks.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(ix_col).alias("chunk_ix"), F.col(vector_col).alias("v"))
    found = rows.mapInArrow(run, f"query_id {id_kind}, id {kind[id_col]}, chunk_ix {kind[ix_col]}, distance double")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id", "chunk_ix"))
    return found.withColumn("n", order).where(F.col("n") <= over).drop("n")


def rollup(hits: DataFrame, pool: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Best chunk of each document, the nearest pool documents, ranked; by: query columns."""
    first = F.min(F.struct("distance", "chunk_ix")).alias("m")
    docs = hits.groupBy(*by, "id").agg(first).select(*by, "id", F.col("m.distance").alias("distance"), F.col("m.chunk_ix").alias("chunk_ix"))
    order = Window.partitionBy(*by).orderBy("distance", "id") if by else Window.orderBy("distance", "id")
    docs = docs if by else docs.orderBy("distance", "id").limit(pool)
    return docs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pool).withColumn("rank", F.col("rank").cast("long"))
