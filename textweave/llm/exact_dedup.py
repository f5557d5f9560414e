"""Exact deduplication as a stream with keyed state.

A Structured Streaming aggregation keeps, per digest of the normalised text and without expiry, the
stable identifier and the content locator (file and row number) of the row to keep, and how many rows
there are.  The state lives in RocksDB on the executors' disks, checkpointed to the shared folder; with
``checkpoint`` a later run goes on where the last one ended, and streams new files only.

A digest met more than once is a hit: the full normalised bytes of all its rows are compared (an
aggregate on digest and text, combined before the shuffle, so a huge group of copies is one row per
task).  The state holds the locator of the row to keep alone, so the other rows of a hit are found by
their digest, in one scan; a bitmap of the hits (bounded, see ``maybe_in``) lets no other text move.
Where bytes differ under one digest, the group is split by its bytes.

Texts are equal when identical without the characters ``[\\x20\\x09-\\x0D]``; of equal texts the row with
the most code points stays, then the one with the smallest id, then the first by locator.

Edge cases: null text counts as empty; a null id comes after all others; of fully repeated rows
exactly one stays; an empty table gives an empty result; very long texts are read whole; further
columns are ignored, one named ``_metadata`` too.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textweave.llm.common import maybe_in, scratch, table

_BLANK = " \t\n\x0b\x0c\r"


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _BLANK, "")


def _signed(rows: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """(digest, doc_id, rank, norm, sha) of every row; rank orders a group, its smallest row stays."""
    place = rows.metadataColumn("_metadata")
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = normalised(F.col(text_col))
    rank = F.struct((-F.length(text)).alias("n"), F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), place["file_path"].alias("file"), place["row_index"].alias("row"))
    return rows.select(digest(norm).alias("digest"), F.col(id_col).alias("doc_id"), rank.alias("rank"), norm.alias("norm"), F.sha2(norm, 256).alias("sha"))


def _pattern(path: str) -> str:
    """A glob that path alone matches; a stream takes a plain path for a folder only."""
    path = path.rstrip("/")
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path[:-1]) + f"[{path[-1]}]"


def run_state(spark: SparkSession, path: str, schema: T.StructType, id_col: str, text_col: str, digest: Callable[[Column], Column], checkpoint: str, files_per_batch: int | None = None) -> DataFrame:
    """Streams all files of path not seen before under this checkpoint; the state after all its runs.

    (digest, best, n): best is the rank of the row to keep.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    state = _signed(reader.parquet(_pattern(path)), id_col, text_col, digest).groupBy("digest").agg(F.min("rank").alias("best"), F.count("*").alias("n"))
    out = f"{checkpoint}/updates"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    conf = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each of the many stores reserves megabytes
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kind = T.StructType([*state.schema.fields])
    try:
        updates = spark.read.schema(T.StructType([*kind.fields, T.StructField("batch", T.IntegerType())])).parquet(out)
    except Exception as e:  # no file, no batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], kind)
    return updates.groupBy("digest").agg(F.max_by("best", "batch").alias("best"), F.max("n").alias("n"))


def exact_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None, checkpoint: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of the Parquet at path.

    checkpoint: a folder that all machines share; the state in it goes on with each run.
    """
    docs = spark.read.parquet(path)
    state = run_state(spark, path, docs.schema, id_col, text_col, digest, checkpoint or scratch(spark, "dedup-state"), files_per_batch)
    hits = table(state.where("n > 1"), "dedup-hits")
    rows = maybe_in(_signed(docs, id_col, text_col, digest), F.xxhash64("digest"), hits, F.xxhash64("digest"))
    some = rows.where("__tw_maybe")
    classes = some.groupBy("digest", "norm").agg(F.count("*").alias("size"))
    split = table(classes.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "dedup-split")

    def finish(df: DataFrame, keep: Column, n: Column) -> DataFrame:
        return df.select("doc_id", keep["id"].alias("keep_id"), n.cast("long").alias("group_size"), (keep == F.col("rank")).alias("kept"), F.col("sha").alias("text_sha256"))

    keep, n = F.coalesce("best", "rank"), F.coalesce("n", F.lit(1))
    alone = finish(rows.where("NOT __tw_maybe"), F.col("rank"), F.lit(1))
    plain = some.select("digest", "doc_id", "rank", "sha").join(hits, "digest", "left")
    if split.isEmpty():
        return alone.unionByName(finish(plain, keep, n))
    apart = some.join(split, "digest", "left_semi")
    by_bytes = apart.groupBy("digest", "norm").agg(F.min("rank").alias("best"), F.count("*").alias("n"))
    return alone.unionByName(finish(plain.join(split, "digest", "left_anti"), keep, n)).unionByName(finish(apart.join(by_bytes, ["digest", "norm"]), keep, n))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm FROM documents),
w AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""
