"""Session settings, shared scratch tables, and connected components."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes as well as rows; workers can import this library."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode, where all is one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        base = f"file://{tempfile.mkdtemp(prefix='textweave-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended  # noqa: BLE001
            pass

    atexit.register(remove)
    return path


#: Shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: lineage ends and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.tw_path = path
    return out


@contextlib.contextmanager
def codec(spark: SparkSession, name: str) -> Iterator[None]:
    """Tables written meanwhile are compressed by this codec."""
    key = "spark.sql.parquet.compression.codec"
    before = spark.conf.get(key)
    spark.conf.set(key, name)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def free(*tables: DataFrame) -> None:
    """Remove what ``table`` has written and nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.tw_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of the JVM-side bitmap of maybe_in (2 ** 20 rows of 64 bits are broadcast at most), and of a packed one.
MAYBE_BITS, PACKED_BITS = 26, 29


def maybe_in(df: DataFrame, key: Column, hits: DataFrame, hit_key: Column) -> DataFrame:
    """df with __tw_maybe, true wherever the long key is among hit_key of hits, and for few other rows.

    A bitmap of 2 ** MAYBE_BITS bits at most is broadcast, as rows of 64 bits: where it fills up, more rows
    are true, so what follows does more work and gives the same result.
    """
    bit = lambda k: F.pmod(k, F.lit(1 << MAYBE_BITS))
    words = hits.select(F.shiftright(bit(hit_key), 6).alias("__tw_word"), F.expr("1L").alias("one"), bit(hit_key).alias("k")).groupBy("__tw_word").agg(F.bit_or(F.expr("shiftleft(one, CAST(k & 63 AS INT))")).alias("__tw_bits"))
    out = df.withColumn("__tw_bit", bit(key)).join(F.broadcast(words), F.shiftright("__tw_bit", 6) == F.col("__tw_word"), "left")
    is_set = F.expr("coalesce(shiftrightunsigned(__tw_bits, CAST(__tw_bit & 63 AS INT)) & 1, 0) = 1")
    return out.withColumn("__tw_maybe", is_set).drop("__tw_bit", "__tw_word", "__tw_bits")


def bitmap_of(df: DataFrame, column: str):
    """Broadcast bitmap of the 64-bit values of a column: longs, or packed values (binary).

    32 bits a value, 2 ** PACKED_BITS bits (64 MB) at most; tasks send it in pieces of the ranges they hold.
    """
    import numpy as np

    packed = df.schema[column].dataType.typeName() == "binary"
    n = df.agg(F.sum(F.octet_length(column) / 8) if packed else F.count(column)).first()[0] or 0
    bits = min(PACKED_BITS, max(16, int(32 * n).bit_length()))

    def pieces(batches):
        import pyarrow as pa

        for batch in batches:
            for values in (np.frombuffer(x, np.uint64) for x in batch.column(0).to_pylist()) if packed else [batch.column(0).to_numpy().view(np.uint64)]:
                if len(values):
                    at = values >> np.uint64(64 - bits)
                    low = int(at.min() >> np.uint64(3))
                    piece = np.zeros(int(at.max() >> np.uint64(3)) - low + 1, np.uint8)
                    np.bitwise_or.at(piece, (at >> np.uint64(3)).astype(np.int64) - low, np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
                    yield pa.RecordBatch.from_arrays([pa.array([low], pa.int64()), pa.array([piece.tobytes()], pa.binary())], ["low", "piece"])

    out = np.zeros(1 << (bits - 3), np.uint8)
    values = df.select(column) if packed else df.select(column).repartitionByRange(F.shiftrightunsigned(column, 1)).sortWithinPartitions(F.shiftrightunsigned(column, 1))
    for row in values.mapInArrow(pieces, "low long, piece binary").toLocalIterator():
        out[row.low : row.low + len(row.piece)] |= np.frombuffer(row.piece, np.uint8)
    return df.sparkSession.sparkContext.broadcast(out.tobytes())


def in_bitmap(bitmap: bytes, keys):
    """Whether the bits of keys (uint64) are set."""
    import numpy as np

    bits = len(bitmap).bit_length() + 2
    at = keys >> np.uint64(64 - bits)
    return np.frombuffer(bitmap, np.uint8)[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def tidy(work):
    """work, a function over Arrow batches, after which the worker gives its free memory back to the system."""

    def run(batches):
        import ctypes

        import pyarrow as pa

        yield from work(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass

    return run


def crc_mod(id_col: str, m: int) -> Column:
    """crc32 of the id as text, modulo m; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % m


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links(a, b); component is the smallest node reachable.

    Alternating large-star and small-star rounds, each one aggregate with map-side combine and one
    join, cut by a written table.  Links never reach the driver, and a node with very many neighbours
    is only ever a skewed join side, which adaptive execution can split.
    """
    edges = table(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    before = state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).union(edges.select("a", "b"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a < b").distinct()
        edges = table(small, "edges")
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.union(edges.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()


def grown_components(known: DataFrame, links: DataFrame) -> DataFrame:
    """``connected_components`` of the links of known(node, component) and of links(a, b).

    Components are searched between those of known that links join alone, so few links cost no rounds over all nodes.
    """
    for c in ("a", "b"):
        of = known.select(F.col("node").alias(c), F.col("component").alias("of"))
        links = links.join(of, c, "left").withColumn(c, F.coalesce("of", c)).drop("of")
    joined = table(connected_components(links), "joined")
    of = joined.select(F.col("node").alias("component"), F.col("component").alias("of"))
    return known.join(of, "component", "left").select("node", F.coalesce("of", "component").alias("component")).union(joined).distinct()
