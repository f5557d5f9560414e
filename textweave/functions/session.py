"""Settings that functions over Arrow batches need."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of a batch that a Python worker is handed, about; a longer row stands alone.
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """spark, whose Python workers are handed batches bounded by bytes, not by rows alone; smaller bounds stay."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    unit = {"k": 10, "m": 20, "g": 30}
    now = spark.conf.get(key).lower().rstrip("b")
    size = int(now[:-1]) << unit[now[-1]] if now[-1] in unit else int(now)
    if not 0 < size <= 2 * BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark
