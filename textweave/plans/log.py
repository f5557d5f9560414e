"""Event log: JSON lines, off by default; never a passage of a document."""

from __future__ import annotations

import json
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweave.plans.config import Config


def event(config: Config, kind: str, **fields) -> None:
    if not config.log:
        return
    try:
        path = config.index_dir / "events.jsonl"
        path.parent.mkdir(parents=True, exist_ok=True)
        with path.open("a", encoding="utf-8") as out:
            out.write(json.dumps({"ts": datetime.now().isoformat(timespec="seconds"), "type": kind, **fields}) + "\n")
    except (OSError, TypeError, ValueError):
        pass


def read_events(spark: SparkSession, path: str, schema: str = "ts timestamp, type string") -> DataFrame:
    return spark.read.schema(schema).json(path)


def by_day(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("ts").alias("day"), "type").agg(F.count("*").alias("n"))
