"""Gold sets: JSON lines of query, gold (a path or a list), class."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "query_id long, query string, gold array<string>, class string"


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, gold, class); a bad line is a ValueError with its number."""
    rows = []
    with open(path, encoding="utf-8") as lines:
        for number, line in enumerate(lines, 1):
            if not line.strip():
                continue
            try:
                item = json.loads(line)
            except ValueError as e:
                raise ValueError(f"line {number}: no JSON: {e}") from e
            if not isinstance(item, dict) or not item.get("query") or not item.get("gold"):
                raise ValueError(f"line {number}: query and gold are needed")
            gold = item["gold"] if isinstance(item["gold"], list) else [item["gold"]]
            rows.append((number, str(item["query"]), [str(g) for g in gold], item.get("class") or "conceptual"))
    return spark.createDataFrame(rows, SCHEMA)
