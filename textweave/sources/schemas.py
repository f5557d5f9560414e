"""Names of tables and columns as documents; never a value of a row."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from contextlib import closing

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".db", ".sqlite", ".sqlite3")


def _tables(path: str) -> list[tuple[str, str, list[str]]]:
    """(name, table or view, columns) of a SQLite file; none if it is not one."""
    try:
        with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as con:
            found = con.execute("SELECT name, type FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall()
            return [(n, t, [r[0] for r in con.execute("SELECT name FROM pragma_table_info(?)", (n,))]) for n, t in found]
    except sqlite3.Error:
        return []


def count_tables(path: str) -> int:
    try:
        with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as con:
            return con.execute("SELECT count(*) FROM sqlite_master WHERE type IN ('table', 'view')").fetchone()[0]
    except sqlite3.Error:
        return 0


def sqlite_docs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Documents of the databases at paths; the executors read the schemas."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                db = os.path.basename(path)
                for name, kind, columns in _tables(path):
                    rows.append((f"{db} :: {name}", name, "", f"{db} {kind} {name} columns: {', '.join(columns)}", "db-table"))
            yield pd.DataFrame(rows, columns=["relpath", "title", "frontmatter", "body", "kind"])

    return spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "path string").mapInPandas(read, "relpath string, title string, frontmatter string, body string, kind string")


def discover(root: str, skip_dirs: tuple[str, ...] = (), own: str = "") -> list[tuple[str, int]]:
    """(path, tables) of SQLite files under root with a table or view, sorted."""
    out = []
    for folder, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d not in skip_dirs]
        for name in names:
            low, path = name.lower(), os.path.join(folder, name)
            if low.endswith(SUFFIXES) and ".bak" not in low and os.path.abspath(path) != os.path.abspath(own or "/"):
                if n := count_tables(path):
                    out.append((os.path.relpath(path, root).replace(os.sep, "/"), n))
    return sorted(out)


def frame_docs(spark: SparkSession, tables: dict[str, DataFrame], db: str = "catalog") -> DataFrame:
    """Documents of named DataFrames' columns, such as the tables of a catalog."""
    rows = [(f"{db} :: {n}", n, "", f"{db} table {n} columns: {', '.join(df.columns)}", "db-table") for n, df in sorted(tables.items())]
    return spark.createDataFrame(rows, "relpath string, title string, frontmatter string, body string, kind string")


def catalog_docs(spark: SparkSession, db: str = "default") -> DataFrame:
    """Documents of the tables of a Spark catalog database."""
    return frame_docs(spark, {t.name: spark.table(f"{db}.{t.name}" if t.namespace else t.name) for t in spark.catalog.listTables(db)}, db)


def only_tables(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("kind") == "db-table")
