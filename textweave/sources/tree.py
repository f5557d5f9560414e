"""Files of a directory tree as DataFrames: listing on the driver, reading on the executors."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweave.functions.parse import doc_block, first_heading, frontmatter, frontmatter_block, purpose
from textweave.plans.config import Config

LISTING = "relpath string, kind string, size long, mtime double, path string"
DOCS = "relpath string, title string, frontmatter string, body string, kind string, hash string, keys map<string,string>"


def allowed(config: Config, notes: list[str] | None = None) -> set[str] | None:
    """Paths that version control does not ignore; None when nothing restricts them."""
    if config.include_gitignored:
        return None
    try:
        out = subprocess.run(["git", "ls-files", "-co", "--exclude-standard", "-z"], cwd=config.root, capture_output=True, timeout=10, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        if notes is not None and Path(config.root, ".gitignore").exists():
            notes.append("there is a .gitignore, but it cannot be applied")
        return None
    return set(out.decode("utf-8", "surrogateescape").split("\0")) - {""}


def kind_of(name: str, config: Config) -> str | None:
    ext = os.path.splitext(name)[1].lower()
    return "code" if ext in config.code_exts else "md" if ext in config.doc_exts else None


def walk(config: Config) -> Iterator[tuple[str, str, int, float, str]]:
    ok = allowed(config)
    for folder, dirs, names in os.walk(config.root):
        dirs[:] = sorted(d for d in dirs if d not in config.skip_dirs)
        for name in sorted(names):
            path = os.path.join(folder, name)
            rel = os.path.relpath(path, config.root).replace(os.sep, "/")
            kind = kind_of(name, config)
            if kind is None or os.path.islink(path) or rel in config.skip_files or ok is not None and rel not in ok:
                continue
            try:
                st = os.stat(path)
            except OSError:
                continue
            yield rel, kind, st.st_size, st.st_mtime, path


def listing(spark: SparkSession, config: Config) -> DataFrame:
    return spark.createDataFrame(list(walk(config)), LISTING)


def read_text(path: str) -> str | None:
    """UTF-8 with bad bytes left out; None if it cannot be read."""
    try:
        return Path(path).read_bytes().decode("utf-8", "ignore")
    except OSError:
        return None


def texts(files: DataFrame, max_bytes: int = 0) -> DataFrame:
    """files with their ``text``; larger ones than max_bytes (0: no limit) and unreadable ones drop out."""

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for paths in batches:
            yield paths.map(read_text)

    read.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    kept = files.where(F.col("size") <= max_bytes) if max_bytes else files
    return kept.withColumn("text", F.pandas_udf(read, "string")("path")).where("text is not null")


def as_docs(rows: DataFrame) -> DataFrame:
    """DOCS of rows(relpath, kind, text): prose in full, code by its leading documentation."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for pdf in batches:
            out = []
            for rel, kind, text in zip(pdf["relpath"], pdf["kind"], pdf["text"]):
                digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
                if kind == "code":
                    line = purpose(rel, text)
                    out.append((rel, line or rel.rsplit("/", 1)[-1], "", doc_block(rel, text) or line, kind, digest, {}))
                else:
                    block = (frontmatter_block(text) or "").replace("\n", " ")
                    out.append((rel, first_heading(text), block, text, "md", digest, frontmatter(text)))
            yield pd.DataFrame(out, columns=["relpath", "title", "frontmatter", "body", "kind", "hash", "keys"])

    return rows.select("relpath", "kind", "text").mapInPandas(make, DOCS)


def frontmatter_rows(docs: DataFrame) -> DataFrame:
    """(relpath, key, value), one row for each key a document has."""
    return docs.select("relpath", F.explode("keys").alias("key", "value"))


def grep_corpus(spark: SparkSession, config: Config) -> DataFrame:
    """(id, text) of every file in full, lower-cased; code as well."""
    return texts(listing(spark, config), config.max_bytes).dropDuplicates(["relpath"]).select(F.col("relpath").alias("id"), F.lower("text").alias("text"))
