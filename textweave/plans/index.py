"""The stored index: Parquet tables of one version, published by a pointer file.

A build writes a new version folder and then replaces the pointer, so readers see a whole version or
the one before; replaced versions stay for KEEP_S seconds, so a lazy reader goes on with its own.  An incremental run lists the tree, compares with the stored snapshot, reads only what
changed, and carries all other rows over with anti-joins.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweave.functions.parse import chunks
from textweave.functions.session import bounded
from textweave.operators import dense, lexical
from textweave.plans.config import Config
from textweave.sources import schemas, tree

TABLES = ("files", "docs", "frontmatter", "chunks", "postings", "lengths")
EPS = 1e-6
KEEP_S = 3_600.0  # how long a replaced version stays


@dataclass
class Stored:
    spark: SparkSession
    path: Path
    meta: dict

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(str(self.path / name))

    def lexical(self) -> lexical.Index:
        return lexical.Index(self.table("postings"), self.table("lengths"), lexical.WEIGHTS, True)

    def register(self, prefix: str = "corpus_") -> None:
        """Tables as views, for SQL of one's own."""
        for name in TABLES:
            self.table(name).createOrReplaceTempView(prefix + name)


def current(spark: SparkSession, config: Config) -> Stored | None:
    try:
        meta = json.loads((config.index_dir / "current.json").read_text())
        path = config.index_dir / meta["version"]
        return Stored(spark, path, meta) if all((path / t).is_dir() for t in TABLES) else None
    except (OSError, ValueError, KeyError):
        return None


def db_signature(config: Config) -> str:
    paths = [Path(config.root, p) for p in config.databases]
    return "|".join(f"{p}:{p.stat().st_mtime}" for p in paths if p.exists())


def embedder(config: Config) -> dense.Embedder:
    if config.provider == "http":
        return dense.HttpEmbedder(config.url, config.model, config.dims, config.key_env or None)
    return dense.HashingEmbedder(config.dims)


def chunk_rows(docs: DataFrame, config: Config) -> DataFrame:
    """(id, chunk_ix, text, vector) of prose and code; the stored text has no prefix."""
    tokens, overlap = config.chunk_tokens, config.overlap
    bounded(docs.sparkSession)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([chunks(t or "", tokens, overlap) for t in texts])

    rows = docs.where("kind <> 'db-table'").select(F.col("relpath").alias("id"), F.posexplode(cut("body")).alias("chunk_ix", "text"))
    if not config.semantic:
        return rows.withColumn("vector", F.lit(None).cast("array<float>")).where("false")
    prefix = dense.prefixes(config.model, config.doc_prefix or None, config.query_prefix or None)[0]
    return dense.embed(rows, "text", embedder(config), prefix).where("vector is not null")


def _publish(config: Config, version: str, meta: dict) -> None:
    pointer = config.index_dir / f"current-{uuid.uuid4().hex}.json"
    pointer.write_text(json.dumps(meta | {"version": version}))
    os.replace(pointer, config.index_dir / "current.json")
    for old in config.index_dir.glob("v-*"):  # younger ones may have readers, or be another build's
        if old.name != version and time.time() - int(old.name.split("-")[1]) / 1000 > KEEP_S:
            shutil.rmtree(old, ignore_errors=True)


def _write(spark: SparkSession, config: Config, files: DataFrame, docs: DataFrame, keys: DataFrame, parts: DataFrame, post: DataFrame, size: DataFrame, meta: dict) -> Stored:
    version = f"v-{int(time.time() * 1000)}-{uuid.uuid4().hex[:6]}"
    base = config.index_dir / version
    base.mkdir(parents=True)
    for name, df in zip(TABLES, (files, docs, keys, parts, post, size)):
        if name == "postings":  # sorted, so that a scan for a few terms skips most row groups
            df = df.repartitionByRange("term").sortWithinPartitions("term")
        df.write.parquet(str(base / name))
    _publish(config, version, meta)
    return Stored(spark, base, meta | {"version": version})


def _meta(config: Config) -> dict:
    return {"db": db_signature(config), "embedding": config.embedding(), "config": config.fingerprint(), "writes": 0}


def _tables_of(docs: DataFrame, config: Config):
    plain = docs.select("relpath", "title", "frontmatter", "body", "kind")
    return plain, chunk_rows(plain, config), lexical.postings(plain, "relpath", tuple(lexical.WEIGHTS), True), lexical.lengths(plain, "relpath", tuple(lexical.WEIGHTS))


def build(spark: SparkSession, config: Config) -> tuple[int, int, int, float]:
    """A whole new version: (prose documents, code documents, tables, milliseconds)."""
    began = time.time()
    seen = tree.listing(spark, config)
    parsed = tree.as_docs(tree.texts(seen, config.max_bytes)).cache()
    tables = schemas.sqlite_docs(spark, [str(Path(config.root, p)) for p in config.databases])
    files = seen.join(parsed.select("relpath", "hash"), "relpath", "left").select("relpath", "size", "mtime", "hash", F.col("hash").isNull().alias("skipped"))
    plain, parts, post, size = _tables_of(parsed.drop("hash", "keys").unionByName(tables), config)
    _write(spark, config, files, plain, tree.frontmatter_rows(parsed), parts, post, size, _meta(config))
    n = {r[0]: r[1] for r in parsed.groupBy("kind").count().collect()}
    parsed.unpersist()
    return n.get("md", 0), n.get("code", 0), tables.count(), (time.time() - began) * 1000


def snapshot_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """(relpath, state) of new and old (relpath, size, mtime): added, maybe, same, deleted.

    ``maybe``: size or time differ, so the content has to be looked at.
    """
    a = new.select("relpath", F.col("size").alias("s1"), F.col("mtime").alias("m1"))
    b = old.select("relpath", F.col("size").alias("s0"), F.col("mtime").alias("m0"))
    same = (F.col("s1") == F.col("s0")) & (F.abs(F.col("m1") - F.col("m0")) < EPS)
    state = F.when(F.col("s0").isNull(), "added").when(F.col("s1").isNull(), "deleted").when(same, "same").otherwise("maybe")
    return a.join(b, "relpath", "full_outer").select("relpath", state.alias("state"))


def refresh(spark: SparkSession, config: Config) -> tuple[int, int, float]:
    """(changed, deleted, milliseconds); nothing is written when nothing changed."""
    began = time.time()
    stored = current(spark, config)
    if stored is None or stored.meta.get("embedding") != config.embedding() or stored.meta.get("config") != config.fingerprint():
        n = build(spark, config)
        return n[0] + n[1], 0, (time.time() - began) * 1000
    seen, old = tree.listing(spark, config).cache(), stored.table("files")
    diff = snapshot_diff(seen, old).where("state <> 'same'").cache()
    counts = {r[0]: r[1] for r in diff.groupBy("state").count().collect()}
    db = db_signature(config)
    if not counts and db == stored.meta["db"]:
        return 0, 0, (time.time() - began) * 1000
    look = seen.join(diff.where("state in ('added', 'maybe')"), "relpath", "left_semi")
    parsed = tree.as_docs(tree.texts(look, config.max_bytes)).cache()
    changed = parsed.join(old.select("relpath", F.col("hash").alias("was")), "relpath", "left").where(~F.col("hash").eqNullSafe(F.col("was"))).drop("was").cache()
    n_changed, n_deleted = changed.count(), counts.get("deleted", 0)
    hashes = parsed.select("relpath", F.col("hash").alias("now"))
    files = seen.join(old.select("relpath", F.col("hash").alias("was")), "relpath", "left").join(hashes, "relpath", "left").join(look.select("relpath", F.lit(True).alias("looked")), "relpath", "left")
    files = files.select("relpath", "size", "mtime", F.when(F.col("looked"), F.col("now")).otherwise(F.col("was")).alias("hash")).withColumn("skipped", F.col("hash").isNull())
    gone = changed.select("relpath").union(diff.where("state = 'deleted'").select("relpath"))
    gone = gone.union(files.where("skipped").select("relpath"))  # grown over the limit
    fresh = changed.drop("hash", "keys")
    if db != stored.meta["db"]:
        gone = gone.union(schemas.only_tables(stored.table("docs")).select("relpath"))
        fresh = fresh.unionByName(schemas.sqlite_docs(spark, [str(Path(config.root, p)) for p in config.databases]))
    gone = gone.distinct().cache()
    plain, parts, post, size = _tables_of(fresh, config)
    by_id = gone.withColumnRenamed("relpath", "id")
    keep = lambda name, key="id": stored.table(name).join(by_id if key == "id" else gone, key, "left_anti")
    meta = _meta(config) | {"writes": stored.meta.get("writes", 0) + 1}
    _write(spark, config, files, keep("docs", "relpath").unionByName(plain), keep("frontmatter", "relpath").unionByName(tree.frontmatter_rows(changed)), keep("chunks").unionByName(parts), keep("postings").unionByName(post), keep("lengths").unionByName(size), meta)
    for df in (seen, diff, parsed, changed, gone):
        df.unpersist()
    return n_changed, n_deleted, (time.time() - began) * 1000


def compact(spark: SparkSession, config: Config, files: int = 1) -> None:
    """Rewrites the tables in few files and starts the write counter anew."""
    stored = current(spark, config)
    if stored is not None:
        _write(spark, config, *(stored.table(t).coalesce(files) for t in TABLES), stored.meta | {"writes": 0})


def with_frontmatter(stored: Stored, key: str, value: str | None = None) -> DataFrame:
    """Paths whose frontmatter has the key (and the value)."""
    rows = stored.table("frontmatter").where(F.col("key") == key)
    return (rows if value is None else rows.where(F.col("value") == value)).select("relpath").distinct()
