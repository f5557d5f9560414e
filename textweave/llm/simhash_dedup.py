"""SimHash near-duplicates: fingerprints of word shingles, linked through BK-trees.

``simhash_components`` links by fingerprints alone; ``simhash_dedup`` drops near copies, for which
SimHash finds candidates and the sets of five-word shingles decide (Jaccard 0.8 or more).

Words are runs of non-white-space (ASCII white space) after lower-casing A-Z; shingles of ``size``
words are joined by single spaces and hashed with XXH64 (seed 42).  A fingerprint bit is set if it
is set in over half of the hashes, repeats included.  Fewer words than ``size``: the whole sequence
is the one shingle; no word: fingerprint zero, linked like any other.

Fingerprints within ``radius`` bits link; a component is named by its smallest id.

Edge cases: null text has no words; a null id takes its component like any row but never names one
(a component of null ids only is named null); repeated rows share a fingerprint; an empty table
gives an empty result; ties cannot occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweave.llm.common import maybe_in, prepare, table, tidy
from textweave.llm.hamming import cluster

BATCH = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _fingerprints(texts: list[bytes], size: int) -> np.ndarray:
    import xxhash

    from textweave.llm.words import bit_counts, join_texts, majority, spans

    raw, at = join_texts([t.lower() for t in texts])
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    starts, ends = spans(inside)
    # one space after each word, nothing else between words
    keep = inside.copy()
    keep[ends] = True
    flat = np.where(inside, raw, 32).astype(np.uint8)[keep].tobytes()
    lens = ends - starts
    begin = np.concatenate([[0], np.cumsum(lens + 1)]).astype(np.int64)
    first = np.searchsorted(starts, at)
    words = np.diff(first)
    n = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    offsets = np.concatenate([[0], np.cumsum(n)])
    w = np.repeat(first[:-1], n) + np.arange(int(offsets[-1])) - np.repeat(offsets[:-1], n)
    last = w + np.repeat(np.minimum(words, size), n)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(flat[s:e], 42) for s, e in zip(begin[w].tolist(), (begin[last] - 1).tolist())), dtype=np.uint64, count=len(w))
    return majority(bit_counts(h, offsets), n)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp) of every row, fp a signed long."""
    prepare(docs.sparkSession)

    def make(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            out, i = [], 0
            while i < len(texts):
                j, n = i, 0
                while j < len(texts) and (j == i or n + len(texts[j]) <= BATCH):
                    n += len(texts[j])
                    j += 1
                out.append(_fingerprints(texts[i:j], size))
                i = j
            fp = np.concatenate(out) if out else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(make), f"doc_id {kind}, fp long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2, blocks: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    rows = table(fingerprints(docs, id_col, text_col, size), "fingerprints")
    nodes = table(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    parts = cluster(nodes.select(F.col("fp").alias("node"), "fp"), None, radius, blocks=blocks)
    named = nodes.join(parts, nodes["fp"] == parts["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    of = named.join(lowest, "component").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# -- near copies, verified ---------------------------------------------------------------------------
def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles."""
    from textweave.llm.words import join_texts, mix, span_hashes, spans

    raw, at = join_texts([t.lower() for t in texts])
    starts, ends = spans(~((raw == 32) | ((raw >= 9) & (raw <= 13))))
    w = span_hashes(raw, starts, ends)
    first = np.searchsorted(starts, at)
    words = np.diff(first)
    n = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    offsets = np.concatenate([[0], np.cumsum(n)])
    begin = np.repeat(first[:-1], n) + np.arange(int(offsets[-1])) - np.repeat(offsets[:-1], n)
    length = np.repeat(np.minimum(words, size), n)
    h = length.astype(np.uint64)
    for j in range(size):
        h = np.where(j < length, mix(h * _STEP + w[np.minimum(begin + j, len(w) - 1)]), h) if len(w) else h
    return [np.unique(h[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of about BATCH bytes; a longer text stands alone."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= BATCH):
            n += len(texts[j])
            j += 1
        yield texts[i:j]
        i = j


def _set_names(sets: list[np.ndarray]) -> np.ndarray:
    """128-bit names of sets, as rows of two numbers."""
    import xxhash

    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(s.tobytes()) for s in sets]), np.int64).reshape(-1, 2)


def set_features(rows: DataFrame, size: int, n_keys: int) -> DataFrame:
    """(row, row2, id, node, node2, n, fp, keys) of rows(row, row2, id, text): the set's name, its size, its SimHash, its min-hashes."""

    def make(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from textweave.llm.words import bit_counts, majority, mix

        seeds = mix(np.arange(1, n_keys + 1, dtype=np.uint64) * _STEP)
        for batch in batches:
            names, n, fps, keys = [], [], [], []
            for part in _slices([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(3).to_pylist()]):
                sets = shingle_sets(part, size)
                lens = np.array([len(s) for s in sets], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(lens)])
                flat = np.concatenate(sets)
                fps.append(majority(bit_counts(flat, offsets), lens))
                low = np.zeros((len(sets), n_keys), dtype=np.int64)
                some = np.flatnonzero(lens)
                if some.size:
                    for k, seed in enumerate(seeds):
                        low[some, k] = mix(np.minimum.reduceat(mix(flat ^ seed), offsets[:-1][some]) + seed).view(np.int64)
                names.append(_set_names(sets))
                n += lens.tolist()
                keys += [x.tolist() if m else [] for x, m in zip(low, lens)]
            fp = np.concatenate(fps).view(np.int64) if fps else np.zeros(0, np.int64)
            names = np.concatenate(names) if names else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in range(3)), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(n, pa.int64()), pa.array(fp), pa.array(keys, pa.list_(pa.int64()))], ["row", "row2", "id", "node", "node2", "n", "fp", "keys"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(tidy(make), f"row long, row2 long, id {kind}, node long, node2 long, n long, fp long, keys array<long>")


def set_bodies(rows: DataFrame, size: int) -> DataFrame:
    """(node, body) of rows(text): the set's name and its hashes."""

    def make(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in _slices([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist()]):
                sets = shingle_sets(part, size)
                yield pa.RecordBatch.from_arrays([pa.array(_set_names(sets)[:, 0]), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "body"])

    return rows.select("text").mapInArrow(tidy(make), "node long, body binary")


def jaccard_at_least(a: bytes, b: bytes, similarity: float) -> bool:
    n, m = len(a) // 8, len(b) // 8
    if min(n, m) < similarity * max(n, m):
        return False
    both = len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
    return both >= similarity * (n + m - both)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, radius: int = 26, n_keys: int = 8) -> DataFrame:
    """(id, component_id) of every row: groups linked by a Jaccard similarity of word shingles.

    Texts with the same set of shingles are one node.  Nodes meet in shards keyed by min-hashes (a pair at
    the similarity misses all of n_keys shards with probability (1 - similarity) ** n_keys), are found there
    by SimHash within a radius that allows five standard deviations, and are verified on their whole sets.
    """
    seen, named = _near_rows(docs, id_col, text_col, size, similarity, radius, n_keys)
    of = _parts(seen, named)
    lowest = of.groupBy("part").agg(F.min("id").alias("component_id"))
    return of.join(lowest, "part").select("id", "component_id")


def _parts(seen: DataFrame, named: DataFrame) -> DataFrame:
    """seen with part, the component of its node; a set that only shares 64 bits of another's name stands alone."""
    own = F.col("node2") == F.col("named2")
    part = F.when(own, F.struct(F.col("component").alias("a"), F.lit(None).cast("long").alias("b"))).otherwise(F.struct(F.col("node").alias("a"), F.col("node2").alias("b")))
    return seen.join(named.select("node", F.col("node2").alias("named2"), "component"), "node").withColumn("part", part).drop("named2", "component")


def _near_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, radius: int = 26, n_keys: int = 8) -> tuple[DataFrame, DataFrame]:
    """(row, row2, id, node, node2) of every row, and (node, node2, component) of every node, as for ``near_components``."""
    prepare(docs.sparkSession)
    rows = docs.select(*_row_keys(id_col, text_col), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    seen = table(set_features(rows, size, n_keys), "shingled")
    nodes = table(seen.groupBy("node").agg(F.min(F.struct("node2", "row", "n", "fp", "keys")).alias("x")).select("node", "x.*"), "nodes")
    keyed = nodes.select("node", "row", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    wanted = table(keyed.join(shared, "key", "left_semi").select("node", "row").distinct(), "wanted")
    some = maybe_in(rows.select("row", "text"), F.col("row"), wanted, F.col("row")).where("__tw_maybe")  # few others come along and are joined to nothing
    bodies = set_bodies(some, size).join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("body").alias("body"))
    found = table(nodes.join(bodies, "node").select("node", "fp", "keys", (8 * F.col("n")).alias("w"), "body"), "sets")
    few = min(2, n_keys)
    passes = [F.slice("keys", 1, few), *([F.slice("keys", few + 1, n_keys - few)] if n_keys > few else [])]
    parts = cluster(found, passes, radius, lambda a, b: jaccard_at_least(a, b, similarity), "body")
    return seen.select("row", "row2", "id", "node", "node2"), nodes.join(parts, "node", "left").select("node", "node2", F.coalesce("component", "node").alias("component"))


def _row_keys(id_col: str, text_col: str, names: tuple[str, str] = ("row", "row2")) -> list:
    """A 128-bit hash of a row's id and text, as two columns."""
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias(names[0]), F.xxhash64(F.lit(2), F.col(text_col), F.col(id_col)).alias(names[1])]


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each group of near copies: of its smallest id (null ids last), then smallest row key.

    Of rows that repeat in full (id and text), one stays.
    """
    seen, named = _near_rows(docs, id_col, text_col, **how)
    rows = table(_parts(seen, named).groupBy("row", "row2").agg(F.first("part").alias("part"), F.first("id").alias("id"), F.count("*").alias("n")), "near-rows")
    at = F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "row2")
    stays = rows.groupBy("part").agg(F.min(at).alias("stays"), F.count("*").alias("k")).where("k > 1").select("part", F.col("stays.row").alias("s1"), F.col("stays.row2").alias("s2"))
    gone = rows.join(stays, "part").where("NOT (row = s1 AND row2 = s2)").select("row", "row2", F.lit(False).alias("once"))
    often = rows.where("n > 1").join(gone, ["row", "row2"], "left_anti").select("row", "row2", F.lit(True).alias("once"))
    acts = table(gone.union(often).select(F.col("row").alias("__tw_1"), F.col("row2").alias("__tw_2"), F.col("once").alias("__tw_once")), "near-acts")
    k1, k2 = _row_keys(id_col, text_col, ("__tw_k1", "__tw_k2"))
    keyed = maybe_in(docs.select("*", k1, k2), F.col("__tw_k1"), acts, F.col("__tw_1"))
    met = keyed.where("__tw_maybe").join(acts, (F.col("__tw_k1") == F.col("__tw_1")) & (F.col("__tw_k2") == F.col("__tw_2")), "left")
    out = keyed.where("NOT __tw_maybe").select(*[f"`{c}`" for c in docs.columns]).unionByName(met.where("__tw_once IS NULL").select(*[f"`{c}`" for c in docs.columns]))
    if acts.where("__tw_once").isEmpty():
        return out
    return out.unionByName(met.where("__tw_once").dropDuplicates(["__tw_k1", "__tw_k2"]).select(*[f"`{c}`" for c in docs.columns]))
