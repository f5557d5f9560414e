"""Best-fit packing by length patterns.

Token lengths are at most ``capacity``, so their histogram has a fixed size and is all the driver
sees.  Patterns of up to three lengths that fill a sequence exactly are enumerated, repeat counts
are fitted to the histogram by non-negative least squares (accelerated projected gradient with
diagonal scaling), rounded down, and what is left is packed best-fit decreasing, still on the
histogram.  The plan is then a table of (length, first rank, last rank, sequence, offset) whose
size depends on ``capacity`` only; every piece finds its place by its rank among the pieces of its
length.  Ranks are counted in salted groups, so that a very frequent length is no single group.

Edge cases: null and empty texts are one piece that holds the end token alone; a null id is passed
on; repeated rows are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textweave.llm.common import prepare, table
from textweave.llm.token_counts import default_path

ROWS_PER_GROUP, SALTS_PER_BLOCK = 2_000, 4_096


def patterns(capacity: int) -> np.ndarray:
    """All (a, b, c), a >= b >= c >= 0, a > 0, with sum capacity; 0 stands for no document."""
    a = np.arange(1, capacity + 1)
    out = [np.array([[capacity, 0, 0]]), np.array([[x, capacity - x, 0] for x in a[:-1] if x >= capacity - x], dtype=int).reshape(-1, 3)]
    for c in range(1, capacity // 3 + 1):
        b = np.arange(c, (capacity - c) // 2 + 1)
        out.append(np.stack([capacity - c - b, b, np.full_like(b, c)], 1))
    return np.concatenate(out)


def nnls(pat: np.ndarray, hist: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the weighted distance of the lengths used from hist."""
    size = len(hist)
    w = np.sqrt(np.arange(size) / max(1, size - 1)) + 0.05  # long lengths are the hard ones
    w[0] = 0.0
    target = hist * w
    used = pat[:, :3]
    wt = w[used]

    def forward(x):
        return np.bincount(used.ravel(), weights=np.repeat(x, 3), minlength=size) * w

    degree = np.bincount(used.ravel(), minlength=size) + 1.0
    scale = 1.0 / np.maximum((wt**2 * degree[used] * (used > 0)).sum(1), 1e-12)
    x = np.zeros(len(pat))
    y, t = x, 1.0
    for _ in range(rounds):
        g = ((forward(y) - target)[used] * wt).sum(1)
        nx = np.maximum(0.0, y - scale * g)
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = nx + (t - 1) / nt * (nx - x), nx, nt
    return x


def best_fit(hist: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: (pattern, times).  Equal bins are handled together."""
    left = hist.copy()
    open_bins: dict[int, list[list]] = {}
    done: list[tuple[tuple[int, ...], int]] = []
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            room = next((r for r in range(length, capacity) if open_bins.get(r)), None)
            if room is None:
                per = 1
                new, times, n = (length,), n, 0
            else:
                old, have = open_bins[room].pop()
                times = min(have, n)
                if have > times:
                    open_bins[room].append([old, have - times])
                n -= times
                new, per = (*old, length), 1
            rest = capacity - sum(new)
            # With room for the same length again, fold equal bins: k more of it at once.
            if room is None and rest >= length:
                per = min(capacity // length, times)
                whole, extra = divmod(times, per)
                if whole:
                    open_bins.setdefault(capacity - per * length, []).append([(length,) * per, whole])
                if extra:
                    open_bins.setdefault(capacity - extra * length, []).append([(length,) * extra, 1])
                continue
            open_bins.setdefault(rest, []).append([new, times])
    for bins in open_bins.values():
        done += [(tuple(p), k) for p, k in bins]
    return done


def plan(hist: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with their repeat counts; all of hist is used exactly once."""
    hist = hist.astype(np.int64)
    body = hist.copy()
    body[capacity] = 0
    out = [((capacity,), int(hist[capacity]))] if hist[capacity] else []
    simple = best_fit(body, capacity)
    pat = patterns(capacity)[1:]
    times = np.floor(nnls(pat, body.astype(float))).astype(np.int64)
    fitted, left = [], body.copy()
    for k in np.argsort(-times, kind="stable"):
        if times[k] <= 0:
            break
        p = [int(v) for v in pat[k] if v]
        can = min([int(times[k]), *(int(left[v]) // p.count(v) for v in p)])
        if can > 0:
            for v in p:
                left[v] -= can
            fitted.append((tuple(p), can))
    fitted += best_fit(left, capacity)
    return out + min(fitted, simple, key=lambda x: sum(k for _, k in x))


def places(chosen: list[tuple[tuple[int, ...], int]], capacity: int) -> list[np.ndarray]:
    """Per length: rows (first rank, first sequence, offset), sorted by rank."""
    rows: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
    rank, sequence = [0] * (capacity + 1), 0
    for pattern, times in chosen:
        offset = 0
        for length in pattern:
            rows[length].append((rank[length], sequence, offset))
            rank[length] += times
            offset += length
        sequence += times
    return [np.array(r, dtype=np.int64).reshape(-1, 3) for r in rows]


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, path: str | None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) without a shuffle."""
    prepare(docs.sparkSession)
    path = path or default_path()

    def cut(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        from textweave.llm.byte_bpe import buffers, load

        bpe = load(path)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for first, ids, per in bpe.encode(data, offsets):
                ids, at, out = ids.astype("<u4"), 0, ([], [], [], [], [])
                for k, n in enumerate(per.tolist()):
                    own = np.concatenate([ids[at : at + n], end]).tobytes()
                    at += n
                    total = n + 1
                    begin, size, piece = 0, (total - 1) % capacity + 1, 0
                    while begin < total:
                        for column, value in zip(out, (first + k, piece, begin, size, zlib.crc32(own[4 * begin : 4 * (begin + size)]))):
                            column.append(value)
                        begin, size, piece = begin + size, capacity, piece + 1
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out[0])), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every token in one place."""
    parts = table(pieces(docs, id_col, text_col, capacity, end_id, path), "pieces")
    spark = docs.sparkSession
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for length, k in parts.groupBy("length").agg(F.count("*")).collect():  # capacity rows at most
        hist[length] = k
    groups = F.array(*[F.lit(int(max(1, -(-h // ROWS_PER_GROUP)))) for h in hist])  # a frequent length has many
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(groups, F.col("length").cast("int"))))
    sizes = parts.groupBy("length", "salt").agg(F.count("*").alias("n"))
    rows = spark.sparkContext.broadcast(places(plan(hist, capacity), capacity))
    # Prefix sums in two levels: inside blocks of salts, and over the blocks of a length.
    sizes = sizes.withColumn("block", F.floor(F.col("salt") / SALTS_PER_BLOCK))
    earlier = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("length", "block").orderBy("salt").rowsBetween(*earlier)
    over = Window.partitionBy("length").orderBy("block").rowsBetween(*earlier)
    blocks = sizes.groupBy("length", "block").agg(F.sum("n").alias("m")).select("length", "block", F.coalesce(F.sum("m").over(over), F.lit(0)).alias("from"))
    sizes = sizes.select("length", "salt", "block", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("in_block"))
    bases = sizes.join(blocks, ["length", "block"]).select("length", "salt", (F.col("from") + F.col("in_block")).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = parts.withColumn("r", F.row_number().over(within)).join(bases, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("r") - 1).alias("rank"))

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tables = rows.value
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            sequence, offset = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
            for v in np.unique(length):
                own = np.flatnonzero(length == v)
                t = tables[v]
                k = np.searchsorted(t[:, 0], rank[own], side="right") - 1
                sequence[own], offset[own] = t[k, 1] + rank[own] - t[k, 0], t[k, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = T.StructType([*(parts.schema[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)
