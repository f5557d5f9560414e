"""Connected groups of 64-bit fingerprints by BK-trees over shards.

A shard holds the nodes that share a key, by which every pair that should link meets: the values of
whole blocks of bits (``families``; within ``radius`` bits, at least ``blocks - radius`` of ``blocks``
blocks agree), or min-hashes.  Only shards with two or more groups go on.  In each, a BK-tree is built
(children keyed by their integer Hamming distance to the parent) and searched along the edges within the
radius; ``agree`` may confirm what the radius allows.

A shard over ``chunk`` nodes is cut into chunks by hash, and its trees travel to the tasks that search
them: all trees together grow with the corpus, so they are never broadcast as a whole.  First every
chunk is searched by itself, with one node (the hub) added that all chunks of the shard share; a large
group of copies is mostly one component after that.  Then the chunks are laid out anew, large
components in chunks of their own, and pairs of chunks are searched, but for two of the same component.
So no task holds more than two chunks whatever the shard's size, a shard with one large component costs
as many units as it has chunks for each chunk of the rest, and no link between components is missed.

A fingerprint is a long, or bytes where 64 bits are too few to tell pairs apart (a multiple of 8).

Out come spanning links only (each unit keeps a union-find), never all pairs of a dense group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.llm.common import connected_components, grown_components, table, tidy

CHUNK, CHUNK_BYTES, FEW, SMALL, MANY, LATER = 2_048, 16 << 20, 200_000, 64, 8, 1 << 16
UNIT = ["key", "c", "role", "f", "g", "node", "fp"]


def masks(radius: int, blocks: int) -> list[int]:
    """The bits of every choice of blocks - radius blocks; choices without a common block come first."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    own = blocks - radius
    order = sorted(combinations(range(blocks), own), key=lambda c: (c[0] % own > 0 or c[-1] - c[0] >= own, c))
    return [sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen) for chosen in order]


def families(fp: Column, radius: int, blocks: int) -> Column:
    """Array of shard keys of a fingerprint, one for each of ``masks``."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(radius, blocks)]
    return F.array(*[F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(signed)])


def _parts(n: Column, size: Column, chunk: int) -> Column:
    """Chunks for n nodes with size bytes of bodies."""
    return F.greatest(F.ceil(n / chunk), F.ceil(size / CHUNK_BYTES), F.lit(1)).cast("int")


def _grouped(ids: DataFrame, known: DataFrame | None) -> DataFrame:
    """ids with g, the component of the node as far as known."""
    if known is None:
        return ids.withColumn("g", F.col("node"))
    return ids.join(known, "node", "left").withColumn("g", F.coalesce("component", "node")).drop("component")


def _search(rows: DataFrame, radius: int, agree: Callable | None, blocks: int | None, settle: Callable | None = None) -> DataFrame:
    """Spanning links (a, b) of the units (key, c) of rows(key, c, role, f, g, node, fp, [body]).

    blocks: keys are ``families``; a pair is then looked at in the first family it shares alone.
    """
    known = masks(radius, blocks) if blocks else []

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        a, b = [], []
        for roles, family, groups, ids, fps, *more in runs(batches):
            plain, earlier = [int.from_bytes(x, "little") if isinstance(x, bytes) else x & 0xFFFFFFFFFFFFFFFF for x in fps], known[: family[0]]

            def check(s: int, t: int) -> bool:
                x = plain[s] ^ plain[t]
                for m in earlier:
                    if not x & m:
                        return False
                return agree is None or agree(more[0][s], more[0][t])

            def late(pairs: list[tuple[int, int]]) -> list[bool]:
                return settle([(more[0][s], more[0][t]) for s, t in pairs])

            up: dict[int, int] = {}  # links leave as stars, which settle in fewer rounds
            for s, t in linked(plain, roles, radius, check, groups, late if settle else None):
                while s in up:
                    s = up[s]
                while t in up:
                    t = up[t]
                up[max(s, t)] = min(s, t)
            for k, root in up.items():
                while root in up:
                    root = up[root]
                a.append(ids[root])
                b.append(ids[k])
            if len(a) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key", "c").sortWithinPartitions("key", "c", "role").mapInArrow(tidy(search), "a long, b long").where("a <> b")


def _chunk_pairs(ids: DataFrame, chunk: int) -> DataFrame:
    """Units (key, c, role, f, g, node, fp) that bring together all nodes of ids(key, f, node, fp, w, g) of different components."""
    per = ids.groupBy("key", "g").agg(F.count("*").alias("n"), F.sum("w").alias("w")).withColumn("p", _parts(F.col("n"), F.col("w"), chunk))
    small = F.col("p") == 1
    shards = per.groupBy("key").agg(
        F.min("g").alias("lo"), F.max("g").alias("hi"),
        F.sum(F.when(small, F.col("n"))).alias("n"), F.sum(F.when(small, F.col("w"))).alias("w"),
        F.collect_list(F.when(~small, F.struct("g", "p"))).alias("large"),
    )
    shards = shards.where("lo < hi").select("key", "large", F.when(F.col("n") > 0, _parts(F.col("n"), F.col("w"), chunk)).otherwise(0).alias("bins"))
    label = lambda large, of, part: F.struct(F.lit(large).alias("large"), of.cast("long").alias("of"), part.cast("int").alias("part"))
    upto = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f))
    spot = F.xxhash64("node", F.lit(13))
    own = F.get(F.filter("large", lambda x: x["g"] == F.col("g")), F.lit(0))
    mine = F.when(own.isNull(), label(0, F.lit(0), F.pmod(spot, F.col("bins")))).otherwise(label(1, F.col("g"), F.pmod(spot, own["p"])))
    bins = upto(F.col("bins"), lambda k: label(0, F.lit(0), k))
    large = F.flatten(F.transform(F.filter("large", lambda x: x["g"] != F.col("g")), lambda x: upto(x["p"], lambda k: label(1, x["g"], k))))
    rows = ids.join(shards, "key").select("key", "f", "node", "fp", "g", mine.alias("mine"), F.explode(F.concat(F.coalesce(bins, F.slice(large, 1, 0)), large)).alias("other"))
    first, last = F.least("mine", "other"), F.greatest("mine", "other")
    role = F.when(F.col("mine") == F.col("other"), 3).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    return rows.select("key", F.xxhash64(first, last).alias("c"), role.alias("role"), *UNIT[3:])


def _keyed(nodes: DataFrame, keys: Column, body: str | None, first: int = 0) -> DataFrame:
    """(key, f, node, fp, w): a row for each shard a node is in; f counts its keys from first."""
    out = nodes.select("node", "fp", F.col("w").cast("long").alias("w") if body else F.lit(0).cast("long").alias("w"), F.posexplode(keys).alias("f", "key"))
    return out.withColumn("f", F.col("f") + first)


def _few(shards: DataFrame) -> DataFrame:
    """Shards for a join: broadcast up to FEW rows of two numbers, beyond that by shuffle."""
    return F.broadcast(shards) if shards.count() <= FEW else shards


def _shards(ids: DataFrame, grouped: bool, body: str | None, chunk: int) -> DataFrame:
    """(key, parts) of the shards with two nodes, or components, at least."""
    size = F.sum("w") if body else F.lit(0)
    if grouped:
        sizes = ids.groupBy("key").agg(F.count("*").alias("n"), size.alias("w"), F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi")
    else:
        sizes = ids.groupBy("key").agg(F.count("*").alias("n"), size.alias("w")).where("n > 1")
    return table(sizes.select("key", _parts(F.col("n"), F.col("w"), chunk).alias("parts")), "shards")


def _wide(ids: DataFrame, sizes: DataFrame) -> DataFrame | None:
    """Rows of ids in shards of several chunks, with parts, written once; None if there are none."""
    wide = sizes.where("parts > 1")
    return None if wide.isEmpty() else table(ids.join(_few(wide), "key"), "wide")


def _chunks(ids: DataFrame, sizes: DataFrame, wide: DataFrame | None) -> DataFrame:
    """Units of one chunk each, of ids(key, f, node, fp, w, g); a wide shard's hub is in all of its chunks."""
    members = ids.join(sizes, "key").withColumn("c", F.pmod(F.xxhash64("node", F.lit(11)), "parts"))
    if wide is not None:
        hubs = wide.groupBy("key").agg(F.first("parts").cast("long").alias("parts"), F.min(F.struct(F.xxhash64("node", "key").alias("h"), "f", "g", "node", "fp")).alias("hub"))
        hubs = hubs.select("key", "hub.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("c"))
        members = members.select("key", *UNIT[3:], "c").unionByName(hubs.select("key", *UNIT[3:], "c"))
    return members.withColumn("role", F.lit(3)).select(*UNIT)


def _near_pairs(rows: DataFrame, radius: int, share: float, close: int) -> DataFrame:
    """(key, a, b, first): near pairs of the units of rows, which are as for ``_search`` (f has the size).

    Units of up to ``SMALL`` nodes give all pairs, with key 0; larger ones give their nodes near to another (a, and
    no b) and one pair for each.  first marks a pair for every node within close bits of another, with the smallest such node if it can be.
    """
    import numpy as np

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for t, edges in whole_units(batches):
            keys, sizes, nodes = (t.column(k).to_numpy() for k in (0, 3, 5))
            words = t.column(6).to_numpy().view(np.uint64)
            size = np.diff(edges)
            hit, partner = np.zeros(len(nodes), dtype=bool), np.full(len(nodes), -1)

            def within(i, j, bits, words=words):
                x, y = words[i], words[j]
                return (np.bitwise_count(x ^ y) <= bits) | (x == 0) | (y == 0)

            def near(i, j, sizes=sizes, nodes=nodes, within=within):
                m, n = sizes[i].astype(np.int64), sizes[j].astype(np.int64)
                return within(i, j, radius) & (np.abs(m - n) <= share * np.maximum(m, n) + 1e-9) & (nodes[i] != nodes[j])

            after = np.repeat(edges[1:], size) - np.arange(len(nodes))  # nodes of the unit from here on
            few = np.flatnonzero(np.repeat(size, size) <= SMALL)
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lag in range(1, SMALL):
                few = few[after[few] > lag]
                at = few[near(few, few + lag)]
                a.append(at)
                b.append(at + lag)
                at = at[within(at, at + lag, close)]
                partner[at + lag] = at
            for k in np.flatnonzero(size > SMALL):
                s, e = int(edges[k]), int(edges[k + 1])
                for i in range(s, e - 1):  # only nodes without a neighbour so far need a look at all others
                    others = i + 1 + np.flatnonzero(~hit[i + 1 : e]) if hit[i] else np.arange(i + 1, e)
                    at = others[near(np.full(len(others), i), others)]
                    if len(at) and not hit[i]:
                        partner[i] = at[0]
                    new = at[~hit[at]]
                    partner[new] = i
                    hit[at] = True
                    hit[i] |= len(at) > 0
            a, b = np.concatenate(a), np.concatenate(b)
            first = partner[b] == a
            own = np.flatnonzero(hit)
            a, b = np.concatenate([a, own]), np.concatenate([b, partner[own]])
            first = np.concatenate([first, np.ones(len(own), bool)])
            if len(a):
                x, y = np.minimum(nodes[a], nodes[b]), np.maximum(nodes[a], nodes[b])
                alone = np.concatenate([np.zeros(len(a), bool), np.ones(len(own), bool)])
                cols = [np.concatenate([np.zeros(len(a), np.int64), keys[own]]), np.concatenate([x, nodes[own]])]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.concatenate([y, nodes[own]]), mask=alone), pa.array(np.concatenate([first, alone[len(a) :]]))], ["key", "a", "b", "first"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(n, "key", "c").sortWithinPartitions("key", "c", "node").mapInArrow(tidy(search), "key long, a long, b long, first boolean")
    return table(found.groupBy("key", "a", "b").agg(F.max("first").alias("first")), "neighbours")


def near_pairs(rows: DataFrame, radius: int, share: float, chunk: int = CHUNK, close: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(a, b, first) and (key, node) of the near ones of rows(key, size, node, fp).

    Near are nodes under a key within the radius whose sizes differ by up to share of the larger; fingerprint zero
    is within any radius.  Every near pair is among (a, b), or has both nodes under a key of (key, node); pairs with
    first, which are within close bits (the radius if not given), connect most of what is near.
    """
    close = radius if close is None else close
    ids = rows.select("key", F.col("size").alias("f"), "node", "fp", F.lit(0).cast("long").alias("w"), F.col("node").alias("g"))
    sizes = _shards(ids, False, None, chunk)
    wide = _wide(ids, sizes)
    found = _near_pairs(_chunks(ids, sizes, wide), radius, share, close)
    if wide is not None:
        # Nodes found under a key are as one component there now: none of them needs another neighbour.
        known = found.where("b IS NULL").select("key", F.col("a").alias("node"), F.lit(0).cast("long").alias("known"))
        left = wide.drop("g", "parts").join(known, ["key", "node"], "left").withColumn("g", F.coalesce("known", "node")).drop("known")
        found = found.union(_near_pairs(_chunk_pairs(left, chunk), radius, share, close))
    pairs = found.where("b IS NOT NULL").groupBy("a", "b").agg(F.max("first").alias("first"))
    return pairs, found.where("b IS NULL").select("key", F.col("a").alias("node")).distinct()


def near_rows(rows: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """(node) of those of rows(key, f, node, fp) that have another within the radius under a key; fingerprint zero is near to all."""
    pairs, large = near_pairs(rows.withColumn("size", F.lit(0)), radius, 1.0, chunk)
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).union(large.select("node")).distinct()


def cluster(nodes: DataFrame, passes: list[Column] | None, radius: int, agree: Callable | None = None, body: str | None = None, chunk: int = CHUNK, blocks: int | None = None) -> DataFrame:
    """(node, component) of those of nodes(node, fp) that link to others; component is a smallest node.

    passes: columns with the array of shard keys; what an earlier pass has connected is not searched again.
    blocks: the passes are ``families``, those without a common block first.
    agree: confirms a pair by their values of the column body; w then has the bytes of body.
    """
    if blocks:
        keys, n, few = families(F.col("fp"), radius, blocks), comb(blocks, radius), blocks // (blocks - radius)
        passes = [F.slice(keys, 1, few), F.slice(keys, few + 1, n - few)]
    rows = [_keyed(nodes, keys, body, few if blocks and k else 0) for k, keys in enumerate(passes)]
    return link_rows(rows, radius, agree, nodes.select("node", F.col(body).alias("body")) if body else None, chunk, blocks)


def link_rows(passes: list[DataFrame], radius: int, agree: Callable | None, bodies: DataFrame | None, chunk: int = CHUNK, blocks: int | None = None, known: DataFrame | None = None, settle: Callable | None = None) -> DataFrame | None:
    """``cluster`` of passes of rows(key, f, node, fp, w), with bodies(node, body), and of known(node, component); None if there are no rows.

    settle: decides lists of pairs of bodies for which agree gives None.
    """
    body = "body" if bodies is not None else None
    full = lambda rows: rows.join(bodies, "node").select(*UNIT, body) if body else rows
    grown = lambda found: table(connected_components(found) if known is None else grown_components(known, found), "groups")
    for plain in passes:
        ids = _grouped(plain, known)
        sizes = _shards(ids, known is not None, body, chunk)
        wide = _wide(ids, sizes)
        found = table(_search(full(_chunks(ids, sizes, wide)), radius, agree, blocks, settle), "links")
        if known is None or not found.isEmpty():
            known = grown(found)
        if wide is not None:
            again = _chunk_pairs(_grouped(wide.drop("g", "parts"), known), chunk)
            found = table(_search(full(again), radius, agree, blocks, settle), "links")
            if not found.isEmpty():
                known = grown(found)
    return known


def whole_units(batches: Iterator) -> Iterator[tuple]:
    """Arrow tables of whole units and the edges of the units in them; the first two columns name a unit."""
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
        if not t.num_rows:
            continue
        key, c = (t.column(k).to_numpy() for k in range(2))
        new = np.flatnonzero((key[1:] != key[:-1]) | (c[1:] != c[:-1])) + 1
        if not len(new):
            held = t
            continue
        last = int(new[-1])
        yield t.slice(0, last), np.concatenate([[0], new])
        held = t.slice(last)
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


def runs(batches: Iterator) -> Iterator[list[list]]:
    """Column lists of each unit, without the first two columns."""
    for t, edges in whole_units(batches):
        whole = [t.column(k).to_pylist() for k in range(2, t.num_columns)]
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield [c[s:e] for c in whole]


class BkTree:
    """Children keyed by integer distance to the parent; fingerprints are Python ints."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        k = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while k:
            d = (self.values[at] ^ value).bit_count()
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = k
                return
            at = nxt

    def near(self, value: int, radius: int) -> Iterator[int]:
        """Indices of all values within the radius."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            kids = self.children[at]
            if len(kids) <= 2 * radius + 1:
                todo += [k for e, k in kids.items() if -radius <= e - d <= radius]
            else:
                todo += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]


class Sets:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def linked(fps: list[int], roles: list[int], radius: int, agree: Callable[[int, int], bool] | None = None, groups: list[int] | None = None, settle: Callable | None = None) -> Iterator[tuple[int, int]]:
    """Spanning links (positions) of a unit; agree confirms a link that the radius allows.

    roles: 1 in the tree, 2 a query, 3 both.  Positions with the same group are connected already.  settle decides
    lists of pairs for which agree gives None, after those that agree itself connects.
    """
    n = len(fps)
    sets, tree, place, seen = Sets(n), BkTree(), [], {}
    for k, g in enumerate(groups or ()):
        sets.join(seen.setdefault(g, k), k)
    trees, queries = [k for k in range(n) if roles[k] & 1], [k for k in range(n) if roles[k] & 2]
    alone = trees != queries
    if alone:
        for k in trees:
            tree.add(fps[k])
            place.append(k)
    later: list[tuple[int, int]] = []
    members = [1] * n
    for k in range(n):
        if sets.find(k) != k:
            members[sets.find(k)] += 1

    def join(a: int, b: int) -> bool:
        a, b = sets.find(a), sets.find(b)
        if a != b:
            members[min(a, b)] += members[max(a, b)]
        return sets.join(a, b)

    def settled() -> Iterator[tuple[int, int]]:
        rest, most = later[:], 4
        later.clear()
        while rest:  # a few pairs of each component in a round, as they may connect what the others ask
            some, left, asked = [], [], {}
            for x, y in rest:
                u, v = sets.find(x), sets.find(y)
                if u != v:
                    if asked.get(u, 0) < most and asked.get(v, 0) < most:
                        asked[u], asked[v] = asked.get(u, 0) + 1, asked.get(v, 0) + 1
                        some.append((x, y))
                    else:
                        left.append((x, y))
            for (x, y), ok in zip(some, settle(some) if some else ()):
                if ok and join(x, y):
                    yield x, y
            rest, most = left, 2 * most

    for k in queries:
        met = set()
        for t in tree.near(fps[k], radius):
            other = place[t]
            root = sets.find(other)
            if root != sets.find(k):
                ok = agree is None or agree(other, k)
                if ok is None and settle and members[root] >= MANY and root not in met:  # likely a group of near copies
                    met.add(root)
                    ok = settle([(other, k)])[0]
                if ok:
                    join(other, k)
                    yield other, k
                elif ok is None and settle:
                    later.append((other, k))
        if len(later) > LATER:
            yield from settled()
        if not alone:
            tree.add(fps[k])
            place.append(k)
    yield from settled()
