import random

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from textweave.llm import hamming
from textweave.llm.common import connected_components
from textweave.llm.hamming import BkTree, Sets, cluster, families, near_rows
from textweave.llm.simhash_dedup import near_components, simhash_components, simhash_dedup

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def fingerprint(text):
    words = [w.decode() for w in (text or "").translate(LOW).encode().split()]
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, fps):
    sets = Sets(len(fps))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                sets.join(i, j)
    low = {}
    for k, i in enumerate(ids):
        if i is not None:
            r = sets.find(k)
            low[r] = min(low.get(r, i), i)
    return [low.get(sets.find(k)) for k in range(len(fps))]


def test_components(spark):
    draw = random.Random(5)
    words = [f"w{k}" for k in range(50)] + ["Ünï", "É", "x" * 40]
    base = [" ".join(draw.choice(words) for _ in range(400)) for _ in range(12)]
    rows = []
    for k in range(150):
        w = draw.choice(base).split()
        for _ in range(draw.randint(0, 2)):
            w[draw.randrange(len(w))] = "new"
        rows.append((k, draw.choice([" ", "\n", "\t "]).join(w)))
    rows += [(200, None), (201, ""), (202, " \n\x0b"), (203, "One"), (204, "one\ntwo"), (None, "one two"), (3, rows[3][1]), (3, rows[3][1]), (None, None), (205, " "), (206, "long text " * 200_000)]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, fp string, component string")
    fps = [fingerprint(t) for _, t in rows]
    want = sorted(((i is None, i or 0, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, components([i for i, _ in rows], fps))), key=repr)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash_components(docs).collect()), key=repr)
    assert got == want
    assert simhash_components(docs.where("false")).count() == 0


def near_groups(rows, similarity=0.8):
    """Over all pairs: the smallest id of each row's group."""
    grams = []
    for _, t in rows:
        w = (t or "").translate(LOW).encode().split()
        grams.append({b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    sets = Sets(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            a, b = grams[i], grams[j]
            if a == b or len(a & b) >= similarity * len(a | b):
                sets.join(i, j)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            r = sets.find(k)
            low[r] = min(low.get(r, i), i)
    return [low.get(sets.find(k)) for k in range(len(rows))]


@pytest.mark.parametrize("chunk", [8, 2048])
def test_near_copies(spark, monkeypatch, chunk):
    """Edits, reorderings and one large group; small chunks cut the shards into many units."""
    monkeypatch.setattr(hamming, "CHUNK", chunk)
    monkeypatch.setattr(hamming.cluster, "__defaults__", (None, None, chunk, None))
    draw = random.Random(8)
    words = [f"w{k}" for k in range(300)] + ["Ünï", "É"]
    base = [[draw.choice(words) for _ in range(draw.choice([30, 80, 300]))] for _ in range(10)]
    rows = []
    for k in range(220):
        w = list(base[0] if k % 3 == 0 else draw.choice(base))
        for _ in range(draw.randint(0, 1 + len(w) // 60)):
            w[draw.randrange(len(w))] = draw.choice(words)
        rows.append((k, draw.choice([" ", "\n", "\t "]).join(w)))
    rows += [(300, None), (301, ""), (302, " \n"), (303, "One"), (304, "one\ntwo"), (None, "one two"), (None, None), (305, "one"), (3, rows[3][1]), (3, rows[3][1]), (306, "long text " * 100_000)]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, node string, component string")
    want = near_groups(rows)
    got = sorted(((r.id is None, r.id or 0, r.component_id) for r in near_components(docs).collect()), key=repr)
    assert got == sorted(((i is None, i or 0, c) for (i, _), c in zip(rows, want)), key=repr)
    kept = simhash_dedup(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} - {None} == {i for (i, _), c in zip(rows, want) if i == c and i is not None}
    assert simhash_dedup(docs.where("false")).count() == 0


def test_bk_tree():
    rng = np.random.default_rng(1)
    centre = int(rng.integers(0, 1 << 62))
    values = [centre ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for n in rng.integers(0, 6, 300)]
    tree = BkTree()
    for v in values:
        tree.add(v)
    for q in values[:40]:
        assert sorted(tree.near(q, 2)) == [k for k, v in enumerate(values) if (v ^ q).bit_count() <= 2]
    assert list(BkTree().near(1, 2)) == []


@pytest.mark.parametrize("chunk", [4, 2048])
def test_links_with_small_chunks(spark, chunk):
    """One shard cut into many units gives the same components."""
    rng = np.random.default_rng(2)
    values = sorted({(7 << 40) ^ sum(1 << int(b) for b in rng.choice(20, 3, replace=False)) for _ in range(60)} | {int(x) for x in rng.integers(0, 1 << 62, 50)})
    nodes = spark.createDataFrame([(v, v) for v in values], "node long, fp long")
    got = {r.node: r.component for r in cluster(nodes, None, 2, chunk=chunk, blocks=4).collect()}
    some = [v for v in values if v]  # zero is near to all there
    near = {v for v in some if any(v != x and (v ^ x).bit_count() <= 2 for x in some)}
    keyed = nodes.where("fp <> 0").select("node", "fp", F.posexplode(families(F.col("fp"), 2, 4)).alias("f", "key"))
    assert {r.node for r in near_rows(keyed, 2, chunk).collect()} == near
    want = components(values, values)
    assert [got.get(v, v) for v in values] == want


def test_connected_components(spark):
    draw = random.Random(3)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)] + [(2000, k) for k in range(2001, 2100)]
    sets = Sets(2200)
    for a, b in pairs:
        sets.join(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: sets.find(x) for a, b in pairs if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_row_of_a_group_stays(spark):
    """Repeated ids with different texts, full repeats and null ids."""
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(1, a), (2, a + " more"), (2, b), (3, b + " more"), (4, "alone"), (4, "alone"), (None, a), (None, "null id")]
    got = simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, a), (2, b), (4, "alone"), (0, "null id")])
