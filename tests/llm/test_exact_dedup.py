import hashlib

import pytest
from pyspark.sql import functions as F

from textweave.llm.exact_dedup import exact_dedup

ROWS = [(1, "a b", "x"), (2, "ab ", "x"), (3, "a\tb\n", "x"), (4, None, "x"), (5, "", "x"), (6, " \x0b", "x"), (7, "other", "x"), (None, "o t h e r", "x"), (8, "é" * 9, "x"), (2, "ab ", "x"), (9, "long " * 300_000, "x"), (10, "long" * 300_000, "x"), (None, None, "x"), (11, "a b", "x")]
GONE = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


def brute(rows):
    groups = {}
    for k, (i, t, _) in enumerate(rows):
        groups.setdefault((t or "").translate(GONE), []).append((-len(t or ""), i is None, i or 0, k))
    return sorted(((i, min(g)[2] if not min(g)[1] else None, len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for i in [rows[x[3]][0] for x in g]), key=repr)


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("files", [1, 3])
def test_against_brute_force(spark, tmp_path, weak, files):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(ROWS, "doc_id long, text string, digest string").repartition(files).write.parquet(path)
    how = {"digest": lambda c: (F.crc32(c.cast("binary")) % 3).cast("string")} if weak else {}
    got = exact_dedup(spark, path, files_per_batch=1 if files > 1 else None, **how).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(ROWS)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)


def test_empty(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(path)
    assert exact_dedup(spark, path).count() == 0


def test_goes_on_from_a_checkpoint(spark, tmp_path):
    """A second run with the checkpoint streams the new file alone, and knows the first one's rows."""
    at, path = str(tmp_path / "state"), str(tmp_path / "docs.parquet")
    spark.createDataFrame([(5, "a b"), (6, "c")], "doc_id long, text string").coalesce(1).write.parquet(path)
    first = sorted(tuple(r)[:4] for r in exact_dedup(spark, path, checkpoint=at).collect())
    assert first == [(5, 5, 1, True), (6, 6, 1, True)]
    spark.createDataFrame([(1, "ab"), (2, " c ")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    got = sorted(tuple(r)[:4] for r in exact_dedup(spark, path, checkpoint=at).collect())
    assert got == [(1, 5, 2, False), (2, 2, 2, True), (5, 5, 2, True), (6, 2, 2, False)]
    import os

    assert sorted(x for x in os.listdir(f"{at}/updates")) == ["batch=0", "batch=1"]


def test_odd_paths_and_columns(spark, tmp_path):
    """A trailing slash, glob characters, and a column named as Spark's own."""
    path = str(tmp_path / "a{b}[c]" / "docs.parquet")
    spark.createDataFrame([(1, "x", 3), (2, "x", 3)], "doc_id long, text string, _metadata int").write.parquet(path)
    from textweave.llm import exact_dedup as module

    assert module._pattern("/p/q*r/") == "/p/q\\*[r]"
    plain = str(tmp_path / "docs.parquet")
    spark.read.parquet(path.replace("{", "\\{").replace("}", "\\}").replace("[", "\\[").replace("]", "\\]")).write.parquet(plain)
    assert sorted(tuple(r)[:4] for r in exact_dedup(spark, plain + "/").collect()) == [(1, 1, 2, True), (2, 1, 2, False)]
