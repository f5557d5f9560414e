import fnmatch
import re

import pytest
from pyspark.sql import functions as F

from textweave.operators import lint, rules

TYPES = [rules.RecordType("note", "notes", True, ("*draft*",), (r"^\*\*Date:\*\*", "[")), rules.RecordType("contact", "people")]


@pytest.mark.parametrize(
    ("path", "text", "type_"),
    [
        ("notes/a.md", "x", "note"), ("notes/2026/b.md", "x", "note"), ("notes/my-draft.md", "x", None), ("people/x/deep.md", "x", None),
        ("people/y.md", "x", "contact"), ("notes/README.md", "x", None), ("else/z.md", "---\ntype: contact\n---\n", "contact"), ("top.md", "x", None),
    ],
)
def test_classify(spark, path, text, type_):
    df = spark.createDataFrame([(path, text)], "p string, t string")
    assert df.select(rules.classify(F.col("p"), F.col("t"), TYPES)).first()[0] == type_


@pytest.mark.parametrize("glob", ["*.md", "a?c", "[ab]*", "[!a]*", "x/*", "a.b"])
@pytest.mark.parametrize("name", ["a.md", "abc", "bcd", "x/y/z.md", "aXb", "a.b"])
def test_globs(glob, name):
    assert bool(re.search(rules.glob_regex(glob).replace("\\z", "\\Z"), name)) == fnmatch.fnmatchcase(name, glob)


def test_all_findings(spark):
    rows = [
        ("notes/a.md", "# Same\n**Date:** x\n[ok](b.md) [gone](../no.md#x) ![img](pic.md) [out](https://x.y/z.md) [blank]( )", 0.0),
        ("notes/b.md", "# Same\n[[a]] [[A]] [[Missing One|alias]] [[b#anchor]]", 1e9),
        ("notes/c.md", " \n", 1e9),
        ("d.md", "---\nx: 1\nno end", 1e9),
        ("e.md", "---\nx: 1\n---\nno heading here", 1e9),
    ]
    docs = spark.createDataFrame(rows, "path string, text string, mtime double")
    found = [(r.severity, r.check, r.path) for r in lint.lint(docs, 1e9, TYPES).collect()]
    assert found == [
        ("error", "empty-file", "notes/c.md"),
        ("warn", "bad-require-pattern", "notes/a.md"),
        ("warn", "bad-require-pattern", "notes/b.md"),
        ("warn", "dead-link", "notes/a.md"),
        ("warn", "malformed-frontmatter", "d.md"),
        ("warn", "missing-field", "notes/b.md"),
        ("warn", "no-heading", "d.md"),
        ("warn", "no-heading", "e.md"),
        ("info", "dangling-wikilink", "notes/b.md"),
        ("info", "duplicate-title", "notes/a.md"),
        ("info", "duplicate-title", "notes/b.md"),
        ("info", "stale", "notes/a.md"),
    ]
    assert lint.has_errors(lint.lint(docs, 1e9)) and {r.severity: r.n for r in lint.severities(lint.lint(docs, 1e9)).collect()}["error"] == 1


def test_blank_as_python_has_it(spark):
    """Every character of the basic plane alone, and none, against str.strip."""
    from pyspark.sql import functions as F

    texts = [None, "", " \t\n", " x "] + [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000] + ["\U0001f600"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").where(lint.is_blank("text")).select("k").collect()
    assert {r.k for r in rows} == {k for k, t in enumerate(texts) if not (t or "").strip()}


def test_workers_are_handed_few_bytes(spark):
    """Batches are bounded by bytes: long texts do not come ten thousand at a time, in lint and in the queries of the catalogue."""
    import pandas as pd
    from pyspark.sql import functions as F

    from textweave.functions.session import BATCH_BYTES
    from textweave.plans import catalogue

    @F.pandas_udf("long")
    def together(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    long = spark.range(0, 2000, 1, 1).select(F.col("id").cast("string").alias("path"), F.repeat(F.lit("x"), 10_000).alias("text"), F.lit(0.0).alias("mtime"))
    for use in (lambda: lint.lint(long, 0.0), lambda: catalogue.read(spark, "/root/testdata/sf0.001", "documents")):
        try:
            spark.conf.set(key, "256m")
            use()
            assert long.select(F.max(together("text"))).first()[0] <= BATCH_BYTES + 20_000
        finally:
            spark.conf.set(key, before)
