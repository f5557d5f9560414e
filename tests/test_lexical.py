import math
import sqlite3

import pytest

from textweave.functions.text import stem_table
from textweave.operators import lexical as lx
from textweave.operators.match_query import MatchError, parse

ROWS = [
    ("a/garden.md", "Garden plan", "", "soil water and seeds. the fox sleeps"),
    ("b/notes.md", "Notes", "topic: garden", "the fox and the hound run; water, water"),
    ("c/river.md", "River walk", "", "water flows past the old garden wall"),
    ("d/empty.md", "", "", ""),
    ("e/ranks.md", "Ranking", "", "results are ranked by score"),
    ("f/cafe.md", "Café", "", "résumé of a hound"),
    ("g/deep.md", "Deep", "", "fox one two three four hound"),
]
COLS = "relpath string, title string, frontmatter string, body string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, COLS).cache()


@pytest.fixture(scope="module")
def index(docs):
    ix = lx.build(docs, "relpath", stem=True)
    return lx.Index(ix.postings.cache(), ix.lengths.cache(), ix.weights, True)


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE docs USING fts5(relpath, title, frontmatter, body, tokenize='porter unicode61')")
    con.executemany("INSERT INTO docs VALUES (?, ?, ?, ?)", ROWS)
    return con


EXPRESSIONS = ["water", "fox hound", "fox AND hound", "fox OR garden", "water NOT garden", '"the fox"', "gard*", "title : garden", "{title frontmatter} : garden", "- body : garden", "^the", "NEAR(fox hound, 3)", "NEAR(fox hound, 4)", "(fox OR soil) AND water", "ranking", "resume", '"fox" + sleeps', '"the" OR wall', "score NOT results OR fox"]


@pytest.mark.parametrize("text", EXPRESSIONS)
def test_scores_are_fts5s(index, fts, text):
    want = dict(fts.execute("SELECT relpath, bm25(docs, 5.0, 10.0, 4.0, 1.0) FROM docs WHERE docs MATCH ?", (text,)))
    got = {r.id: r.score for r in lx.scored(index, parse(text, index.columns)).collect()}
    assert got.keys() == want.keys()
    if not text.startswith(("^", "NEAR")):
        assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in want)


@pytest.mark.parametrize(("text", "kind"), [("opt-in", "column"), ("what?", "syntax"), ("fox AND", "syntax"), ("(", "syntax"), ("", "syntax"), ("a.md", "syntax"), ("it's", "syntax"), ("nope : x", "column"), ("(fox OR soil) water", "syntax"), ("water (fox)", "syntax")])
def test_errors(text, kind):
    with pytest.raises(MatchError) as e:
        parse(text, ("relpath", "title", "frontmatter", "body"))
    assert e.value.kind == kind


def test_search_broadens_once(index):
    notes = []
    assert {r.id for r in lx.search(index, "soil flows", notes=notes).collect()} == {"a/garden.md", "c/river.md"} and notes
    assert [r.rank for r in lx.search(index, "water").collect()] == [1, 2, 3]
    assert lx.search(index, "nowhere").isEmpty() and lx.search(index, "?!").isEmpty()
    assert {r.id for r in lx.search(index, "fox-hound").collect()} == {"b/notes.md", "g/deep.md"}


def test_strict(index):
    assert lx.search(index, "opt-in water", strict=True).isEmpty()
    assert {r.id for r in lx.search(index, "the fox sleeps?", strict=True).collect()} == {"a/garden.md"}


def test_batch_agrees_with_single(spark, index):
    queries = spark.createDataFrame([(1, "water garden"), (2, "soil flows"), (3, "none here at all zzz"), (4, "")], "query_id long, query string")
    got = lx.search_batch(index, queries, 8).collect()
    for n, text in ((1, "water garden"), (2, "soil flows")):
        want = [(r.id, r.rank) for r in lx.search(index, text).collect()]
        assert sorted((r.id, r.rank) for r in got if r.query_id == n) == sorted(want)


def test_substring(docs):
    r = lx.substring_search(docs, "gard ater ater").collect()
    assert r[0].id in ("a/garden.md", "c/river.md") and r[0].score == 3 and all(r[k].score >= r[k + 1].score for k in range(len(r) - 1))


def test_snippets(docs, index):
    hits = lx.search(index, "fox sleeps")
    rows = {r.id: r.snippet for r in lx.snippets(hits, docs, "fox sleeps", stemmed=True).collect()}
    assert "fox sleeps" in rows["a/garden.md"]


def test_stemmer_sees_distinct_terms(spark):
    """Each word once, also where a query asks for one stem."""
    docs = spark.createDataFrame([(k, "ranking ranked ranks ranking") for k in range(50)], "id long, body string")
    rows = docs.selectExpr("explode(split(body, ' ')) AS term")

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    text = plan(stem_table(rows).where("stem = 'rank'"))
    assert text.index("stem") < text.index("Aggregate") and "Filter" not in text[text.index("Aggregate") :]
    ix = lx.build(docs, "id", {"body": 1.0}, stem=True)
    assert {(r.id, tuple(r["at"])) for r in ix.postings.where("term = 'rank'").collect()} == {(k, (0, 1, 2, 3)) for k in range(50)}


@pytest.mark.parametrize("stem", [False, True])
def test_one_pass_gives_the_same(spark, stem):
    """An index that is not stored reads documents for the words of a query alone; results are those of all postings, repeated ids too."""
    docs = spark.createDataFrame([*ROWS, ROWS[0], ("h/ability.md", "Abilities", None, "ability able fox"), (None, "fox", "", "fox hound")], COLS)
    live = lx.build(docs, "relpath", stem=stem)
    whole = lx.Index(live.postings, live.lengths, live.weights, stem)
    for text in ("fox OR garden", '"the fox"', "gard*", "title : garden", "NEAR(fox hound, 3)", "ranking OR ability", "nosuch", "a*"):
        a, b = (sorted((str(r.id), round(r.score, 9)) for r in lx.scored(ix, parse(text, ix.columns)).collect()) for ix in (live, whole))
        assert a == b, text
    asked = spark.createDataFrame([(1, "fox hound"), (2, "fox nosuch"), (3, "nosuch"), (4, "ranking wall abilities")], "query_id long, query string")
    a, b = (sorted(map(repr, lx.search_batch(ix, asked, 3).collect())) for ix in (live, whole))
    assert a == b and a


def test_documents_are_read_once(spark):
    """Two readings of a query, its frequencies and the lengths come from one pass."""
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    docs = spark.createDataFrame(ROWS, COLS).select("relpath", counted("body").alias("body"))
    assert {r.id for r in lx.search(lx.build(docs, "relpath", {"body": 1.0}), "water nosuch").collect()} == {"a/garden.md", "b/notes.md", "c/river.md"}
    assert seen.value == len(ROWS)


def test_only_words_near_a_stem_are_stemmed(spark, docs):
    rows, sizes = lx.look(lx.build(docs, "relpath", stem=True), ["rank"])
    assert {r.id for r in rows.collect()} == {"e/ranks.md"} and sizes.count() == len(ROWS)
    assert "regexp_extract_all" not in lx.stem_table(rows)._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]


def test_words_begin_as_their_stems(spark):
    from textweave.functions.text import _FOUR, _THREE, _TWO, porter

    ends = ["", "s", "es", "ed", "ing", "y", "ies", "sses", "eed", "e", "ll", "ation", "bility", "ability", "ency", "ancy", "ivity", "ality", "logy", "ably", "ently", "ously", "entli", *_TWO, *_THREE, *_FOUR]
    for base in ("a", "be", "cat", "hopp", "fill", "relat", "triplic", "conform", "defens", "cycl", "y", "sky", "oxid", "xa"):
        for one in ends:
            for two in ends:
                word = base + one + two
                stem = porter(word)
                assert word.startswith(stem[: max(0, len(stem) - lx.STEM_ENDS)]), word
