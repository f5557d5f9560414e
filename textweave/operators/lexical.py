"""Lexical retrieval: postings, boolean matching and column-weighted BM25.

A corpus has an ``id`` and text columns.  Postings are (id, col, term, at) with the positions of a
term in a column; queries touch only the rows of their own terms (``term IN`` reaches the scan of a
stored index), so what is shuffled is the hits, not the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textweave.functions.text import porter, stem_table, tokens
from textweave.operators.match_query import MatchError, Near, Phrase, Query, all_words, parse

WEIGHTS = {"relpath": 5.0, "title": 10.0, "frontmatter": 4.0, "body": 1.0}
K1, B, FLOOR = 1.2, 0.75, 1e-6
#: Letters at the end of a stem that may differ from its words (bility becomes ble).
STEM_ENDS = 2
#: Words of a set of queries up to which they are sent to every task.
MANY = 10_000


@dataclass
class Index:
    """postings(id, col, term, at) and lengths(id, length), and whether terms are stems.

    docs (with id_col): where they are not stored, a query reads these once, for its own words and the lengths.
    """

    postings: DataFrame
    lengths: DataFrame
    weights: dict[str, float]
    stemmed: bool
    docs: DataFrame | None = None
    id_col: str = ""

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(self.weights)


def postings(docs: DataFrame, id_col: str, columns: tuple[str, ...], stem: bool = False) -> DataFrame:
    cols = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), tokens(F.col(c)).alias("t")) for c in columns])).alias("x")
    rows = docs.select(F.col(id_col).alias("id"), cols).select("id", "x.col", F.posexplode("x.t").alias("pos", "term"))
    rows = rows.groupBy("id", "col", "term").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    if not stem:
        return rows
    stemmed = rows.join(stem_table(rows), "term").groupBy("id", "col", F.col("stem").alias("term"))
    return stemmed.agg(F.sort_array(F.flatten(F.collect_list("at"))).alias("at"))


def lengths(docs: DataFrame, id_col: str, columns: tuple[str, ...]) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), reduce(Column.__add__, [F.size(tokens(F.col(c))) for c in columns]).cast("long").alias("length"))


def build(docs: DataFrame, id_col: str = "relpath", weights: dict[str, float] | None = None, stem: bool = False) -> Index:
    weights = weights or WEIGHTS
    return Index(postings(docs, id_col, tuple(weights), stem), lengths(docs, id_col, tuple(weights)), weights, stem, docs, id_col)


def look(index: Index, exact: list[str], prefixes: list[str] = (), by_id: bool = False) -> tuple[DataFrame, DataFrame]:
    """(id, col, term, at) of the terms given and of those that begin with the prefixes, and (id, length) of all documents.

    Documents that are not stored are read in one pass, of which the places of these terms and the lengths are held
    until the session drops what it caches.  A term may have several rows in a document.  by_id: rows of an id lie together.
    """
    named = lambda term: reduce(Column.__or__, [term.isin(*exact)] * bool(exact) + [F.startswith(term, F.lit(t)) for t in prefixes], F.lit(False))
    if index.docs is None:
        return index.postings.where(named(F.col("term"))), index.lengths
    loose = named
    if index.stemmed:  # a stem without its last STEM_ENDS letters is how every word that has it begins
        begins = sorted({t[: max(0, len(t) - STEM_ENDS)] for t in [*exact, *prefixes]})
        loose = lambda term: reduce(Column.__or__, [term.isin(*exact)] * bool(exact) + [F.startswith(term, F.lit(t)) for t in begins], F.lit(False))
    cols = list(index.weights)
    rows = index.docs.select(F.col(index.id_col).alias("id"), *[tokens(F.col(c)).alias(f"t{k}") for k, c in enumerate(cols)])
    found = []
    for k, c in enumerate(cols):
        t = F.col(f"t{k}")
        at = F.filter(F.transform(t, lambda x, i: F.when(loose(x), i)), lambda i: i.isNotNull())
        found.append(F.struct(F.lit(c).alias("col"), F.filter(t, loose).alias("terms"), at.alias("at")))
    size = reduce(Column.__add__, [F.size(f"t{k}") for k in range(len(cols))]).cast("long")
    held = rows.select("id", size.alias("length"), F.filter(F.array(*found), lambda x: F.size(x["at"]) > 0).alias("found"))
    held = (held.repartition("id") if by_id else held).persist()
    each = held.select("id", F.explode("found").alias("x")).select("id", "x.col", F.explode(F.arrays_zip("x.terms", "x.at")).alias("y"))
    hits = each.select("id", "col", F.col("y.terms").alias("term"), F.array("y.at").alias("at"))
    if index.stemmed:
        words = stem_table(hits).where(named(F.col("stem")))
        hits = hits.join(words, "term").select("id", "col", F.col("stem").alias("term"), "at")
    return hits, held.select("id", "length")


# -- frequencies of leaves --------------------------------------------------------------------------
def _phrases(query: Query) -> list[Phrase]:
    """The phrases of all leaves, those inside NEAR too."""
    return [p for leaf in query.leaves for p in (leaf.phrases if isinstance(leaf, Near) else [leaf]) if p.words]


def _words(phrase: Phrase) -> list[tuple[str, bool]]:
    """(word, is a prefix) of a phrase."""
    last = len(phrase.words) - 1
    return [(w, bool(phrase.prefix) and k == last) for k, w in enumerate(phrase.words)]


def _phrase_at(phrase: Phrase, places: dict[tuple[str, bool], str]) -> Column:
    """Where the phrase begins in a column; places names the array of positions of each word."""
    moved = lambda word, k: F.transform(F.col(places[word]), lambda p: p - k) if k else F.col(places[word])
    out = reduce(F.array_intersect, [moved(word, k) for k, word in enumerate(_words(phrase))])
    if phrase.first:
        out = F.filter(out, lambda p: p == 0)
    return out if phrase.columns is None else F.when(F.col("col").isin(*phrase.columns), out).otherwise(F.slice(out, 1, 0))


def _near_at(near: Near, places: dict[tuple[str, bool], str]) -> Column:
    """The first phrase's positions that have all other phrases within the distance."""
    head, rest = len(near.phrases[0].words), [(_phrase_at(p, places), len(p.words)) for p in near.phrases[1:]]

    def within(p: Column, words: int):
        return lambda q: F.when(q >= p, q - p - head).otherwise(p - q - words) <= near.distance

    return F.filter(_phrase_at(near.phrases[0], places), lambda p: reduce(Column.__and__, [F.exists(at, within(p, n)) for at, n in rest], F.lit(True)))


def _terms(index: Index, query: Query) -> dict[tuple[str, bool], str]:
    """The term of each (word, is a prefix) of the query."""
    words = dict.fromkeys(w for p in _phrases(query) for w in _words(p))
    return {(w, prefix): w if prefix or not index.stemmed else porter(w) for w, prefix in words}


def seen(index: Index, query: Query) -> tuple[DataFrame, DataFrame]:
    """What ``look`` gives for the words of the query."""
    term = _terms(index, query)
    if not term:
        return index.postings.where("false"), index.lengths
    return look(index, sorted({t for (_, prefix), t in term.items() if not prefix}), sorted({t for (_, prefix), t in term.items() if prefix}))


def frequencies(index: Index, query: Query, rows: DataFrame) -> DataFrame:
    """(id, leaf, f): column-weighted frequency of every leaf in every document that has it.

    rows: what ``seen`` gives, one scan for all words of the query; leaves are told apart after it.
    """
    term = _terms(index, query)
    words = list(term)
    if not words:
        return index.lengths.select("id", F.lit(0).alias("leaf"), F.lit(0.0).alias("f")).where("false")
    places = {w: f"at{k}" for k, w in enumerate(words)}
    found = lambda w: F.col("term").startswith(term[w]) if w[1] else F.col("term") == term[w]
    rows = rows.groupBy("id", "col").agg(*[F.flatten(F.collect_list(F.when(found(w), F.col("at")))).alias(name) for w, name in places.items()])
    weight = F.create_map(*[F.lit(x) for c, w in index.weights.items() for x in (c, float(w))])
    leaves = [(k, _near_at(leaf, places) if isinstance(leaf, Near) else _phrase_at(leaf, places)) for k, leaf in enumerate(query.leaves) if isinstance(leaf, Near) or leaf.words]
    each = F.array(*[F.struct(F.lit(k).alias("leaf"), (F.size(at) * F.element_at(weight, F.col("col"))).alias("f")) for k, at in leaves])
    return rows.select("id", F.explode(each).alias("x")).where("x.f > 0").groupBy("id", F.col("x.leaf").alias("leaf")).agg(F.sum("x.f").alias("f"))


def _holds(tree: tuple, found: Column) -> Column:
    if tree[0] == "leaf":
        return F.array_contains(found, tree[1])
    a, b = _holds(tree[1], found), _holds(tree[2], found)
    return a & b if tree[0] == "and" else a | b if tree[0] == "or" else a & ~b


def scored(index: Index, query: Query, found: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(id, score) of the documents that match; lower is better.  found: what ``seen`` gives for a query of these words."""
    rows, sizes = found or seen(index, query)
    f = frequencies(index, query, rows)
    facts = sizes.agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_length"))
    having = f.groupBy("leaf").agg(F.count("*").alias("df")).crossJoin(F.broadcast(facts))  # a row a leaf
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(0.0))
    having = having.select("leaf", "avg_length", F.when(idf <= 0, F.lit(FLOOR)).otherwise(idf).alias("idf"))
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    rows = f.join(F.broadcast(having), "leaf").join(sizes, "id").groupBy("id").agg(F.collect_set("leaf").alias("found"), (-F.sum(part)).alias("score"))
    return rows.where(_holds(query.tree, F.col("found"))).select("id", "score") if query.tree else rows.where("false").select("id", "score")


def ranked(rows: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """The best k of (id, score) with a rank; ties by id."""
    top = rows.withColumn("score", F.round("score", digits)).orderBy("score", "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("score", "id")).cast("long"))


def search(index: Index, text: str, k: int = 8, strict: bool = False, notes: list[str] | None = None) -> DataFrame:
    """(id, score, rank) of the best k.  No hit for all words: once more for any of them.

    tolerant (the default): the words of the text, joined by AND.  strict: the text is an expression of
    the match language; one with a syntax error is retried as a phrase, one with an unknown column has
    no hits.
    """
    if strict:
        try:
            query = parse(text, index.columns)
        except MatchError as e:
            query = Query((), []) if e.kind == "column" else all_phrase(text)
    else:
        query = all_words(text)
    found, known = seen(index, query), _terms(index, query).keys()
    hits = ranked(scored(index, query, found), k)
    words = text.split() if strict else [p.words[0] for p in query.leaves]
    if len(words) > 1 and hits.isEmpty():
        try:
            query = parse(" OR ".join(words), index.columns) if strict else all_words(text, "or")
        except MatchError:
            return hits
        wider = ranked(scored(index, query, found if _terms(index, query).keys() <= known else None), k)
        if not wider.isEmpty():
            (notes if notes is not None else []).append("no document has all words; any word counts")
            return wider
    return hits


def all_phrase(text: str) -> Query:
    """The text as one phrase."""
    q = parse('"' + text.replace('"', "") + '"')
    return q if q.leaves[0].words else Query((), [])


def search_batch(index: Index, queries: DataFrame, k: int = 8) -> DataFrame:
    """(query_id, id, score, rank) for queries(query_id, query), all in one plan; tolerant reading.

    Documents with all words of a query are its hits; where there are none, those with any word.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    if index.stemmed:
        terms = terms.join(stem_table(terms), "term").select("query_id", F.col("stem").alias("term")).distinct()
    wanted = terms.groupBy("query_id").agg(F.count("*").alias("words"))
    weight = F.create_map(*[F.lit(x) for c, w in index.weights.items() for x in (c, float(w))])
    asked = [r.term for r in terms.select("term").distinct().limit(MANY + 1).collect()]
    if len(asked) <= MANY:  # the words of the queries go to every task
        rows, sizes = look(index, sorted(asked), by_id=True)
    else:
        rows, sizes = index.postings.join(terms.select("term").distinct(), "term", "left_semi"), index.lengths
    few = F.broadcast if len(asked) <= MANY else lambda x: x
    f = rows.groupBy("id", "term").agg(F.sum(F.size("at") * F.element_at(weight, F.col("col"))).alias("f"))
    facts = sizes.agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_length"))
    df = f.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(facts))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    df = df.select("term", "avg_length", F.when(idf <= 0, F.lit(FLOOR)).otherwise(idf).alias("idf"))
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    each = f.join(few(df), "term").join(sizes, "id").select("id", "term", part.alias("part"))
    hits = each.join(few(terms), "term").groupBy("query_id", "id").agg(F.round(-F.sum("part"), 9).alias("score"), F.count("*").alias("have")).join(F.broadcast(wanted), "query_id")
    hits = hits.select("query_id", "id", "score", (F.col("have") < F.col("words")).alias("partial"))
    # documents with all words come first, so the best k tell whether there is one; compared as it is, every task sends its best k alone
    best = hits.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("partial", "score", "id"))).where(F.col("place") <= k)
    best = best.withColumn("none", F.min("partial").over(Window.partitionBy("query_id"))).where(F.col("none") | ~F.col("partial"))
    return best.select("query_id", "id", "score", F.col("place").cast("long").alias("rank"))


# -- substring fallback and snippets ------------------------------------------------------------------
def substring_search(docs: DataFrame, text: str, k: int = 8, id_col: str = "relpath", columns: tuple[str, ...] = ("relpath", "title", "body")) -> DataFrame:
    """(id, score, rank): how many words of the query a document contains, wherever in a word."""
    words = [w.lower() for w in text.split()]
    blob = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))
    score = reduce(Column.__add__, [F.contains(blob, F.lit(w)).cast("long") for w in words], F.lit(0).cast("long"))
    rows = docs.select(F.col(id_col).alias("id"), score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))


def best_window(texts: list[str | None], words: list[str], stemmed: bool, size: int = 14) -> str:
    """The window of size tokens, in any of the texts, with most different query words."""
    import re

    wanted = {porter(w) if stemmed else w for w in words}
    best, best_n = "", 0
    from textweave.operators.match_query import fold_words

    for text in texts:
        marks = list(re.finditer(r"[^\W_]+", text or ""))
        keys = ["".join(fold_words(m[0])) for m in marks]
        keys = [porter(x) if stemmed else x for x in keys]
        for i in range(max(1, len(marks) - size + 1) if marks else 0):
            n = len(wanted.intersection(keys[i : i + size]))
            if n > best_n:
                j = min(len(marks), i + size) - 1
                best_n, best = n, (" … " if i else "") + text[marks[i].start() : marks[j].end()] + (" … " if j < len(marks) - 1 else "")
    return best


def snippets(hits: DataFrame, docs: DataFrame, text: str, id_col: str = "relpath", columns: tuple[str, ...] = ("relpath", "title", "frontmatter", "body"), stemmed: bool = False) -> DataFrame:
    """hits(id, ...) with ``snippet``; only the few hit documents are read by Python."""
    from textweave.functions.text import trim
    from textweave.operators.match_query import fold_words

    words = list(fold_words(text))

    @F.pandas_udf("string")
    def pick(*parts: pd.Series) -> pd.Series:
        return pd.Series([best_window(list(row), words, stemmed) for row in zip(*parts)])

    rows = docs.join(F.broadcast(hits.select("id")), docs[id_col] == F.col("id"), "left_semi").select(F.col(id_col).alias("id"), pick(*columns).alias("s"), F.col(columns[-1]).alias("head"))
    return hits.join(rows.select("id", trim(F.when(F.col("s") != "", F.col("s")).otherwise(F.coalesce("head", F.lit("")))).alias("snippet")), "id", "left")
