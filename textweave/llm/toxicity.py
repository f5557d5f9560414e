"""Toxicity: a weighted lexicon matched by Aho-Corasick.

Texts are folded first: compatibility forms and accents of confusable letters, Cyrillic and Greek
look-alikes, and digits or signs that stand for letters inside a word (``1d10t``).  The lexicon holds
whole words and word beginnings with log-odds weights, learned from a bounded labelled sample
(``per_label`` documents a label); exception phrases, of one word or two, cancel a match that begins where
they begin.  They are learned from the same sample: words that begin with an entry, and pairs of words whose
first is matched, that are no more frequent in toxic documents than in others.
The sum of the weights over ``n_words ** gamma`` goes through a logistic curve; gamma and the curve
are fitted on the same sample.  The lexicon has at most ``size`` entries, and as many exceptions of each kind.

Edge cases: null and empty texts score as a text without matches; a null id is never learned from
and counts as held out; repeated label rows count once (the largest label); without labels of both
kinds every score is 0; an empty table gives an empty result; of equal weights the lesser entry comes first;
very long texts are scored whole; further columns are ignored or kept as they are, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.llm.common import crc_mod, prepare

_LOOKS = dict(zip("аеорсухіјѕԁһԛԝӏмкнвтиαερουιντκβγ", "aeopcyxijsdhqwlmkhbtuaepouivtkby"))
_SIGNS = dict(zip("0134579@$!|", "oieastgasii"))
_STEMS = (4, 5, 6)
_FOLD: dict[int, int] = {}
_WORD = re.compile(r"[^\W\d_]+")
_DISGUISED = re.compile(r"[^\W_]*[0-9@$!|][\w@$!|]*")


def _table() -> dict[int, int]:
    """Letters to plain letters: lower case, look-alikes, full width and other compatibility forms."""
    if not _FOLD:
        for c in [*range(0xC0), *range(0x370, 0x530), *range(0x2100, 0x2150), *range(0xFF00, 0xFF5F), *range(0x1D400, 0x1D800)]:
            ch = unicodedata.normalize("NFKC", chr(c)).lower()
            ch = "".join(_LOOKS.get(x, x) for x in ch)
            if len(ch) == 1 and ch != chr(c):
                _FOLD[c] = ord(ch)
        for c in [*range(0x200B, 0x2010), 0xAD, 0xFEFF]:  # invisible characters inside words
            _FOLD[c] = None
    return _FOLD


def _unmask(m: re.Match) -> str:
    """Digits and signs become letters where the token has letters as well."""
    token = m.group()
    letters = sum(ch.isalpha() for ch in token)
    body = token.rstrip("!|")
    if letters < 2 or sum(not ch.isalpha() for ch in body) > letters + 1:
        return token
    return "".join(_SIGNS.get(ch, ch) for ch in body) + token[len(body) :]


def fold(text: str) -> str:
    text = text.translate(_table()).lower()
    return _DISGUISED.sub(_unmask, text) if re.search(r"[0-9@$!|]", text) else text


def words(text: str) -> list[str]:
    return _WORD.findall(fold(text))


@dataclass
class Lexicon:
    """entries: pattern to weight, ``word$`` a whole word, ``stem`` the beginning of one."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    gamma: float = 0.5
    slope: float = 0.0
    bias: float = -30.0

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        found: dict[str, tuple[int, float]] = {}
        for p, w in self.entries.items():
            key = f" {p[:-1]} " if p.endswith("$") else f" {p}"
            found[key] = (len(key), w)
        for p in self.exceptions:
            found[f" {p} "] = (len(p) + 2, None)
        for key, value in found.items():
            a.add_word(key, value)
        if found:
            a.make_automaton()
        return a if found else None

    def holds(self, word: str) -> bool:
        """Whether a match begins at the word."""
        return f"{word}$" in self.entries or any(word[:k] in self.entries for k in _STEMS)

    def total(self, automaton, tokens: list[str]) -> float:
        """Sum over word positions of the heaviest entry that begins there, unless an exception does."""
        if automaton is None or not tokens:
            return 0.0
        best: dict[int, float] = {}
        spared = set()
        for end, (n, w) in automaton.iter(f" {' '.join(tokens)} "):
            at = end - n + 1
            if w is None:
                spared.add(at)
            elif w > best.get(at, 0.0):
                best[at] = w
        return sum(w for at, w in best.items() if at not in spared)


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learn: Column, per_label: int) -> DataFrame:
    """(text, y): at most per_label documents of each label, joined by a broadcast of that many ids."""
    known = labels.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("known_id")).agg(F.max(label_col).alias("y"))
    order = [F.xxhash64(F.col("known_id").cast("string")), F.col("known_id")]
    ids = known.where("y = 1").orderBy(*order).limit(per_label).union(known.where("y = 0").orderBy(*order).limit(2 * per_label))
    return docs.select(F.col(id_col).alias("known_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "known_id").select("text", F.col("y").cast("int").alias("y"))


def _features(batches: Iterator) -> Iterator:
    """Documents of each label that hold a word or a beginning."""
    import pyarrow as pa

    seen = [Counter(), Counter()]

    def out():
        keys = list(seen[0].keys() | seen[1].keys())
        r = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in seen)], ["f", "n0", "n1"])
        for c in seen:
            c.clear()
        return r

    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = set(words(text or ""))
            seen[int(y == 1)].update({f"{w}$" for w in own if len(w) > 2} | {w[:k] for w in own for k in _STEMS if len(w) > k})
            if len(seen[0]) + len(seen[1]) > 400_000:
                yield out()
    yield out()


def learn_lexicon(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = 3000, size: int = 1000, least: int = 3) -> Lexicon:
    prepare(docs.sparkSession)
    sample = _sample(docs, labels, id_col, text_col, label_col, learn, per_label).cache()
    n = {r[0]: r[1] for r in sample.groupBy("y").count().collect()}
    lex = Lexicon()
    if not n.get(0) or not n.get(1):
        sample.unpersist()
        return lex
    counts = sample.mapInArrow(_features, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    weight = F.log(((F.col("n1") + 0.1) / (n[1] + 0.2)) / ((F.col("n0") + 0.1) / (n[0] + 0.2)))
    found = counts.where(F.col("n1") >= least).withColumn("w", weight).where("w > 3.5").orderBy(F.desc(F.col("w") * F.log1p("n1")), "f").limit(4 * size).collect()  # bounded by size
    chosen: dict[str, float] = {}
    whole = {r["f"][:-1]: r for r in found if r["f"].endswith("$")}
    stems = {r["f"]: r for r in found if not r["f"].endswith("$")}
    for r in sorted(found, key=lambda r: (len(r["f"].rstrip("$")), r["f"])):
        base = r["f"].rstrip("$")
        if any(base[:k] in chosen for k in _STEMS if k < len(base) or not r["f"].endswith("$") and k == len(base)):
            continue  # a shorter beginning says it already
        if not r["f"].endswith("$"):
            same = [x for x in whole if x.startswith(base)]
            top = max((whole[x]["n1"] for x in same), default=0)
            if top >= 0.9 * stems[base]["n1"]:
                continue  # one word stands behind it; that word is the entry
        chosen[r["f"]] = float(r["w"])
        if len(chosen) >= size:
            break
    lex.entries = chosen
    starts = [p for p in chosen if not p.endswith("$")]
    if starts:
        begins = F.lit(False)
        for k in _STEMS:
            own = [p for p in starts if len(p) == k]
            if own:
                begins = begins | F.substring("f", 1, k).isin(own)
        spared = counts.where(F.col("f").endswith("$") & begins & (F.col("n0") >= 2) & (F.col("n0") * n[1] >= F.col("n1") * n[0])).orderBy(F.desc("n0"), "f").limit(size).collect()
        lex.exceptions = [r["f"][:-1] for r in spared]

    def pairs(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen = [Counter(), Counter()]
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = words(text or "")
                seen[int(y == 1)].update({f"{a} {b}" for a, b in zip(t, t[1:]) if lex.holds(a)})
        keys = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in seen)], ["f", "n0", "n1"])

    met = sample.mapInArrow(pairs, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    met = met.where((F.col("n0") >= 2) & (F.col("n0") * n[1] >= F.col("n1") * n[0])).orderBy(F.desc("n0"), "f").limit(size)
    lex.exceptions = lex.exceptions + [r["f"] for r in met.collect()]

    def totals(batches: Iterator) -> Iterator:
        import pyarrow as pa

        a = lex.automaton()
        for batch in batches:
            tokens = [words(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([lex.total(a, t) for t in tokens], pa.float64()), pa.array([float(len(t)) for t in tokens], pa.float64())], ["y", "t", "n"])

    rows = np.array(sample.mapInArrow(totals, "y int, t double, n double").collect(), dtype=float)  # bounded by per_label
    sample.unpersist()
    _calibrate(lex, rows)
    return lex


def _calibrate(lex: Lexicon, rows: np.ndarray) -> None:
    """Newton steps for the logistic curve, for each gamma; the likeliest is kept."""
    y = (rows[:, 0] == 1).astype(float)
    best = -np.inf
    for gamma in (0.1, 0.25, 0.5, 1.0):
        s = rows[:, 1] / np.maximum(1.0, rows[:, 2]) ** gamma
        scale = s.max() or 1.0
        x = np.stack([s / scale, np.ones_like(s)], 1)
        b = np.zeros(2)
        ridge = np.diag([1e-3, 1e-3])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ b)
            b += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ b, -30, 30))), 1e-9, 1 - 1e-9)
        fit = float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())
        if fit > best:
            best, lex.gamma, lex.slope, lex.bias = fit, gamma, float(b[0] / scale), float(b[1])


def score(docs: DataFrame, lex: Lexicon, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score", label_col: str = "predicted") -> DataFrame:
    """docs with a score and a predicted label added."""
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(lex)

    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model.value
        a = m.automaton()
        for texts in batches:
            out = []
            for t in texts:
                tokens = words(t) if t else []
                z = m.slope * m.total(a, tokens) / max(1, len(tokens)) ** m.gamma + m.bias
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pd.Series(out, dtype="float64")

    rate.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    rate = F.pandas_udf(rate, "double")
    return docs.withColumn(score_col, rate(F.col(text_col))).withColumn(label_col, (F.col(score_col) >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, held: int = 0, **how) -> DataFrame:
    """docs, with their own columns, without the rows that score 0.5 or more."""
    lex = learn_lexicon(docs, labels, F.coalesce(crc_mod(id_col, modulus), F.lit(held)) != held, id_col, text_col, **how)
    return score(docs, lex, id_col, text_col, "__tw_score", "__tw_toxic").where("__tw_toxic = 0").select(*[F.col(f"`{c}`") for c in docs.columns])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, held: int = 0, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    lex = learn_lexicon(docs, labels, F.coalesce(crc_mod(id_col, modulus), F.lit(held)) != held, id_col, text_col, **how)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(crc_mod(id_col, modulus), F.lit(held)) == held).alias("held_out"), F.col(text_col).alias("text"))
    return score(rows, lex, "doc_id", "text").select("doc_id", "held_out", "score", "predicted")
