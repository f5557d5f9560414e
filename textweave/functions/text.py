"""Text functions: folding, tokens, stems, trimming."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIM = 220


@functools.cache
def accents() -> tuple[str, str]:
    """Latin letters with marks, and their base letters."""
    found = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if unicodedata.normalize("NFD", chr(c)) != chr(c)]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c), *accents())


def tokens(c: Column) -> Column:
    """Array of folded tokens; runs of letters and digits."""
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def trim(c: Column, most: int = TRIM) -> Column:
    """One line of at most most characters; a cut drops the partial word and leaves a mark."""
    flat = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.regexp_replace(F.substring(flat, 1, most), r" [^ ]*$", ""), F.lit(" …"))).otherwise(flat)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of part."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")


# -- Porter -----------------------------------------------------------------------------------------
_VOWELS = "aeiou"
_TWO = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", logi="log", bli="ble", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble")
_THREE = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_FOUR = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou")


def _shape(word: str) -> str:
    """c and v for each letter."""
    out = ""
    for k, ch in enumerate(word):
        out += "v" if ch in _VOWELS or ch == "y" and k and out[-1] == "c" else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and len(word) > 2 and word[-1] not in "wxy"


def _swap(word: str, table: dict[str, str], least: int) -> str:
    end = next((e for e in sorted(table, key=len, reverse=True) if word.endswith(e)), None)
    if end is None:
        return word
    base = word[: -len(end)]
    return base + table[end] if _measure(base) > least else word


@functools.lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """Porter's stem; tokens under 3 or over 64 bytes are left alone."""
    if not 3 <= len(word.encode()) <= 64:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed") and len(word) > 3:
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end):
                base = word[: -len(end)]
                if "v" in _shape(base):
                    word = base
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                        word = word[:-1]
                    elif _measure(word) == 1 and _short_end(word):
                        word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _TWO, 0), _THREE, 0)
    end = next((e for e in _FOUR if word.endswith(e)), None)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _short_end(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def _stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for words in batches:
        yield words.map(porter)


def stem_table(terms: DataFrame, term_col: str = "term") -> DataFrame:
    """(term, stem) of the distinct terms: the stemmer sees each word once, not each occurrence.

    It is marked as nondeterministic, so no filter on stems is pushed below the distinct.
    """
    stem = F.pandas_udf(_stems, "string").asNondeterministic()
    return terms.select(F.col(term_col).alias("term")).distinct().withColumn("stem", stem("term"))
