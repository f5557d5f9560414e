"""Language identification: multinomial naive Bayes over hashed character n-grams.

The prior of a language is its share of the rows learned from.  Counts per language and n-gram bucket come from a bounded labelled sample (``per_label`` texts of
each label, taken by id hash); the log-probability matrix (labels x buckets) is broadcast, its size
set by the two parameters alone.  Scoring treats a batch as one sparse matrix: bucket numbers of all
n-grams of all texts, with row pointers, multiplied by the matrix in numpy.  Whole texts are scored; a very long one goes
in pieces that know the two letters before them, so every n-gram counts once.

Letters are lower-cased, every other run of characters becomes one space.

Edge cases: null text or no letter gives ``und`` with score 0; a null label or null id is never
learned from (a null id counts as held out); ties go to the first label in sorted order; with no
training rows at all every prediction is ``und``; an empty table gives an empty result; repeated rows are
scored alike; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweave.llm.common import crc_mod, prepare

GRAMS, BITS = (1, 2, 3), 15
SLICE = 1 << 18
_FOLD = None


def _fold() -> np.ndarray:
    """Lower-cased letter by code point, a space for all else."""
    global _FOLD
    if _FOLD is None:
        out = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _FOLD = out
    return _FOLD


def features(texts: list[str], laps: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all n-grams, and the text each belongs to; n-grams never cross texts.

    laps: how many characters at the beginning of each text (folded) are those of the piece before; their n-grams are left out.
    """
    codes = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    edge = codes == 0
    c = _fold()[codes]
    c[edge] = 0
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = ~((c[1:] == 32) & (c[:-1] == 32))
    c = c[keep].astype(np.uint64)
    row = np.cumsum(c == 0) - 1
    lap = np.array(laps if laps is not None else [0] * len(texts))
    place = np.arange(len(c)) - np.flatnonzero(c == 0)[row] - 1
    old = np.append(lap, 0)[row] - place if lap.any() else None  # characters of the piece before from here on
    out, rows = [], []
    h = np.zeros(len(c), dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        m = len(c) - n + 1
        if m <= 0:
            break
        h = (h[:m] * np.uint64(0x100000001B3) + c[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        if n in GRAMS:
            good = row[:m] == row[n - 1 :]
            good &= c[:m] != 0
            if n == 1:
                good &= c[:m] != 32
            if old is not None:
                good &= old[:m] < n
            out.append((h[:m][good] >> np.uint64(64 - BITS)).astype(np.int32))
            rows.append(row[:m][good])
    return (np.concatenate(out), np.concatenate(rows)) if out else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def _slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about SLICE characters; a longer text stands alone."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= SLICE):
            n += len(texts[j])
            j += 1
        yield i, texts[i:j]
        i = j


def _tail(s: str) -> str:
    """The last two characters of s as they are folded: letters, or a letter and a space (or the space alone)."""
    if s[-1].isalpha():
        return (s[-2] if s[-2:-1].isalpha() else " " * (len(s) > 1)) + s[-1]
    k = len(s) - 1
    while k >= 0 and not s[k].isalpha():
        k -= 1
    return s[k] + " " if k >= 0 else " "


def _parts(text: str) -> list[tuple[str, int]]:
    """A long text in pieces, each with the end of the piece before it, and how many characters that are."""
    out, tail = [], ""
    for k in range(0, max(1, len(text)), SLICE):
        piece = tail + text[k : k + SLICE]
        out.append((piece, len(tail)))
        tail = _tail(piece) if piece else ""
    return out


def fit(docs: DataFrame, learn: Column, label_col: str, text_col: str, id_col: str, per_label: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Sorted labels, their log-probabilities by bucket, from about per_label texts of each, and the logarithms of their shares."""
    prepare(docs.sparkSession)
    rows = docs.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(label_col).count().collect()}  # one row a label
    labels = sorted(map(str, sizes))
    if not labels:
        return [], np.zeros((0, 1 << BITS), dtype=np.float32), np.zeros(0)
    share = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (str(k), min(1.0, per_label / n))])
    dice = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(dice < F.element_at(share, F.col(label_col).cast("string"))).select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((len(labels), 1 << BITS), dtype=np.int64)
        place = {v: k for k, v in enumerate(labels)}
        for batch in batches:
            own = [place[v] for v in batch.column(0).to_pylist()]
            pieces = [(k, *p) for k, t in zip(own, batch.column(1).to_pylist()) for p in _parts(t or "")]
            for i, part in _slices([p[1] for p in pieces]):
                at, row = features(part, [p[2] for p in pieces[i : i + len(part)]])
                which = np.array([p[0] for p in pieces[i : i + len(part)]])
                total += np.bincount(which[row] * (1 << BITS) + at, minlength=total.size).reshape(total.shape)
        a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])], ["label", "bucket", "n"])

    counts = np.zeros((len(labels), 1 << BITS))
    for k, b, n in sample.mapInArrow(count, "label int, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n")).collect():  # labels x buckets at most
        counts[k, b] = n
    smooth = counts + 0.5
    n = np.array([dict((str(k), v) for k, v in sizes.items())[k] for k in labels], dtype=float)
    return labels, np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32), np.log(n / n.sum())


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = 2000, modulus: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; score is the mean-n-gram posterior."""
    remainder = F.coalesce(crc_mod(id_col, modulus), F.lit(held))
    labels, logp, prior = fit(docs, remainder != held, label_col, text_col, id_col, per_label)
    model = docs.sparkSession.sparkContext.broadcast((np.ascontiguousarray(logp.T), prior))

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        matrix, prior = model.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            pred, best = ["und"] * len(texts), [0.0] * len(texts)
            pieces = [(k, *p) for k, t in enumerate(texts) if t and labels for p in _parts(t)]
            total, n = np.tile(prior, (len(texts), 1)), np.zeros(len(texts))
            for i, part in _slices([p[1] for p in pieces]):
                at, row = features(part, [p[2] for p in pieces[i : i + len(part)]])
                if not len(at):
                    continue
                which = np.array([p[0] for p in pieces[i : i + len(part)]])[row]
                n += np.bincount(which, minlength=len(texts))
                for c in range(len(labels)):
                    total[:, c] += np.bincount(which, weights=matrix[at, c], minlength=len(texts))
            for k in np.flatnonzero(n):
                if not any(ch.isalpha() for ch in texts[k]):
                    continue
                mean = total[k] / max(1.0, n[k] / 30)
                p = np.exp(mean - mean.max())
                c = int(np.argmax(total[k]))
                pred[k], best[k] = labels[c], float(p[c] / p.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(best, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), (remainder == held).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(score, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
