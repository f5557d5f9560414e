import os
import random
import re
import zlib

import numpy as np
import pytest

from textweave.llm import language_id, toxicity
from textweave.llm.common import crc_mod

SF = os.environ.get("TEST_LLM_SF_DIR", "/root/testdata/sf0.01")
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@here
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = r[r.held_out]
    assert len(r) == docs.count() and len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.97 and r.score.between(0, 1).all()


def test_language_edges(spark):
    rows = [(k, ("the quick house and then " if k % 2 else "der schnelle fuchs und dann ") * 3, "en" if k % 2 else "de", 1.0) for k in range(40)]
    rows += [(100, None, "en", 1.0), (101, "", "de", 1.0), (102, "123 !?", None, 1.0), (None, "und dann der fuchs", "de", 1.0), (103, "the house " * 200_000, None, 1.0), (1, rows[1][1], "en", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = language_id.language_id(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(by[k].lang_pred == ("en" if k % 2 else "de") for k in range(40))
    assert all((by[k].lang_pred, by[k].score) == ("und", 0.0) for k in (100, 101, 102)) and by[None].lang_pred == "de" and by[None].held_out and by[103].lang_pred == "en"
    assert language_id.language_id(docs.where("false")).count() == 0
    assert {r.lang_pred for r in language_id.language_id(docs.where("lang is null")).collect()} == {"und"}


def test_features_do_not_cross_texts():
    both, row = language_id.features(["abc", "", "xyz"])
    alone = [language_id.features([t])[0] for t in ("abc", "xyz")]
    assert sorted(both[row == 0].tolist()) == sorted(alone[0].tolist()) and sorted(both[row == 2].tolist()) == sorted(alone[1].tolist())
    text = "".join(np.random.default_rng(1).choice(list("abc de"), 5000))
    old, language_id.SLICE = language_id.SLICE, 100
    for t in (text, "  --" * 200 + text + "!!" * 300 + text, "a" * 450, "a" * 100 + " " * 250 + "bc" * 80):
        parts = np.concatenate([language_id.features([p], [n])[0] for p, n in language_id._parts(t)])
        assert sorted(parts.tolist()) == sorted(language_id.features([t])[0].tolist())
    language_id.SLICE = old


def bucket(gram):
    h = 0
    for ch in gram:
        h = (h * 0x100000001B3 + ord(ch)) * 0x9E3779B97F4A7C15 % (1 << 64)
    return h >> (64 - language_id.BITS)


def grams(text):
    """Buckets of a text's n-grams, one character after the other."""
    t = re.sub(r"[\W\d_]+", " ", text).lower()
    return [bucket(t[k : k + n]) for n in (1, 2, 3) for k in range(len(t) - n + 1) if t[k : k + n] != " "]


def test_language_against_brute_force(spark):
    """Counts, smoothing, prior and posterior recomputed from the texts, whole words of chance."""
    draw = random.Random(8)
    letters = {"aa": "abcdé fgh", "bb": "abx yzüw q", "cc": "mnop ab c"}
    rows = [(k, "".join(draw.choice(letters[x]) for _ in range(draw.randint(3, 80))), x) for k in range(150) for x in [draw.choice(["aa", "aa", "bb", "cc"])]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    logp, prior = {}, {}
    for x in letters:
        n = np.full(1 << language_id.BITS, 0.5)
        for _, t, y in learned:
            if x == y:
                np.add.at(n, grams(t), 1)
        logp[x], prior[x] = np.log(n / n.sum()), np.log(sum(y == x for *_, y in learned) / len(learned))
    for k, t, _ in rows:
        total = {x: prior[x] + logp[x][grams(t)].sum() for x in letters}
        if not any(ch.isalpha() for ch in t):
            assert got[k].lang_pred == "und"
            continue
        want = max(sorted(total), key=total.get)
        mean = {x: v / max(1.0, len(grams(t)) / 30) for x, v in total.items()}
        score = 1 / sum(np.exp(v - mean[want]) for v in mean.values())
        assert got[k].lang_pred == want and abs(got[k].score - score) < 1e-4 and got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2)


@here
def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    r = toxicity.toxicity(docs, labels)
    assert r.count() == docs.count()
    held = r.where("held_out").join(labels, "doc_id").toPandas()
    assert (held.toxic == held.predicted).mean() > 0.95 and held[held.toxic == 0].predicted.mean() < 0.03


def test_folding():
    assert toxicity.words("1d10t IDІOT id​iot ｉｄｉｏｔ") == ["idiot"] * 4
    assert toxicity.fold("call 555-2186 at 10:30") == "call 555-2186 at 10:30"


def test_lexicon(spark):
    lex = toxicity.Lexicon({"idiot$": 3.0, "scum": 2.0}, ["scumble"], 1.0, 10.0, -1.0)
    a = lex.automaton()
    assert lex.total(a, ["an", "idiot", "idiots", "scummy", "scumble", "idiot"]) == 8.0
    assert lex.total(a, []) == 0.0 and toxicity.Lexicon().automaton() is None


def test_toxicity_edges(spark):
    rows = [(k, "plain words here " * 5 + ("you vermin" if k % 3 == 0 else "my friend"), "s", 0) for k in range(120)]
    rows += [(500, None, "s", 0), (501, "", "s", 0), (None, "you v3rmin", "s", 0), (502, "you vermin " * 50_000, "s", 0), (0, rows[0][1], "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)] + [(3, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(by[k].predicted == int(k % 3 == 0) for k in range(120)) and all(0 <= r.score <= 1 for r in got)
    assert by[500].predicted == by[501].predicted == 0 and by[None].predicted == 1 and by[None].held_out
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id % 3 = 0 and doc_id < 120").isEmpty() and kept.where("doc_id < 120").count() == 80
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0
    assert {r.predicted for r in toxicity.toxicity(docs, labels.where("false")).collect()} == {0}


def test_learning_keeps_off_held_out_rows(spark):
    """A word that is toxic in held-out rows only is not learned."""
    ids = spark.range(400).where(crc_mod("id", 5) == 0)
    held = {r.id for r in ids.collect()}
    rows = [(k, "plain text " + ("secretword" if k in held else "vermin" if k % 2 else "fine")) for k in range(400)]
    labels = [(k, int(k in held or k % 2)) for k in range(400)]
    from pyspark.sql import functions as F

    lex = toxicity.learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), F.coalesce(crc_mod("doc_id", 5), F.lit(0)) != 0)
    assert "vermin$" in lex.entries and not any(p.startswith("secr") for p in lex.entries)


def test_toxicity_against_brute_force(spark):
    """Matches, exceptions and the curve recomputed word by word from the learned lexicon; a harmless set phrase is learned."""
    draw = random.Random(3)
    calm = ["river", "house", "green", "walk", "paper", "light", "stone"]
    rows, marks = [], []
    for k in range(400):
        toxic = k % 4 == 0
        t = [draw.choice(calm) for _ in range(draw.randint(5, 30))]
        if toxic:
            t[draw.randrange(len(t))] = draw.choice(["scumbag", "vermin"])
        elif k % 150 == 1:
            t += ["vermin", "control", "office"]
        rows.append((k, " ".join(t)))
        marks.append((k, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    lex = toxicity.learn_lexicon(docs, labels, crc_mod("doc_id", 5) != 0)
    assert "vermin control" in lex.exceptions and not any(x.startswith("scumbag") for x in lex.exceptions)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    for k, text in rows:
        t, total = text.split(), 0.0
        for i, w in enumerate(t):
            weights = [v for p, v in lex.entries.items() if (w == p[:-1] if p.endswith("$") else w.startswith(p))]
            spared = w in lex.exceptions or " ".join(t[i : i + 2]) in lex.exceptions
            total += max(weights, default=0.0) * (not spared)
        score = 1 / (1 + np.exp(-np.clip(lex.slope * total / len(t) ** lex.gamma + lex.bias, -30, 30)))
        assert abs(got[k].score - score) < 1e-9 and got[k].predicted == int(score >= 0.5)
    assert all(got[k].predicted == y for k, y in marks)
