import random
import re

from textweave.llm import license_scan as ls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(text):
    w = WORD.findall((text or "").translate(LOW))
    places, labels = [], set()
    for phrase, label in ls.PHRASES.items():
        p = phrase.split()
        hit = [k for k in range(len(w)) if w[k : k + len(p)] == p]
        places += hit
        labels |= {label} if hit else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_scan(spark):
    draw = random.Random(4)
    bits = ["mit", "MIT", "license", "License.", "apache", "general", "public", "É", "x-y", "\n", "the_", "«", "licensé"]
    mit = ls.TEMPLATES["mit"][0]
    edited = mit.replace("free of charge", "at no charge").replace("obtaining", "who gets")
    rows = [(k, " ".join(draw.choice(bits) for _ in range(draw.randint(0, 30)))) for k in range(150)]
    rows += [(500, "intro words " + mit + " outro"), (501, edited), (502, "All rights reserved"), (503, "Licensed under CC BY-SA 4.0."), (504, None), (505, ""), (506, "mit license " * 100_000), (507, mit[:60]), (None, "apache license"), (None, mit), (502, "All rights reserved"), (508, "mit license"), (509, "a" * 500_000)]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, row int, pos int")
    got = ls.license_scan(docs).collect()
    key = lambda r: repr((r[0], r[1]))
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(((i, *brute(t)) for i, t in rows), key=key)
    labels = {}
    for r in got:
        labels.setdefault(r.doc_id, []).append((r.labels, r.score))
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert labels[500] == [("mit", 1.0)] and labels[501][0][0] == "mit" and 0.5 < labels[501][0][1] < 1
    assert labels[502] == [("all-rights-reserved", 1.0)] * 2 and labels[503][0][0] == "cc-by-sa" and labels[507] == [("", 0.0)]
    assert sorted(labels[None]) == [("apache", 1.0), ("mit", 1.0)] and labels[504] == labels[505] == [("", 0.0)]
    assert ls.license_scan(docs.where("false")).count() == 0


def test_notice_repeated_back_to_back(spark):
    rows = [(n, "All rights reserved\n" * n + "end") for n in (1, 2, 3, 7)]
    got = ls.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.labels, r.score) for r in got} == {n: ("all-rights-reserved", 1.0) for n, _ in rows}
