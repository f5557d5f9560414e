import random
import re
from collections import Counter

from textweave.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n, covered = Counter(grams), set()
    for k, g in enumerate(grams):
        if n[g] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    draw = random.Random(1)
    texts = [None, "", " \n ", "a", "a b", "a b c", "a a a a", "x\ny\nx\n \nx\n", "#1 $2 <b>&|*%   ü z", "a b c " * 9, "tail\r\ntail\r\n", "w v " * 200_000]
    texts += [draw.choice([" ", "\n", "\x0b"]).join(draw.choice(["a", "b", "c", "d#", "é"]) for _ in range(draw.randint(0, 40))) for _ in range(200)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[2:7] for r in qr.statistics(df).collect()}
    assert all(got[k] == brute(t) for k, t in enumerate(texts))


def test_covering():
    draw = random.Random(2)
    rows = []
    for k in range(900):
        r = {f: draw.random() for f in qr.FEATURES}
        r["bad"] = int(r["symbol_rate"] > 0.7 and r["n_words"] <= 0.6 or r["upper_rate"] > 0.9)
        rows.append(r)
    rules = qr.sequential_covering(rows)
    wrong = sum(any(all(c.holds(r) for c in rule) for rule in rules) != bool(r["bad"]) for r in rows)
    assert 2 <= len(rules) <= 8 and wrong < 45
    assert qr.sequential_covering([]) == [] and qr.sequential_covering([r | {"bad": 0} for r in rows]) == []


def test_query_shape(spark):
    good = ["alpha beta gamma delta " + " ".join(f"w{k * j % 97}" for j in range(80)) for k in range(1, 60)]
    bad = ["!!! $$$ ### " + " ".join(f"${k * j % 97}#" for j in range(80)) for k in range(1, 60)]
    rows = [(k, t, "e") for k, t in enumerate(good + bad)] + [(None, "no id " * 60, "e"), (900, None, "e"), (901, "", "e"), (0, good[0], "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    labels = spark.createDataFrame([(k, int(k < 59)) for k in range(118)] + [(3, 1), (3, None), (None, 0)], "doc_id long, quality int")
    got = qr.quality_rules(docs, labels).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert len(got) == len(rows) and all(kept[k] for k in range(59)) and not any(kept[k] for k in range(59, 118)) and kept[900] is False
    assert all(r.base_failed for r in got if r.doc_id in (900, 901))
    assert qr.quality_rules(docs.where("false"), labels).count() == 0
    assert {r.rule for r in qr.quality_rules(docs, labels.where("false")).collect()} == {0}
