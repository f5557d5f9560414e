import sqlite3

from pyspark.sql import functions as F

from textweave.functions import text as t
from textweave.operators.lexical import best_window

WORDS = "ranking ranked relational ties oscillators caresses ponies hopping falling filing happy sky rational conformably vileli analogously operator feudalism decisiveness hopefulness formality triplicate electricity goodness revival allowance adjustable replacement adoption communism effective probate rate cease controll roll agreed plastered sing conflated troubled hissing fizzed failing a of is by eed bleed oed ion lion".split()


def test_porter_is_sqlites():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(WORDS)))
    stems = {doc: term for term, doc in con.execute("SELECT term, doc FROM v")}
    assert [t.porter(w) for w in WORDS] == [stems[k] for k in range(len(WORDS))]
    assert t.porter("x" * 70 + "ing") == "x" * 70 + "ing"


def test_tokens_trim_slug(spark):
    df = spark.createDataFrame([("Crème_brûlée-42 ½x²  ß", "a " * 200, "--Ab c!d--", "aXaXa"), (None, None, None, None)], "a string, b string, c string, d string")
    r = df.select(t.tokens(F.col("a")), t.trim(F.col("b")), t.slug(F.col("c")), t.occurrences(F.col("d"), F.lit("aX"))).collect()
    assert r[0][0] == ["creme", "brulee", "42", "½x²", "ß"]
    assert len(r[0][1]) <= 222 and r[0][1].endswith(" …") and r[0][2] == "ab-c-d" and r[0][3] == 2
    assert r[1][0] == [] and r[1][1] is None


def test_window():
    words = [f"w{k}" for k in range(40)]
    words[20], words[25] = "fox", "hound"
    s = best_window(["nothing", " ".join(words)], ["fox", "hound"], False)
    assert "fox" in s and "hound" in s and s.startswith(" … ") and len(s.replace("…", "").split()) == 14
    assert best_window([None, "a b"], ["zzz"], False) == ""
