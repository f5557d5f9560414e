"""Mixing sources to target weights, in DataFrame operations only.

Shares of the sources' tokens are raised to an exponent below one and normalised.  The exponent is
found by repeated division of [0, 1] (``WAYS`` points a pass, all in one aggregate over the sources):
the largest with at least the target entropy, but never so small that a source repeats more often than
``max_epochs``.  Without a budget, tokens suffice for one whole pass over the source that is boosted
least, so no document is left out; with a budget, sources may get less than a pass.

Weights are realised per source: whole passes, then the beginning of one more pass.  Every pass is a
permutation by hash in blocks (the first four hexadecimal digits), so positions are prefix sums in two
levels, inside a block and over blocks, and no source is one group.  A pass is cut at the last hash that
fits the budget; documents with the same hash (repeated rows) stand or fall together.

Edge cases: tokens are words, one at least (null and empty texts count one); a null source is a source of
its own; null ids are placed by their text; ties share a position; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textweave.llm.common import table

WAYS, PASSES, FEW_SOURCES = 64, 4, 10_000
_NONE = "\x00none"


def word_tokens(text: Column) -> Column:
    """Words, one at least."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(1).cast("long"))


def _source(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(_NONE))


def _hash(epoch: Column, id_col: str, text_col: str, seed: int) -> Column:
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), key).cast("binary"))


def exponent(shares: DataFrame, target: float | None, max_epochs: float) -> float:
    """Exponent for shares(p), rounded to 6 digits; target entropy in nats, None: halfway to uniform."""
    facts = shares.agg(F.count("*"), F.min("p"), F.max("p"), F.sum(-F.col("p") * F.log("p"))).first()
    if not facts[0] or facts[1] == facts[2]:
        return 1.0
    spark, n, low, high = shares.sparkSession, facts[0], facts[1], facts[2]
    natural = facts[3]
    if target is None:
        target = (natural + float(spark.range(1).select(F.log(F.lit(float(n)))).first()[0])) / 2

    def search(good) -> float:
        """Edge between the exponents that are good and those that are not."""
        a, b = 0.0, 1.0
        for _ in range(PASSES):
            step = (b - a) / WAYS
            grid = shares.crossJoin(F.broadcast(spark.range(WAYS + 1).select((F.lit(a) + F.col("id") * F.lit(step)).alias("x"))))
            power = F.pow("p", "x")
            at = grid.groupBy("x").agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("s"))
            at = at.select("x", (F.log("z") - F.col("x") * F.col("s") / F.col("z")).alias("entropy"), F.pow(F.lit(low / high), F.col("x") - 1).alias("epochs"))
            a, b = good(at, a, b)
        return a, b

    def by_entropy(at, a, b):
        best = at.where(F.col("entropy") >= target).agg(F.max("x")).first()[0]
        best = a if best is None else best
        return best, min(b, best + (b - a) / WAYS)

    def by_epochs(at, a, b):
        best = at.where(F.col("epochs") <= max_epochs).agg(F.min("x")).first()[0]
        best = b if best is None else best
        return max(a, best - (b - a) / WAYS), best

    return round(max(search(by_entropy)[0], search(by_epochs)[1]), 6)


def plan(docs: DataFrame, source_col: str = "source", text_col: str = "text", target_entropy: float | None = None, max_epochs: float = 2.0, budget: int | None = None) -> DataFrame:
    """(s, tokens, share, weight, quota, passes, rest) of every source."""
    sums = table(docs.groupBy(_source(source_col).alias("s")).agg(F.sum(word_tokens(F.col(text_col))).alias("tokens")), "sources")
    total = sums.agg(F.sum("tokens").cast("double")).first()[0] or 1.0
    shares = sums.withColumn("p", F.col("tokens") / F.lit(total))
    x = exponent(shares.select("p"), target_entropy, max_epochs)
    facts = shares.agg(F.sum(F.pow("p", F.lit(x))).alias("z"), F.max("p")).first()
    weighted = shares.withColumn("weight", F.pow("p", F.lit(x)) / F.lit(facts[0] or 1.0))
    if budget is None:
        quota = F.floor(F.col("tokens") * F.pow(F.col("p") / F.lit(facts[1] or 1.0), F.lit(x - 1)) + 1e-6)
    else:
        quota = F.floor(F.col("weight") * F.lit(float(budget)) + 1e-6)
    out = weighted.withColumn("quota", quota.cast("long")).withColumn("passes", F.floor(F.col("quota") / F.col("tokens")).cast("int"))
    return table(out.select("s", "tokens", F.col("p").alias("share"), "weight", "quota", "passes", (F.col("quota") - F.col("passes") * F.col("tokens")).alias("rest")), "mixture")


def _side(mixture: DataFrame) -> DataFrame:
    return F.broadcast(mixture) if mixture.count() <= FEW_SOURCES else mixture


def _running(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows(h, n) with ``upto``, the tokens up to and with each hash, in two levels."""
    rows = rows.withColumn("block", F.substring("h", 1, 4))
    inside = Window.partitionBy(*by, "block").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*by, "block").agg(F.sum("n").alias("m")).withColumn("base", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    return rows.withColumn("own", F.sum("n").over(inside)).join(blocks, [*by, "block"]).withColumn("upto", F.col("base") + F.col("own")).drop("own", "base")


def order(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 42, **how) -> DataFrame:
    """(doc_id, source, epoch, n_tokens, position) of every row of the mixture.

    position: tokens of the source's stream up to the end of this row's hash group.
    """
    mixture = plan(docs, source_col, text_col, **how)
    epochs = F.explode(F.sequence(F.lit(1), F.col("passes") + F.when(F.col("rest") > 0, 1).otherwise(0))).alias("epoch")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _source(source_col).alias("s"), word_tokens(F.col(text_col)).alias("n"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("t") if docs.schema[id_col].nullable else F.lit("").alias("t"))
    rows = rows.join(_side(mixture), "s").where("quota > 0").select("doc_id", "source", "s", "n", "t", "passes", "rest", "tokens", epochs)
    key = F.coalesce(F.col("doc_id").cast("string"), F.col("t"))
    rows = rows.withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), key).cast("binary"))).drop("t")
    out = _running(rows, ["s", "epoch"]).where((F.col("epoch") <= F.col("passes")) | (F.col("upto") <= F.col("rest")))
    return out.select("doc_id", "source", F.col("epoch").cast("int").alias("epoch"), F.col("n").alias("n_tokens"), ((F.col("epoch") - 1) * F.col("tokens") + F.col("upto")).cast("long").alias("position"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 42, **how) -> DataFrame:
    """docs, with their own columns, each row as often as the mixture has it.  Texts are not shuffled.

    Only the last pass needs the order of its documents; its cut is one hash a source.
    """
    mixture = plan(docs, source_col, text_col, **how)
    last = F.col("passes") + 1
    rows = docs.select(_source(source_col).alias("s"), word_tokens(F.col(text_col)).alias("n"), F.col(id_col).alias("_i"), F.col(text_col).alias("_t")).join(_side(mixture.select("s", "passes", "rest")), "s").where("rest > 0")
    rows = rows.select("s", "n", "rest", _hash(last, "_i", "_t", seed).alias("h"))
    cuts = _running(rows, ["s"]).where("upto <= rest").groupBy("s").agg(F.max("h").alias("cut"))
    known = table(mixture.join(cuts, "s", "left").select(F.col("s").alias("__tw_s"), F.col("passes").alias("__tw_passes"), F.col("cut").alias("__tw_cut")), "cuts")
    joined = docs.withColumn("__tw_s", _source(source_col)).join(_side(known), "__tw_s")
    more = F.when(_hash(F.col("__tw_passes") + 1, id_col, text_col, seed) <= F.col("__tw_cut"), 1).otherwise(0)
    times = joined.withColumn("__tw_times", F.col("__tw_passes") + more).where("__tw_times > 0")
    return times.withColumn("__tw_epoch", F.explode(F.sequence(F.lit(1), F.col("__tw_times")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def _search_sql(name: str, list_agg: str, test: str, a: str, b: str) -> str:
    grid = f"list_transform(range({WAYS + 1}), lambda k: a + k * ((b - a) / {WAYS}))"
    return f"""{name} AS (SELECT 0 AS i, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b UNION ALL SELECT i + 1, {a}, {b} FROM (
  SELECT i, a, b, {list_agg}(list_filter({grid}, lambda x: {test})) AS best FROM {name}, ps WHERE i < {PASSES}))"""


_Z, _S = "list_sum(list_transform(l, lambda p: pow(p, x)))", "list_sum(list_transform(l, lambda p: pow(p, x) * ln(p)))"
_ENTROPY = f"ln({_Z}) - x * {_S} / {_Z} >= target"
#: The query with its defaults; positions are plain running sums here.
ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(source, chr(1) || 'none') AS s, greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+')))::BIGINT AS n FROM documents),
t AS (SELECT s, sum(n)::BIGINT AS tokens FROM d GROUP BY s), sh AS (SELECT s, tokens, tokens / (SELECT sum(tokens)::DOUBLE FROM t) AS p FROM t),
ps AS (SELECT list(p) AS l, min(p) AS low, max(p) AS high, (sum(-p * ln(p)) + ln(count(*))) / 2 AS target FROM sh),
{_search_sql("e", "list_max", _ENTROPY, "coalesce(best, a)", f"least(b, coalesce(best, a) + (b - a) / {WAYS})")},
{_search_sql("r", "list_min", "pow(low / high, x - 1) <= 2.0", f"greatest(a, coalesce(best, b) - (b - a) / {WAYS})", "coalesce(best, b)")},
x AS (SELECT CASE WHEN low = high THEN 1.0 ELSE round(greatest((SELECT a FROM e WHERE i = {PASSES}), (SELECT b FROM r WHERE i = {PASSES})), 6) END AS x, high FROM ps),
q AS (SELECT s, tokens, floor(tokens * pow(p / high, x - 1) + 1e-6)::BIGINT AS quota FROM sh, x),
m AS (SELECT *, quota // tokens AS passes, quota % tokens AS rest FROM q),
o AS (SELECT d.*, m.tokens, m.passes, m.rest, unnest(range(1, passes + 1 + (rest > 0)::BIGINT)) AS epoch FROM d JOIN m USING (s)),
u AS (SELECT *, sum(n) OVER (PARTITION BY s, epoch ORDER BY md5('42|' || epoch || '|' || doc_id)) AS upto FROM o)
SELECT doc_id, source, epoch::INTEGER AS epoch, n AS n_tokens, ((epoch - 1) * tokens + upto)::BIGINT AS position FROM u WHERE epoch <= passes OR upto <= rest
"""
