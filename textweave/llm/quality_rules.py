"""Quality rules: statistics of a text, and a learned decision list over them.

All that touches documents is built from SQL functions.  Statistics of at most ``max_rows`` labelled
documents (numbers, not texts) come to the driver, where sequential covering learns an ordered list:
a rule for the low-quality class is grown by FOIL gain, one threshold condition at a time, on two
thirds of the rows, pruned on the rest, and what it covers is taken away, until a rule would no
longer be precise.  The list becomes one ordered conditional expression.

Words are runs of ``[^\\x20\\x09-\\x0D]``.  Repeats are told by 64-bit hashes of three words.

Edge cases: null text has no words, so it fails the base rule (under 50 words) and is not kept;
null ids are scored but never learned from; repeated label rows count once; without labels of both
kinds the learned list is empty and the base rule decides alone; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANK = " \t\n\x0b\x0c\r"
FEATURES = ("n_words", "mean_word", "symbol_rate", "upper_rate", "digit_rate", "stop_rate", "dup_line_rate", "repeat_rate", "bang_rate", "distinct_rate")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the base counts and FEATURES added, no shuffle, each text handled by itself."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    flat = F.translate(text, _BLANK, " " * len(_BLANK))
    out = docs.withColumn("_w", F.filter(F.split(flat, " "), lambda x: x != ""))
    out = out.withColumn("n_words", F.size("_w").cast("long"))
    gram = lambda i: F.xxhash64(F.element_at("_w", i), F.element_at("_w", i + 1), F.element_at("_w", i + 2))
    grams = F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(1), (F.col("n_words") - 2).cast("int")), lambda i: F.struct(gram(i).alias("h"), i.alias("p")))).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))
    out = out.withColumn("_g", F.sort_array(grams))
    # Equal windows are neighbours now; both of a pair are marked.
    one = lambda s: F.zip_with(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])))
    out = out.withColumn("_p", F.array_distinct(F.flatten(F.filter(one(F.col("_g")), lambda x: x.isNotNull()))))
    covered = F.size(F.array_union(F.array_union("_p", F.transform("_p", lambda x: x + 1)), F.transform("_p", lambda x: x + 2)))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, _BLANK, "") != "")
    out = out.withColumn("_l", lines)
    size = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    out = out.select(
        *docs.columns,
        "n_words",
        F.length(F.translate(text, _BLANK, "")).cast("long").alias("word_chars"),
        size("#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("_l").alias("_n_lines"),
        F.size(F.array_distinct("_w")).alias("_distinct"),
        size("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("_upper"),
        size("0123456789").alias("_digits"),
        size("!").alias("_bangs"),
        F.size(F.filter("_w", lambda x: F.length(x) <= 3)).alias("_short"),
    )
    rate = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return out.select(
        *docs.columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rate("word_chars", "n_words").alias("mean_word"), rate("n_symbols", "word_chars").alias("symbol_rate"), rate("_upper", "word_chars").alias("upper_rate"),
        rate("_digits", "word_chars").alias("digit_rate"), rate("_short", "n_words").alias("stop_rate"), rate("n_dup_lines", "_n_lines").alias("dup_line_rate"),
        rate("n_repeat_words", "n_words").alias("repeat_rate"), rate("_bangs", "n_words").alias("bang_rate"), rate("_distinct", "n_words").alias("distinct_rate"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        c, t = F.col(self.feature), F.lit(float(self.threshold))
        return c > t if self.above else c <= t


def _thresholds(rows: list, feature: str, most: int = 24) -> list[float]:
    """Midpoints between different values, evenly spaced in rank."""
    values = sorted({r[feature] for r in rows})
    step = max(1, len(values) // most)
    return [(values[k - 1] + values[k]) / 2 for k in range(step, len(values), step)]


def _grow(rows: list, most: int) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < most:
        pos = sum(r["bad"] for r in rows)
        if pos in (0, len(rows)):
            break
        base, best, gain = math.log2(pos / len(rows)), None, 1e-9
        for f in FEATURES:
            order = sorted((r[f], r["bad"]) for r in rows)
            cuts, k, p = _thresholds(rows, f), 0, 0
            for t in cuts:
                while k < len(order) and order[k][0] <= t:
                    p += order[k][1]
                    k += 1
                for above, n1, n in ((False, p, k), (True, pos - p, len(order) - k)):
                    if n1 and n1 * (math.log2(n1 / n) - base) > gain:
                        best, gain = Condition(f, above, t), n1 * (math.log2(n1 / n) - base)
        if best is None:
            break
        rule.append(best)
        rows = [r for r in rows if best.holds(r)]
    return rule


def _worth(rule: list[Condition], rows: list) -> tuple[float, int]:
    hit = [r["bad"] for r in rows if all(c.holds(r) for c in rule)]
    return (2 * sum(hit) - len(hit)) / max(1, len(hit)), len(hit)


def sequential_covering(rows: list, most_rules: int = 12, most_conditions: int = 4, precise: float = 0.8) -> list[list[Condition]]:
    """Ordered rules for rows with bad = 1."""
    rules: list[list[Condition]] = []
    while len(rules) < most_rules:
        grow, prune = [r for k, r in enumerate(rows) if k % 3], [r for k, r in enumerate(rows) if k % 3 == 0]
        if not any(r["bad"] for r in grow):
            break
        rule = _grow(grow, most_conditions)
        while len(rule) > 1 and _worth(rule[:-1], prune)[0] >= _worth(rule, prune)[0]:
            rule = rule[:-1]
        hit = [r for r in rows if all(c.holds(r) for c in rule)]
        good = sum(r["bad"] for r in hit)
        if not rule or good < 5 or good < precise * len(hit):
            break
        rules.append(rule)
        rows = [r for r in rows if not all(c.holds(r) for c in rule)]
    return rules


def as_column(rules: list[list[Condition]]) -> Column:
    """The list as an ordered conditional: the number of the first rule that holds, else 0."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 6000) -> list[list[Condition]]:
    """Rules for label 0, from at most max_rows labelled documents, half of each label if there are."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("known_id")).agg(F.max(label_col).alias("y"))
    order = [F.xxhash64(F.col("known_id").cast("string")), F.col("known_id")]
    ids = known.where("y = 0").orderBy(*order).limit(max_rows // 2).union(known.where("y <> 0").orderBy(*order).limit(max_rows // 2))
    chosen = docs.select(F.col(id_col).alias("known_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "known_id")
    rows = statistics(chosen).select("known_id", F.when(F.col("y") == 0, 1).otherwise(0).alias("bad"), *FEATURES)
    found = sorted((r.asDict() for r in rows.collect()), key=lambda r: r["known_id"])  # bounded by max_rows
    return sequential_covering(found)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule, kept)."""
    rules = learn(docs, labels, id_col, text_col, **how)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = statistics(rows).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).withColumn("rule", as_column(rules))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"))
