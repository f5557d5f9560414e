"""Findings about a corpus of docs(path, text, mtime)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textweave.functions.parse import first_heading
from textweave.functions.session import bounded
from textweave.functions.text import slug
from textweave.operators.rules import RecordType, missing_fields

SEVERITIES = ("error", "warn", "info")
LINK = r"(?<!\!)\[[^\]]*\]\(([^)]+)\)"
WIKILINK = r"\[\[([^\]|#]+)(?:\|[^\]]+)?\]\]"
SPACES = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
NOT_LOCAL = r"(?i)^(?:[a-z]+://|mailto:|#|tel:)"


@F.pandas_udf(T.StringType())
def heading(texts: pd.Series) -> pd.Series:
    return texts.fillna("").map(first_heading)


def is_blank(text: str | Column) -> Column:
    """Whether there is nothing but what Python takes for white space; stops at the first other character."""
    return ~F.rlike(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(f"[^{SPACES}]"))


def finding(rows: DataFrame, severity: str, check: str, message: Column) -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(check).alias("check"), "path", message.alias("message"))


def malformed_frontmatter(text: Column) -> Column:
    """Opens with a fence that no later line closes."""
    return F.startswith(text, F.lit("---")) & ~F.rlike(F.substring(text, 4, 2147483647), F.lit(r"\n---\s*(?:\n|\z)"))


def empty_files(docs: DataFrame) -> DataFrame:
    return finding(docs.where(is_blank("text")), "error", "empty-file", F.lit("file is empty"))


def no_heading(docs: DataFrame) -> DataFrame:
    return finding(docs.where(heading("text") == ""), "warn", "no-heading", F.lit("no heading found"))


def bad_frontmatter(docs: DataFrame) -> DataFrame:
    return finding(docs.where(malformed_frontmatter(F.col("text"))), "warn", "malformed-frontmatter", F.lit("frontmatter is not closed"))


def resolved(folder_of: Column, target: Column) -> Column:
    """Path a relative link leads to; null when it leaves the corpus."""
    parts = F.split(F.concat_ws("/", F.regexp_extract(folder_of, r"^(.*)/[^/]*$", 1), target), "/")
    step = lambda acc, p: (
        F.when((p == "") | (p == "."), acc)
        .when((p == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.size(acc) - 1))
        .otherwise(F.concat(acc, F.array(p)))
    )
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def links(docs: DataFrame) -> DataFrame:
    """(path, target) of every local link to a Markdown file, one row an occurrence."""
    raw = docs.select("path", F.explode(F.regexp_extract_all("text", F.lit(LINK), F.lit(1))).alias("raw"))
    first = F.regexp_extract(F.trim("raw"), r"^(\S+)", 1)
    rows = raw.withColumn("full", first).where((F.col("full") != "") & ~F.rlike("full", F.lit(NOT_LOCAL)))
    rows = rows.withColumn("target", F.regexp_replace("full", "(?s)#.*$", ""))
    return rows.where(F.rlike("target", F.lit(r"(?i)\.(?:md|markdown)\z"))).select("path", "full", resolved(F.col("path"), F.col("target")).alias("target"))


def dead_links(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Links whose target is neither in docs nor in known(path)."""
    there = docs.select(F.col("path").alias("target"))
    there = there.union(known.select("path")) if known is not None else there
    return finding(links(docs).join(there.distinct(), "target", "left_anti"), "warn", "dead-link", F.concat(F.lit("link target not found: "), "full"))


def dangling_wikilinks(docs: DataFrame) -> DataFrame:
    stem = F.lower(F.regexp_replace(F.regexp_extract("path", r"([^/]*)\z", 1), r"(?s)(.)\.[^.]*\z", "$1"))
    stems = docs.select(stem.alias("stem")).distinct()
    rows = docs.select("path", F.explode(F.regexp_extract_all("text", F.lit(WIKILINK), F.lit(1))).alias("raw")).withColumn("name", F.trim("raw"))
    rows = rows.withColumn("slug", slug(F.col("name"))).withColumn("low", F.lower("name"))
    rows = rows.join(stems, rows["slug"] == stems["stem"], "left_anti").join(stems, rows["low"] == stems["stem"], "left_anti")
    return finding(rows, "info", "dangling-wikilink", F.concat(F.lit("no document for [["), "name", F.lit("]]")))


def stale(docs: DataFrame, now: float, days: float = 180) -> DataFrame:
    age = (F.lit(float(now)) - F.col("mtime")) / 86400
    return finding(docs.where(age > days), "info", "stale", F.concat(F.lit("not changed for "), F.floor(age).cast("string"), F.lit(" days")))


def duplicate_titles(titles: DataFrame) -> DataFrame:
    """titles(path, title): one finding for each document that shares its title.

    Counts are combined before the shuffle, so a title in very many documents is one row a task.
    """
    again = titles.where("title <> ''").groupBy("title").agg(F.count("*").alias("n")).where("n > 1")
    return finding(titles.join(again, "title"), "info", "duplicate-title", F.concat(F.lit("title in "), F.col("n").cast("string"), F.lit(" documents: "), "title"))


def lint(docs: DataFrame, now: float, types: list[RecordType] = (), days: float = 180, known: DataFrame | None = None) -> DataFrame:
    """All findings, by severity, check and path.  An empty file has no other finding."""
    bounded(docs.sparkSession)
    full = docs.where(~is_blank("text"))
    parts = [empty_files(docs), no_heading(full), bad_frontmatter(full), dead_links(full, known), dangling_wikilinks(full), stale(full, now, days), duplicate_titles(full.select("path", heading("text").alias("title")))]
    if types:
        parts.append(missing_fields(full, list(types), "path", "text"))
    return in_order(reduce(DataFrame.unionByName, parts))


def in_order(findings: DataFrame) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return findings.orderBy(place, "check", "path")


def severities(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def has_errors(findings: DataFrame) -> bool:
    return not findings.where("severity = 'error'").isEmpty()
