"""Typed records: which type a document has, and what its type requires."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCAFFOLDS = ("_TEMPLATE.md", "README.md")


@dataclass(frozen=True)
class RecordType:
    name: str
    folder: str
    recursive: bool = False
    exclude: tuple[str, ...] = ()
    require: tuple[str, ...] = field(default=())


def glob_regex(glob: str) -> str:
    """A shell pattern as a regular expression over the whole string; ``*`` crosses slashes."""
    out, k = "", 0
    while k < len(glob):
        ch, k = glob[k], k + 1
        if ch == "[" and (end := glob.find("]", k + 1)) > 0:
            body = glob[k:end]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]"
            k = end + 1
        else:
            out += {"*": ".*", "?": "."}.get(ch, re.escape(ch))
    return f"(?s)^(?:{out})\\z"


def folder_type(path: Column, types: list[RecordType]) -> Column:
    """First type, in order, whose folder holds the path; an excluded path has no type."""
    rel = F.translate(path, "\\", "/")
    name = F.regexp_extract(rel, r"([^/]*)\z", 1)
    parent = F.regexp_extract(rel, r"(?s)^(.*)/[^/]*\z", 1)
    out = F.when(name.isin(*SCAFFOLDS), F.lit(None).cast("string"))
    for t in types:
        under = F.startswith(rel, F.lit(t.folder + "/")) if t.recursive else parent == t.folder
        globs = [F.rlike(x, F.lit(glob_regex(g))) for g in t.exclude for x in (name, rel)]
        left_out = reduce(Column.__or__, globs, F.lit(False))
        out = out.when(under, F.when(~left_out, F.lit(t.name)))
    return out


def frontmatter_type(text: Column) -> Column:
    """Value of the ``type:`` line of the leading block, not unquoted; null without one."""
    end = F.locate("\n---", text, 4)
    block = F.when(F.startswith(text, F.lit("---")) & (end > 0), F.substr(text, F.lit(4), end - 4))
    value = F.trim(F.regexp_extract(block, r"(?md)^type:\s*(.+)$", 1))
    return F.when(value != "", value)


def classify(path: Column, text: Column, types: list[RecordType]) -> Column:
    return F.coalesce(frontmatter_type(text), folder_type(path, types))


def java_pattern(pattern: str) -> str:
    """A Python pattern for Java: lines end at \\n only."""
    return "(?md)" + pattern


def missing_fields(docs: DataFrame, types: list[RecordType], path_col: str = "relpath", text_col: str = "text") -> DataFrame:
    """(severity, check, path, message) for required patterns that are not found, or not valid."""
    typed = docs.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"), classify(F.col(path_col), F.col(text_col), types).alias("type"))
    found = []
    for t in types:
        for pattern in t.require:
            try:
                re.compile(pattern)
                ok = F.rlike("text", F.lit(java_pattern(pattern)))
                what = ("missing-field", f"{t.name}: missing required pattern /{pattern}/")
            except re.error:
                ok = F.lit(False)
                what = ("bad-require-pattern", f"{t.name}: invalid require regex /{pattern}/")
            found.append(F.when((F.col("type") == t.name) & ~ok, F.struct(F.lit(what[0]).alias("check"), F.lit(what[1]).alias("message"))))
    if not found:
        return typed.select(F.lit("warn").alias("severity"), F.lit("").alias("check"), "path", F.lit("").alias("message")).where("false")
    each = typed.select("path", F.explode(F.array_compact(F.array(*found))).alias("f"))
    return each.select(F.lit("warn").alias("severity"), "f.check", "path", "f.message")
