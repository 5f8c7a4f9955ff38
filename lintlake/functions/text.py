"""Measures of text as Spark columns, all inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = {"Nuclear": 3, "Spicy": 2, "Mild": 1}


def occurrences(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("long")


def occurrences_of(text: Column, literals: list[str]) -> Column:
    total = occurrences(text, literals[0])
    for literal in literals[1:]:
        total = total + occurrences(text, literal)
    return total


def line_count(text: Column) -> Column:
    """Lines as a reader of lines sees them: a final newline opens no further one."""
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (newlines + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)).cast("long")


def split_lines(text: Column) -> Column:
    """The lines of a text, without carriage returns before their ends."""
    parts = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n")
    return F.when(text.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).when(text == "", F.array().cast("array<string>")).otherwise(parts)


def trimmed(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def contains_any(text: Column, literals: list[str]) -> Column:
    out = text.contains(literals[0])
    for literal in literals[1:]:
        out = out | text.contains(literal)
    return out


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def parent_directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def severity_name(raw: Column) -> Column:
    """Nuclear, Spicy or Mild whatever the case and outer spaces; null for any other."""
    plain = F.initcap(F.lower(F.trim(raw)))
    return F.when(plain.isin(*SEVERITIES), plain)


def severity_rank(severity: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in SEVERITIES.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def progress_bar(score: Column, width: int = 20) -> Column:
    full = F.greatest(F.lit(0), F.least(F.lit(width), (score / 100 * width).cast("int")))
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def language(raw: Column) -> Column:
    """zh-CN or en-US for the spellings in use; other values as they are."""
    plain = F.replace(F.lower(raw), F.lit("_"), F.lit("-"))
    return F.when(plain.isin("zh", "zh-cn", "chinese"), "zh-CN").when(plain.isin("en", "en-us", "english"), "en-US").otherwise(raw)
