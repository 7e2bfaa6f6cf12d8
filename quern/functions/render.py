"""Rows as text: JSON answers, percentages, snippets, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = tuple("network form validation format state ui storage math hook utils component service".split())


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object a row, nulls left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def percent(x: Column) -> Column:
    return F.format_string("%.1f%%", F.round(x * 100, 1))


def delta(now: Column, before: Column) -> Column:
    d = F.round((now - before) * 100, 1)
    return F.concat(F.when(d > 0, "+").otherwise(""), F.format_string("%.1f%%", d))


def snippet(text: Column, most: int = 4000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n... cut"))).otherwise(text)


def rewrite_prompt(query: Column, keywords: Column) -> Column:
    return F.concat(F.lit("State in one English sentence what reusable code this request needs.\nRequest: "), query, F.lit("\nWords: "), F.array_join(keywords, ", "))


def prose_prompt(kind: Column, name: Column, doc: Column) -> Column:
    return F.concat(F.lit("Describe in one sentence what this "), kind, F.lit(" does.\nName: "), name, F.lit("\n"), doc)


def category_prompt(doc: Column) -> Column:
    return F.concat(F.lit("Answer with one of: " + ", ".join(LABELS) + "\n"), doc)


def category_of_reply(reply: Column) -> Column:
    """The first label that a reply contains; null without one."""
    out = F.lit(None).cast("string")
    for label in reversed(LABELS):
        out = F.when(F.contains(F.lower(reply), F.lit(label)), F.lit(label)).otherwise(out)
    return out
