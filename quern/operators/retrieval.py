"""Keyword, full-text, vector and structural retrieval, and rank fusion."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.config import DEFAULT, Tuning
from quern.functions import scoring, text
from quern.schema import ONLINE

MATCHED = ("name", "description", "path", "meta_json")


def online(df: DataFrame, types: list[str] | None = None) -> DataFrame:
    out = df.where(F.col("status") == ONLINE)
    return out.where(F.col("type").isin(types)) if types else out


def ilike_any(pattern: str, columns: tuple[str, ...] = MATCHED) -> Column:
    """Case-insensitive substring in any column; % and _ of the text stay wildcards."""
    return reduce(or_, [F.ilike(F.coalesce(F.col(c), F.lit("")), F.lit(f"%{pattern}%")) for c in columns])


def keyword_search(df: DataFrame, query: str, tokens: list[str], types: list[str] | None = None, limit: int | None = DEFAULT.search_cap) -> DataFrame:
    """Online rows that hold the whole query or any of its tokens, the most used first."""
    hit = reduce(or_, [ilike_any(x) for x in [query.strip(), *tokens]])
    out = online(df, types).where(hit)
    return out if limit is None else out.orderBy(F.desc("usage_count"), "id").limit(limit)


def fulltext(df: DataFrame, words: list[str], fields: tuple[str, ...] = ("name", "description", "path"), types: list[str] | None = None, limit: int | None = 20, t: Tuning = DEFAULT) -> DataFrame:
    """Online rows that hold every word, by weighted score; no word matches nothing."""
    scored = online(df, types).withColumn("score", scoring.fulltext_score(sorted(set(words)), [text.terms(F.col(f)) for f in fields], t)).where(F.col("score") > 0)
    return scored if limit is None else scored.orderBy(F.desc("score"), "id").limit(limit)


def vector_topk(df: DataFrame, query: DataFrame, limit: int, floor: float = 0.0, vector: str = "embedding", key: str = "id") -> DataFrame:
    """The rows nearest to the one-row query(q): 2 x limit by similarity, then the floor, then limit.

    The query is a single row whatever the data's size, so it is broadcast; every partition keeps
    its own 2 x limit best.
    """
    scored = df.where(F.col(vector).isNotNull()).crossJoin(F.broadcast(query.limit(1))).withColumn("similarity", scoring.cosine(F.col(vector), F.col("q"))).drop("q")
    top = scored.orderBy(F.desc("similarity"), key).limit(2 * limit)
    return top.where(F.col("similarity") >= floor).orderBy(F.desc("similarity"), key).limit(limit)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Positions from 0 of a list that is already cut to its top: one partition of at most its limit."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)


def rrf(vector: DataFrame, fulltext: DataFrame, key: str = "id", t: Tuning = DEFAULT) -> DataFrame:
    """(key, rrf, vec_rank, text_rank) of two ranked lists (key, rank); a list that lacks a key adds nothing."""
    both = vector.select(key, F.col("rank").alias("v"), F.lit(None).cast("int").alias("w")).unionByName(fulltext.select(key, F.lit(None).cast("int").alias("v"), F.col("rank").alias("w")))
    score = lambda c: F.coalesce(F.sum(F.lit(1.0) / (F.lit(float(t.rrf_k)) + F.col(c))), F.lit(0.0))
    return both.groupBy(key).agg((score("v") + score("w")).alias("rrf"), F.min("v").alias("vec_rank"), F.min("w").alias("text_rank"))


def structure_pool(columns: list[Column]) -> Column:
    return F.transform(F.concat(*columns), F.lower)


def has_structure(required: list[str], pool: Column) -> Column:
    wanted = [r.strip().lower() for r in required if r.strip()]
    return F.size(F.array_except(text.strings(wanted), pool)) == 0


def search_by_structure(df: DataFrame, required: list[str], limit: int = 20, types: list[str] | None = None, category: str | None = None, t: Tuning = DEFAULT) -> DataFrame:
    """Rows with every required field. With structure_prefetch only the max(5 x limit, 50) most used are looked at."""
    out = online(df, types)
    if category:
        out = out.where(F.contains(F.lower("category"), F.lit(category.lower())))
    if t.structure_prefetch:
        out = out.orderBy(F.desc("usage_count"), "id").limit(max(5 * limit, 50))
    return out.where(has_structure(required, structure_pool([F.col("props"), F.col("hooks")]))).orderBy(F.desc("usage_count"), "id").limit(limit)


def matched_required(required: list[str], available: Column) -> Column:
    low = F.transform(available, F.lower)
    return F.filter(text.strings(required), lambda r: F.array_contains(low, F.lower(F.trim(r))))


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first rows, or the second ones where there are none: decided within one plan by a one-row count."""
    n = F.broadcast(first.agg(F.count("*").alias("__n")))
    return first.unionByName(second.crossJoin(n).where("__n = 0").drop("__n"))


def symbol_detail(df: DataFrame, name: str) -> DataFrame:
    return online(df).where(F.col("name") == name).orderBy("id").limit(1)


def two_tokens(df: DataFrame, query: str, tokens: list[str]) -> DataFrame:
    """Rows whose search text holds the query, or two of its tokens at least."""
    hay = text.search_text(F.col("name"), F.col("path"), F.col("description"), F.col("meta_json"))
    return df.where(F.contains(hay, F.lit(query.lower())) | (text.matched_tokens(text.strings(tokens), hay) >= 2))


def cells(vectors: DataFrame, centroids: DataFrame, probes: int = 1, vector: str = "embedding", key: str = "id") -> DataFrame:
    """(key, cell) of the nearest centroids (cell, centre): the partition column of an inverted-file index.

    No shuffle: the centroids are folded into one row and each vector takes its own best. A table
    written partitioned by it is searched by the query's own nearest cells only; with
    as many probes as cells the search is exact.
    """
    folded = F.broadcast(centroids.agg(F.array_sort(F.collect_list(F.struct("cell", "centre"))).alias("__k")))  # one row; a cell is a partition, so they are few
    sim = vectors.select(key, vector).crossJoin(folded)
    near = F.array_sort(F.transform("__k", lambda k: F.struct((-scoring.cosine(F.col(vector), k["centre"])).alias("s"), k["cell"].alias("cell"))))
    return sim.select(key, F.explode(F.slice(near, 1, probes)).alias("__c")).select(key, F.col("__c.cell").alias("cell"))
