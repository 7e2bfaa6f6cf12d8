"""Ranking of retrieved symbols and the recommendation pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.config import DEFAULT, Tuning
from quern.functions import paths, scoring

from . import retrieval


def rank_keyword(df: DataFrame, query: str, as_of: DataFrame, t: Tuning = DEFAULT) -> DataFrame:
    """score, label and reason of rows for a query; as_of is one row."""
    c = F.col
    out = df.crossJoin(F.broadcast(as_of)).withColumn("match", scoring.text_match(query, c("name"), c("description"), c("path"), t))
    out = out.withColumn("usage", scoring.usage_score(c("usage_count"), t)).withColumn("common", scoring.path_score(c("path"), t))
    out = out.withColumn("score", scoring.total(c("match")["score"], c("usage"), scoring.recency_score(c("created_at"), c("as_of"), t), c("common"), None, t))
    out = out.withColumn("reason", scoring.keyword_reason(c("match"), c("usage"), c("common"), t)).withColumn("matched_by", c("match")["label"])
    return out.drop("match", "usage", "common", "as_of")


def rank_semantic(df: DataFrame, query: str, as_of: DataFrame, t: Tuning = DEFAULT) -> DataFrame:
    """score and reason of rows with a similarity and callee_names."""
    c = F.col
    out = df.crossJoin(F.broadcast(as_of)).withColumn("text", scoring.clamp01(c("similarity"))).withColumn("usage", scoring.usage_score(c("usage_count"), t)).withColumn("common", scoring.path_score(c("path"), t))
    out = out.withColumn("bonus", scoring.callee_bonus(query, c("callee_names"), t))
    out = out.withColumn("score", scoring.total(c("text"), c("usage"), scoring.recency_score(c("created_at"), c("as_of"), t), c("common"), c("bonus"), t))
    return out.withColumn("reason", scoring.semantic_reason(c("text"), c("usage"), c("common"), c("bonus"), t)).drop("text", "usage", "common", "bonus", "as_of")


def directory_penalty(df: DataFrame, score: str = "priority", t: Tuning = DEFAULT) -> DataFrame:
    """final: less for files beside an entry file of their directory that is a candidate too."""
    here = Window.partitionBy("dir")
    out = df.withColumn("dir", paths.dirname(F.col("path"))).withColumn("is_index", paths.is_index_file(F.col("path")))
    out = out.withColumn("beside", F.max(F.col("is_index").cast("int")).over(here) == 1)
    less = F.round(F.greatest(F.lit(0.0), F.col(score) - t.sibling_penalty), 3)
    return out.withColumn("final", F.when(F.col("beside") & ~F.col("is_index"), less).otherwise(F.col(score))).drop("dir", "is_index", "beside")


def recommend(symbols: DataFrame, query: str, words: list[str], vector: DataFrame, as_of: DataFrame, sentence: str, types: list[str], limit: int = 5, t: Tuning = DEFAULT) -> DataFrame:
    """Hybrid recommendation: full text and vector top-k, fusion, rank, priority, directory penalty, best first.

    Both lists are cut to a pool of max(4 x limit, 12) before anything is joined or windowed, so
    what follows the two scans has the size of the pool.
    """
    pool = max(4 * limit, 12)
    found = retrieval.online(symbols, types)
    full = retrieval.ranked(retrieval.fulltext(symbols, words, types=types, limit=pool, t=t).select("id", "score"), [F.desc("score"), F.col("id")], "rank")
    near = retrieval.ranked(retrieval.vector_topk(found, vector, pool).select("id", "similarity"), [F.desc("similarity"), F.col("id")], "rank")
    fused = retrieval.rrf(near, full, t=t)
    rows = symbols.drop("embedding").join(F.broadcast(fused), "id")  # at most two pools of rows
    if not t.rrf_as_similarity:
        rows = rows.join(F.broadcast(near.select("id", "similarity")), "id", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    else:
        rows = rows.withColumn("similarity", F.col("rrf"))
    if t.reusable_filter:
        rows = rows.where(paths.is_reusable(F.col("name"), F.col("path")))
    rows = rank_semantic(rows.withColumn("callee_names", F.array().cast("array<string>")), sentence, as_of, t)
    literal = scoring.strong_literal(sentence, F.col("name"), F.col("path"))
    if t.quality_gate:
        rows = rows.where((F.col("score") >= t.final_threshold) | literal)
    rows = rows.withColumn("priority", scoring.priority(F.col("score"), literal, F.col("path"), t)).withColumn("notes", scoring.priority_notes(literal, F.col("path")))
    rows = directory_penalty(rows, t=t)
    order = [F.desc("final"), F.desc("priority"), F.desc("score"), F.desc("rrf"), F.col("vec_rank").asc_nulls_last(), F.col("text_rank").asc_nulls_last(), F.col("id")]
    return rows.orderBy(*order).limit(limit + 1)


def search_symbols(symbols: DataFrame, query: str, tokens: list[str], as_of: DataFrame, types: list[str] | None = None, limit: int = 20, t: Tuning = DEFAULT) -> DataFrame:
    """Keyword path: search, reusable candidates, rank, threshold, cap."""
    rows = retrieval.keyword_search(symbols, query, tokens, types)
    rows = rank_keyword(rows.where(paths.is_reusable(F.col("name"), F.col("path"))), query, as_of, t)
    return rows.where(F.col("score") >= t.final_threshold).orderBy(F.desc("score"), F.desc("usage_count"), "id").limit(min(limit, t.search_cap))


def search_semantic(symbols: DataFrame, query: str, tokens: list[str], vector: DataFrame, as_of: DataFrame, types: list[str] | None = None, limit: int = 20, t: Tuning = DEFAULT) -> DataFrame:
    """Semantic path: vector top-k, reusable candidates, rank, threshold; the keyword path where no candidate is left."""
    near = retrieval.vector_topk(retrieval.online(symbols, types), vector, limit).where(paths.is_reusable(F.col("name"), F.col("path")))
    near = near.withColumn("callee_names", F.array().cast("array<string>"))
    semantic = rank_semantic(near, query, as_of, t).select("id", "name", "path", "usage_count", "score", "similarity", F.lit(True).alias("semantic"))
    n = F.broadcast(near.agg(F.count("*").alias("__n")))
    other = search_symbols(symbols, query, tokens, as_of, types, limit, t).select("id", "name", "path", "usage_count", "score", F.lit(None).cast("double").alias("similarity"), F.lit(False).alias("semantic"))
    out = semantic.where(F.col("score") >= t.final_threshold).unionByName(other.crossJoin(n).where("__n = 0").drop("__n"))
    return out.orderBy(F.desc("score"), F.col("similarity").desc_nulls_last(), "id").limit(min(limit, t.search_cap))


def best_category(symbols: DataFrame, categories: DataFrame, t: Tuning = DEFAULT) -> DataFrame:
    """(id, category, similarity) of the nearest of a few category vectors (label, vector), null below the floor; ties go to the first label."""
    sim = symbols.crossJoin(F.broadcast(categories)).withColumn("s", scoring.cosine(F.col("embedding"), F.col("vector")))
    best = sim.groupBy("id").agg(F.max(F.struct("s", (-F.col("position")).alias("p"), "label")).alias("m"))
    return best.select("id", F.when(F.col("m.s") >= t.category_floor, F.col("m.label")).alias("category"), F.col("m.s").alias("similarity"))
