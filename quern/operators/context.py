"""Chunk context: neighbours, deduplication, order, budget and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.config import DEFAULT, Tuning


def neighbours(hits: DataFrame, chunks: DataFrame, radius: int = DEFAULT.adjacent_radius) -> DataFrame:
    """Chunks within `radius` of each hit of the same path, the hits included: each hit names its indexes, then an equi-join."""
    wanted = hits.select("path", F.explode(F.sequence(F.greatest(F.lit(0), F.col("chunk_index") - radius), F.col("chunk_index") + radius)).alias("chunk_index")).distinct()
    return chunks.join(wanted, ["path", "chunk_index"], "left_semi")


def neighbours_window(chunks: DataFrame, hit: Column, radius: int = DEFAULT.adjacent_radius) -> DataFrame:
    """The same by a frame over each path's chunks, without a join."""
    w = Window.partitionBy("path").orderBy("chunk_index").rangeBetween(-radius, radius)
    return chunks.withColumn("__near", F.max(hit.cast("int")).over(w)).where("__near = 1").drop("__near")


def gather(hits: DataFrame, near: DataFrame) -> DataFrame:
    """Hits and neighbours, one row per chunk, a hit before a neighbour."""
    both = hits.withColumn("src", F.lit(0)).unionByName(near.withColumn("src", F.lit(1)).withColumn("similarity", F.lit(None).cast("double")))
    first = Window.partitionBy("path", "chunk_index").orderBy("src")
    return both.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def rendered(path: Column, index: Column, count: Column, similarity: Column, content: Column) -> Column:
    head = F.concat_ws(" · ", F.concat(F.lit("source: "), path), F.concat(F.lit("part "), (index + 1).cast("string"), F.lit("/"), count.cast("string")), F.when(similarity.isNotNull(), F.format_string("similarity %.2f", similarity)))
    return F.concat(F.lit("["), head, F.lit("]\n"), content)


def budget(rows: DataFrame, t: Tuning = DEFAULT) -> DataFrame:
    """The prefix of the context order that fits: hits by similarity, then neighbours by path and index.

    The first chunk always stays; the first that would exceed the characters ends the context,
    as does the chunk limit. Adds rn, total_chars and truncated. The rows are those of one
    question (a few hits and their neighbours), so the single window partition stays small.
    """
    order = Window.orderBy("src", F.col("similarity").desc_nulls_last(), "path", "chunk_index")
    out = rows.withColumn("rendered", rendered(F.col("path"), F.col("chunk_index"), F.col("chunk_count"), F.col("similarity"), F.col("content")))
    out = out.withColumn("rn", F.row_number().over(order)).withColumn("total_chars", F.sum(F.length("rendered")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("truncated", F.max("rn").over(Window.partitionBy()) > F.sum(F.when((F.col("rn") <= t.context_chunks) & ((F.col("rn") == 1) | (F.col("total_chars") <= t.context_chars)), 1).otherwise(0)).over(Window.partitionBy()))
    return out.where((F.col("rn") <= t.context_chunks) & ((F.col("rn") == 1) | (F.col("total_chars") <= t.context_chars)))


def context_text(kept: DataFrame) -> DataFrame:
    """One row: the rendered chunks joined in order, their number and whether any was left out."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rn", "rendered"))), lambda x: x["rendered"])
    return kept.agg(F.array_join(parts, "\n\n---\n\n").alias("context"), F.count("*").alias("chunks"), F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"))
