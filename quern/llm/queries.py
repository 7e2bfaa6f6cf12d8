"""Queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, langid, linededup, media, media_encode, mixing, neardup, pii, quality, sharding, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), spark)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.language_id(docs, spark, langid.train(docs))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), spark)[0]


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), spark)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), spark)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), spark)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.duplicate_lines(_table(spark, sf_dir, "documents"), spark)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), spark)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no pictures, so each vector of `embeddings` is drawn and encoded first."""
    return media.rgb_tensors(media_encode.pictures(_table(spark, sf_dir, "embeddings")), key="vec_id")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"), spark)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_language_id, op3_sharding, op4_near_dedup, op5_quality, op6_decontamination, op7_line_dedup, op8_mixing, op9_media, op10_pii)}

_LETTERS = "[0-9a-z_\\x{C0}-\\x{1FFF}\\x{2080}-\\x{2E7F}]+"

ORACLES = {
    "op7_line_dedup": f"""
WITH cut AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), numbered AS (
  SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS line FROM cut
), lines AS (
  SELECT doc_id, line_no, regexp_extract_all(lower(line), '{_LETTERS}') AS words FROM numbered
), kept AS (
  SELECT doc_id, line_no, words, len(words) AS n, array_to_string(words, ' ') AS whole FROM lines WHERE len(words) > 0
), firsts AS (
  SELECT whole, min(struct_pack(d := doc_id, l := line_no)) AS first, any_value(words) AS words, any_value(n) AS n FROM kept GROUP BY whole
), variants AS (
  SELECT first, -1 AS place, whole AS v FROM firsts WHERE n >= 5
  UNION ALL
  SELECT first, p, array_to_string(list_concat(words[1:p], words[p + 2:]), ' ') FROM (SELECT first, words, unnest(range(n)) AS p FROM firsts WHERE n >= 6)
), near AS (
  SELECT a.first, min(b.first) AS other FROM variants a JOIN variants b
    ON a.v = b.v AND b.first < a.first AND (a.place = b.place OR (a.place < 0) <> (b.place < 0)) GROUP BY a.first
), best AS (
  SELECT whole, CASE WHEN other IS NOT NULL AND other < f.first THEN other ELSE f.first END AS k FROM firsts f LEFT JOIN near USING (first)
)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, k.d AS kept_doc_id, CAST(k.l AS BIGINT) AS kept_line_no
FROM kept JOIN best USING (whole) WHERE k < struct_pack(d := doc_id, l := line_no)
""",
}
