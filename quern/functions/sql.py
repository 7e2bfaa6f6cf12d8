"""The scores as SQL functions: their bodies are expressions, so calls are inlined and optimised."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quern.config import DEFAULT, Tuning


def register(spark: SparkSession, t: Tuning = DEFAULT) -> None:
    """Temporary functions cosine_sim, usage_score, recency_score, path_score, search_tokens, rrf_score."""
    tiers = " ".join(f"WHEN days <= {d} THEN {s}D" for d, s in t.recency_tiers)
    norm = "sqrt(aggregate({0}, 0D, (s, v) -> s + CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))"
    for body in (
        f"""cosine_sim(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN
        CASE WHEN size(a) = size(b) AND size(a) > 0 AND {norm.format('a')} * {norm.format('b')} > 0
        THEN aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, v) -> s + v) / ({norm.format('a')} * {norm.format('b')}) ELSE 0D END""",
        f"usage_score(n BIGINT) RETURNS DOUBLE RETURN greatest(0D, least(1D, log10(n + 1D) / {t.usage_log_divisor}D))",
        f"recency_score(days DOUBLE) RETURNS DOUBLE RETURN CASE WHEN days IS NULL THEN {t.recency_default}D {tiers} ELSE {t.recency_oldest}D END",
        f"path_score(path STRING) RETURNS DOUBLE RETURN CASE WHEN contains(lower(path), '/common/') OR contains(lower(path), '/shared/') THEN {t.path_yes}D ELSE {t.path_no}D END",
        "search_tokens(x STRING) RETURNS ARRAY<STRING> RETURN array_distinct(regexp_extract_all(lower(trim(x)), '([a-z0-9_]{2,})', 1))",
        f"rrf_score(rank INT) RETURNS DOUBLE RETURN coalesce(1D / ({t.rrf_k}D + rank), 0D)",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
