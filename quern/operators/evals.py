"""Retrieval metrics, failure attribution and the analysis of evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAILURES = ("no_semantic_recall", "reusability_filtered", "structure_filtered", "ranked_below_topk", "quality_gate_rejected")
TAGS = tuple("en zh zh-en class component function hook type".split())


def relevant(expected: Column, least: int = 1) -> Column:
    return F.transform(F.filter(expected, lambda e: e["rel"] >= least), lambda e: e["name"])


def recall_at_k(returned: Column, expected: Column, k: int) -> Column:
    """Share of the relevant names among the first k; 1 if nothing is relevant."""
    want, top = relevant(expected), F.slice(returned, 1, k)
    hits = F.size(F.filter(want, lambda n: F.array_contains(top, n)))
    return F.when(F.size(want) == 0, 1.0).otherwise(hits / F.size(want).cast("double"))


def mrr_at_k(returned: Column, expected: Column, k: int) -> Column:
    want = relevant(expected)
    ranks = F.transform(F.slice(returned, 1, k), lambda n, i: F.when(F.array_contains(want, n), F.lit(1.0) / (i + 1)))
    return F.coalesce(F.array_max(ranks), F.lit(0.0))


def _gain(rels: Column) -> Column:
    return F.aggregate(F.transform(rels, lambda r, i: (F.pow(F.lit(2.0), r) - 1) / F.log2(i + F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)


def ndcg_at_k(returned: Column, expected: Column, k: int) -> Column:
    """Gain over the ideal gain; 1 if nothing has gain. Repeated names gain each time, so it may exceed 1."""
    rel = F.transform(F.slice(returned, 1, k), lambda n: F.coalesce(F.array_max(F.transform(F.filter(expected, lambda e: e["name"] == n), lambda e: e["rel"])), F.lit(0)))
    ideal = _gain(F.slice(F.sort_array(F.transform(expected, lambda e: e["rel"]), asc=False), 1, k))
    return F.when(ideal == 0, 1.0).otherwise(_gain(rel) / ideal)


def classify_failure(symbol: Column, semantic: Column, reusable: Column, combined: Column, qualified: Column, returned: Column) -> Column:
    """Stage at which a symbol was lost, or found."""
    return (
        F.when(F.array_contains(returned, symbol), "found")
        .when(~F.array_contains(semantic, symbol), FAILURES[0])
        .when(~F.array_contains(reusable, symbol), FAILURES[1])
        .when(~F.array_contains(combined, symbol), FAILURES[2])
        .when(~F.array_contains(qualified, symbol), FAILURES[3])
        .otherwise(FAILURES[4])
    )


def evaluate(runs: DataFrame, k: int = 10, wide: int = 50) -> DataFrame:
    """Metrics by query of (query_id, returned, expected, tags); negative queries have null metrics and may be false positives."""
    negative = F.size("expected") == 0
    r, e = F.col("returned"), F.col("expected")
    primary = relevant(e, 2)
    unless = lambda c: F.when(~negative, c)
    return runs.select(
        "query_id", "tags", unless(recall_at_k(r, e, k)).alias("recall_main"), unless(recall_at_k(r, e, wide)).alias("recall_wide"), unless(mrr_at_k(r, e, k)).alias("mrr"), unless(ndcg_at_k(r, e, k)).alias("ndcg"),
        unless((F.size(r) > 0) & F.coalesce(F.array_contains(primary, F.try_element_at(r, F.lit(1))), F.lit(False))).alias("top1"), negative.alias("is_negative"), (negative & (F.size(r) > 0)).alias("false_positive"),
    )


def summarise(rows: DataFrame) -> DataFrame:
    """One row of means and ratios; a null counts 0, an empty set of queries gives 0."""
    pos = ~F.col("is_negative")
    n = F.greatest(F.count_if(pos), F.lit(1)).cast("double")
    m = lambda c: F.coalesce(F.sum(F.when(pos, F.coalesce(F.col(c), F.lit(0.0)))) / n, F.lit(0.0))
    return rows.agg(
        m("recall_main").alias("recall"), m("mrr").alias("mrr"), m("ndcg").alias("ndcg"), (F.count_if(pos & (F.col("recall_main") > 0)) / n).alias("coverage"), (F.count_if(pos & F.col("top1")) / n).alias("top1"),
        (F.count_if(F.col("false_positive")) / F.greatest(F.count_if(~pos), F.lit(1)).cast("double")).alias("fp_rate"), F.count_if(pos & (F.col("recall_main") == 0)).alias("zero_recall"),
    )


def recall_by_tag(rows: DataFrame, tags: tuple[str, ...] = TAGS) -> DataFrame:
    out = rows.where(~F.col("is_negative")).select(F.explode("tags").alias("tag"), "recall_main").where(F.col("tag").isin(*tags))
    return out.groupBy("tag").agg(F.count("*").alias("queries"), F.avg(F.coalesce("recall_main", F.lit(0.0))).alias("recall"), F.count_if(F.col("recall_main") == 0).alias("zero_recall"))


def baseline_delta(now: DataFrame, before: DataFrame) -> DataFrame:
    """(metric, value, baseline, delta) of two one-row summaries."""
    cols = [c for c in now.columns if c != "zero_recall"]
    j = now.select([F.col(c).alias(f"a_{c}") for c in cols]).crossJoin(before.select([F.col(c).alias(f"b_{c}") for c in cols]))
    return j.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"a_{c}").alias("value"), F.col(f"b_{c}").alias("baseline"), (F.col(f"a_{c}") - F.col(f"b_{c}")).alias("delta")) for c in cols])))


def findings(summary: DataFrame, failures: DataFrame) -> DataFrame:
    """Flags of a one-row summary and failure counts (type, n): what to look at first."""
    total = failures.agg(F.sum("n").alias("total"), F.max(F.struct("n", "type")).alias("top"))
    j = summary.crossJoin(F.broadcast(total))
    share = F.col("top.n") / F.greatest(F.col("total"), F.lit(1)).cast("double")
    flags = [("recall gap to coverage", F.col("coverage") - F.col("recall") > 0.1), ("low recall", F.col("recall") < 0.5), ("one failure dominates", share > 0.5), ("one failure is frequent", (share > 0.3) & (share <= 0.5)), ("false positives", F.col("fp_rate") > 0.1)]
    return j.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in flags]))).alias("finding"))
