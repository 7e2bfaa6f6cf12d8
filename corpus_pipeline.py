"""A corpus pipeline of five stages over `documents`; each stage's result is written before the next reads it.

run() keeps identified languages, one document of each near-duplicate group and what holds no
benchmark item, repeats or drops documents by the mixture's rates, and returns the rows with the
shard they are committed to. Empty tables, nulls and repeated rows pass as the stages' operators
define; see their docstrings.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontam, langid, mixing, neardup, sharding
from quern.llm.store import Scratch
from quern.ship import ship


def _shipped(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run


@_shipped
def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of a determined language; the machines are fitted to a bounded sample of the labels in `lang`."""
    return langid.keep_identified(docs, spark, langid.train(docs))


@_shipped
def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return neardup.keep_one(docs, spark)


@_shipped
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no item of `benchmark`."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark)


@_shipped
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated by rates that bring the domains of `labels` to their target shares."""
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), spark)


@_shipped
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the shard that a committed manifest says they are in."""
    return sharding.shard(docs, spark)[0]


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("near_dedup", deduplicate),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: SQL can't express the classifier, the sketches, the tilings or the fit; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
