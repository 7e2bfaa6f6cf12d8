"""File scans, change lists, evaluation files and configuration."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.hashes import file_hash
from quern.functions.paths import display_path
from quern.schema import CHANGES, EVAL_QUERY

IGNORED = "build coverage dist dist-srv node_modules vendor .cache .git .next .nuxt .output .turbo .venv".split()


def source_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("ts", "tsx", "js", "jsx"), ignore: tuple[str, ...] = ()) -> DataFrame:
    """(path relative to root, content, file_hash) of the source files; directories of IGNORED and `ignore` are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root)
    at = display_path(F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "%20", " "), str(Path(root).absolute()))
    skipped = "(^|/)(" + "|".join(re.escape(x) for x in [*IGNORED, *ignore]) + ")/"
    hidden = "(^|/)\\.[^/]"
    out = raw.select(at.alias("path"), F.decode("content", "utf-8").alias("content"))
    return out.where(~F.col("path").rlike(skipped) & ~F.col("path").rlike(hidden)).withColumn("file_hash", file_hash(F.col("content")))


def change_set(spark: SparkSession, args: list[str]) -> DataFrame:
    """(op, path, new_path) of `--changed a,b --deleted c --renamed x:y`, as `--k v` or `--k=v`."""
    rows, k = [], 0
    while k < len(args):
        key, eq, value = args[k].partition("=")
        if not eq:
            k += 1
            value = args[k] if k < len(args) else ""
        k += 1
        op = key.removeprefix("--")
        if op in ("changed", "deleted", "renamed"):
            for item in filter(None, (x.strip() for x in value.split(","))):
                old, _, new = item.partition(":")
                if op != "renamed":
                    rows.append((op, item, None))
                elif old and new:
                    rows.append((op, old, new))
    return spark.createDataFrame(rows, CHANGES)


def query_set(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation queries of a file of JSON lines; blank lines and comments (# or //) are skipped."""
    lines = spark.read.text(path).where(~F.trim("value").rlike("^(#|//|$)"))
    return lines.select(F.from_json("value", EVAL_QUERY).alias("q")).select("q.*")


def results(spark: SparkSession, path: str, schema: str, latest: bool = True) -> DataFrame:
    """Evaluation results; of a folder, the file whose name comes last."""
    rows = spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_name").alias("file"))
    if not latest:
        return rows
    return rows.join(F.broadcast(rows.agg(F.max("file").alias("file"))), "file", "left_semi")


def settings(root: str, defaults: Mapping[str, str], environ: Mapping[str, str] | None = None) -> dict[str, str]:
    """Configuration: the environment before the file .env of the root before the defaults."""
    out = dict(defaults)
    file = Path(root) / ".env"
    if file.exists():
        for line in file.read_text().splitlines():
            key, eq, value = line.strip().partition("=")
            if eq and key and not key.startswith("#"):
                out[key.strip()] = value.strip().strip("'\"")
    out.update({k: v for k, v in (os.environ if environ is None else environ).items() if k in defaults})
    return out


def with_cache(queries: DataFrame, cache: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], now) -> DataFrame:
    """Values from a cache table (key, value, expires_at), computed for the keys it lacks or that have expired."""
    live = cache.where(F.col("expires_at") > now).groupBy(key).agg(F.max("value").alias("value"))
    hit = queries.join(live, key, "inner").withColumn("cached", F.lit(True))
    miss = compute(queries.join(live, key, "left_anti")).withColumn("cached", F.lit(False))
    return hit.unionByName(miss)
