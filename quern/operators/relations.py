"""Call and import edges between symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.paths import dirname

SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]


def call_edges(calls: DataFrame, exports: DataFrame) -> DataFrame:
    """(caller, caller_path, callee, callee_path): a call of a name in a file links each export of the file to each symbol of that name."""
    e = exports.select("file", F.col("name").alias("caller"))
    target = exports.select(F.col("name").alias("callee"), F.col("file").alias("callee_path"))
    out = calls.select("file", F.col("name").alias("callee")).distinct().join(e, "file").join(target, "callee")
    return out.where((F.col("caller") != F.col("callee")) | (F.col("file") != F.col("callee_path"))).select("caller", F.col("file").alias("caller_path"), "callee", "callee_path").distinct()


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Relative specifiers resolved to the first existing of nine candidates: (file, name, target)."""
    base = F.concat_ws("/", dirname(F.col("file")), F.col("specifier"))
    norm = F.regexp_replace(base, "(^|/)\\./", "$1")
    for _ in range(6):  # each turn takes one level of every ../ run away
        norm = F.regexp_replace(norm, "(^|/)(?!\\.\\./)[^/]+/\\.\\./", "$1")
    norm = F.regexp_replace(norm, "(^|/)\\./", "$1")
    tries = imports.where(F.startswith("specifier", F.lit("."))).select("file", "name", "specifier", F.posexplode(F.array(*[F.concat(norm, F.lit(s)) for s in SUFFIXES])).alias("n", "target"))
    found = tries.join(files.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    return found.groupBy("file", "name", "specifier").agg(F.min_by("target", "n").alias("target"))


def import_edges(resolved: DataFrame, exports: DataFrame) -> DataFrame:
    """(importer, name, target): exports of the importing file against the imported symbol."""
    e = exports.select("file", F.col("name").alias("importer"))
    s = exports.select(F.col("name").alias("name"), F.col("file").alias("target"))
    return resolved.select("file", "name", "target").join(s, ["name", "target"], "left_semi").join(e, "file").select("importer", F.col("file").alias("importer_path"), "name", "target").distinct()


def first_k(edges: DataFrame, key: list[str], order: list[str], k: int = 20) -> DataFrame:
    """The first k edges of each key in a stated order; Catalyst keeps k rows a group before the shuffle."""
    return edges.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("__n") <= k).drop("__n")
