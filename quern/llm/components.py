"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch

ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.union(edges.select("v", "u")) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = both.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))
    if large:
        out = lowest.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = lowest.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) of every node of the edges (u, v), component being its lowest node.

    Loops and repeated edges don't matter. Each round is written, so no plan grows; rounds end
    when the edges, all pointing to lowest nodes, no longer change (logarithmically many).
    """
    now = scratch.write(edges.select("u", "v").where("u <> v").distinct(), f"{name}0")
    mark = None
    for k in range(1, ROUNDS):
        after = scratch.write(_star(_star(now, True), False), f"{name}{k}")
        row = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        scratch.drop(f"{name}{k - 1}")
        now = after
        if mark == (row["n"], row["s"]):
            break
        mark = (row["n"], row["s"])
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()
