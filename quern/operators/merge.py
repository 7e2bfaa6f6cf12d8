"""Mutations of snapshot tables as joins: merge, replace, reconcile, rename, invalidate, count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.schema import OFFLINE, ONLINE, PENDING


def merge_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by (path, name) with one shuffle of each side.

    A new vector is taken (online); else a changed hash drops the vector (pending); else a stored
    vector stays (online); else pending. A null hash on either side isn't a change. Usage, author
    and creation of stored rows stay.
    """
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, (F.col("o.path") == F.col("n.path")) & (F.col("o.name") == F.col("n.name")), "full_outer")
    is_new, has_old = F.col("n.path").isNotNull(), F.col("o.path").isNotNull()
    changed = F.col("n.semantic_hash") != F.col("o.semantic_hash")
    vector = F.when(~is_new, F.col("o.embedding")).when(F.col("n.embedding").isNotNull(), F.col("n.embedding")).when(changed, F.lit(None)).otherwise(F.col("o.embedding"))
    status = (
        F.when(~is_new, F.col("o.status"))
        .when(F.col("n.embedding").isNotNull(), F.lit(ONLINE))
        .when(~has_old, F.lit(PENDING))
        .when(changed, F.lit(PENDING))
        .when(F.col("o.embedding").isNotNull(), F.lit(ONLINE))
        .otherwise(F.lit(PENDING))
    )
    keep = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))
    take = lambda c: F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    fixed = {"path": keep("path"), "name": keep("name"), "usage_count": F.coalesce("o.usage_count", F.lit(0)), "embedding": vector, "status": status.cast("int")}
    return j.select(*[fixed.get(c, keep(c) if c in ("id", "insert_user", "created_at") else take(c)).alias(c) for c in old.columns])


def soft_delete(stored: DataFrame, parsed: DataFrame, touched: DataFrame) -> DataFrame:
    """Stored symbols of touched paths that the new parse lacks go offline and lose their file hash; other paths stay."""
    hit = touched.select(F.col("path").alias("__p")).distinct()
    found = parsed.select(F.col("path").alias("__fp"), F.col("name").alias("__fn")).distinct()
    j = stored.join(hit, stored["path"] == F.col("__p"), "left").join(found, (stored["path"] == F.col("__fp")) & (stored["name"] == F.col("__fn")), "left")
    gone = F.col("__p").isNotNull() & F.col("__fp").isNull()
    return j.withColumn("status", F.when(gone, F.lit(OFFLINE)).otherwise(F.col("status"))).withColumn("file_hash", F.when(~gone, F.col("file_hash"))).drop("__p", "__fp", "__fn")


def rename_paths(df: DataFrame, renames: DataFrame) -> DataFrame:
    r = renames.select(F.col("path").alias("__from"), F.col("new_path").alias("__to"))
    return df.join(r, df["path"] == F.col("__from"), "left").withColumn("path", F.coalesce("__to", "path")).drop("__from", "__to")


def invalidate(df: DataFrame, hashes: DataFrame) -> DataFrame:
    """Rows of the hashes lose vector and file hash and are pending again."""
    h = hashes.select(F.col("semantic_hash").alias("__h")).distinct()
    hit = F.col("__h").isNotNull()
    j = df.join(h, df["semantic_hash"] == F.col("__h"), "left")
    return j.withColumn("embedding", F.when(~hit, F.col("embedding"))).withColumn("file_hash", F.when(~hit, F.col("file_hash"))).withColumn("status", F.when(hit, F.lit(PENDING)).otherwise(F.col("status"))).drop("__h")


def add_usage(df: DataFrame, log: DataFrame, key: str = "id") -> DataFrame:
    """Counters plus the number of log rows of their key; the log is summed before it is joined."""
    n = log.groupBy(F.col(key).alias("__k")).agg(F.count("*").cast("int").alias("__n"))
    return df.join(n, df[key] == F.col("__k"), "left").withColumn("usage_count", F.col("usage_count") + F.coalesce("__n", F.lit(0))).drop("__k", "__n")


def replace_documents(stored: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of the new rows' paths give way to the new rows."""
    return stored.join(new.select("path").distinct(), "path", "left_anti").select(stored.columns).unionByName(new)


def changed_files(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose hash isn't the stored one; an unknown file has changed."""
    s = stored.where(F.col("file_hash").isNotNull()).groupBy("path").agg(F.max("file_hash").alias("stored_hash"))
    return current.join(s, "path", "left").where(~F.col("file_hash").eqNullSafe(F.col("stored_hash")))


def reuse_vectors(pending: DataFrame, stored: DataFrame) -> DataFrame:
    """Pending rows with the vector that any online row of their hash has: no embedding is computed twice."""
    known = stored.where((F.col("status") == ONLINE) & F.col("embedding").isNotNull()).groupBy("semantic_hash").agg(F.min_by("embedding", "id").alias("reused"))
    return pending.join(known, "semantic_hash", "left")
