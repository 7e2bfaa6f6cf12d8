"""Tables of symbols, chunks, judgements, jobs and usage derived from the relational test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPE_OF = {"ECONOMY": "component", "SMALL": "function", "MEDIUM": "hook", "PROMO": "type", "STANDARD": "interface"}
AREAS = ["components", "common", "shared", "utils", "hooks", "tests", "demo", "example"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbol_path(key: Column) -> Column:
    seventh = F.floor(key / 7).cast("int")
    area = F.element_at(F.array(*[F.lit(a) for a in AREAS]), F.pmod(seventh, F.lit(8)) + 1)
    file = F.when(key % 7 == 0, F.lit("index.tsx")).otherwise(F.concat(F.lit("p"), key.cast("string"), F.lit(".tsx")))
    return F.concat_ws("/", F.lit("src"), area, seventh.cast("string"), file)


def symbols(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """One symbol per part; usage and age come from its line items; columns that aren't asked for aren't read."""
    part = table(spark, sf_dir, "part")
    use = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").cast("int").alias("n"), F.max("l_shipdate").alias("created_at"))
    kind = F.lit("class")
    for k, v in TYPE_OF.items():
        kind = F.when(F.col("p_type") == k, F.lit(v)).otherwise(kind)
    props, hooks = F.split("p_name", " "), F.array(F.concat(F.lit("use"), F.col("p_type")))
    meta = F.concat(F.lit('{"props":["'), F.array_join(props, '","'), F.lit('"],"hooks":["'), F.array_join(hooks, '","'), F.lit('"]}'))
    out = part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), kind.alias("type"), F.lower("p_brand").alias("category"), symbol_path(F.col("p_partkey")).alias("path"),
        F.concat_ws(" ", "p_type", "p_name", F.lit("by"), "p_brand").alias("description"), (F.col("p_partkey") % 4).cast("int").alias("status"), props.alias("props"), hooks.alias("hooks"), meta.alias("meta_json"),
    )
    out = out.join(use, "id", "left").withColumn("usage_count", F.coalesce("n", F.lit(0))).drop("n")
    if vectors:
        v = table(spark, sf_dir, "embeddings")
        n = v.count()
        out = out.join(v.select(F.col("vec_id").alias("v"), "embedding"), F.col("id") % max(n, 1) == F.col("v"), "left").drop("v")
    return out


def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the day that ages count from."""
    return table(spark, sf_dir, "lineitem").agg(F.max("l_shipdate").alias("as_of"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"), F.col("lang").alias("category"), "doc_id")


def fixed_chunks(spark: SparkSession, sf_dir: str, size: int = 600, step: int = 500) -> DataFrame:
    """Chunks of equal windows: (path, chunk_index, chunk_count, content, similarity of a hash)."""
    d = documents(spark, sf_dir)
    count = F.greatest(F.lit(1), F.ceil((F.length("content") - (size - step)) / step)).cast("int")
    d = d.withColumn("chunk_count", count).withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("chunk_count") - 1)))
    return d.select("doc_id", "path", "chunk_index", "chunk_count", F.substring(F.col("content"), F.col("chunk_index") * step + 1, F.lit(size)).alias("content"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.sha2(F.concat("event_type", "props"), 256).alias("semantic_hash"), F.col("ts").cast("timestamp").alias("enqueued_at"), "event_id")


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, name, rel): labelled documents as expected results of the query of their source."""
    lab = table(spark, sf_dir, "labels")
    doc = table(spark, sf_dir, "documents").select("doc_id", "source")
    return lab.join(doc, "doc_id").select(F.col("source").alias("query_id"), F.col("doc_id").cast("string").alias("name"), F.greatest(F.lit(0), F.least(F.lit(2), F.col("quality") * 2 - F.col("toxic"))).alias("rel"), "doc_id")
