"""Sinks: results as JSON lines by date, the job folder, and a cache table with expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_results(df: DataFrame, folder: str, date: str) -> str:
    """JSON lines below folder/date=<date>, replaced if the date is written again."""
    path = f"{folder.rstrip('/')}/date={date}"
    df.write.mode("overwrite").json(path)
    return path


def enqueue(symbols: DataFrame, folder: str, table: str = "symbols") -> int:
    """A job for each distinct hash of the rows, appended to the folder that the stream reads."""
    jobs = symbols.where(F.length("semantic_hash") > 0).select("semantic_hash").distinct()
    jobs = jobs.select("semantic_hash", F.lit(table).alias("symbols_table"), F.current_timestamp().alias("enqueued_at"), F.lit(0).alias("attempt"))
    n = jobs.count()
    if n:
        jobs.write.mode("append").parquet(folder)
    return n


def cache_write(df: DataFrame, folder: str, seconds: int) -> None:
    """Append (key, value) with the time they expire at."""
    df.withColumn("expires_at", F.current_timestamp() + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))).write.mode("append").parquet(folder)
