"""The enrichment stream: a durable folder of jobs, deduplicated, embedded once per hash and merged idempotently."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from quern.schema import ONLINE
from quern.sources.embedder import embedder, hashed


class Counters(StreamingQueryListener):
    """Rows read and batches ended, as the engine reports them."""

    def __init__(self):
        self.rows = self.batches = self.failed = 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.rows += event.progress.numInputRows
        self.batches += 1

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.failed += event.exception is not None


def shared_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of this machine only where it is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def job_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """(semantic_hash, enqueued_at) of a growing folder of event files, or of one file."""
    schema = spark.read.parquet(path).schema
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(fs).isFile()
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    events = reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)
    return events.select(F.sha2(F.concat("event_type", "props"), 256).alias("semantic_hash"), F.col("ts").cast("timestamp").alias("enqueued_at"))


def dedup_jobs(spark: SparkSession, path: str, watermark: str = "365 days") -> DataFrame:
    """Each hash once: state of a hash is dropped when the watermark passes it, so it stays bounded."""
    out = _folder(spark, "jobs")
    stream = job_stream(spark, path).withWatermark("enqueued_at", watermark).dropDuplicatesWithinWatermark(["semantic_hash"])
    stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/data")


def enrich_jobs(spark: SparkSession, path: str, embed=None, watermark: str = "365 days", retries: int = 5) -> DataFrame:
    """(semantic_hash, embedding, status) of all jobs.

    A batch writes only hashes that no earlier batch has; it writes to a folder of its own number,
    so a repeated batch replaces what it wrote. Embedding failures are tried again by the task
    retries of the cluster, then the batch, up to `retries` times.
    """
    out = _folder(spark, "enrich")
    vector = embedder(embed or (lambda texts: hashed(texts, 64)))
    schema = "semantic_hash string, embedding array<float>, status int"

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        done = session.read.schema(schema).parquet(*([f"{out}/data/batch={k}" for k in range(number)] or [])) if number else session.createDataFrame([], schema)
        fresh = batch.select("semantic_hash").distinct().join(done.select("semantic_hash"), "semantic_hash", "left_anti")
        rows = fresh.withColumn("embedding", vector(F.col("semantic_hash"))).withColumn("status", F.lit(ONLINE))
        for attempt in range(retries):
            try:
                rows.write.mode("overwrite").parquet(f"{out}/data/batch={number}")
                return
            except Exception:
                if attempt + 1 == retries:
                    raise

    stream = job_stream(spark, path).withWatermark("enqueued_at", watermark)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/data")


def attempt(action: Callable[[], None], tries: int = 5, first_wait: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """Run an action until it succeeds, waiting twice as long each time; the number of tries. The last failure is raised."""
    for k in range(1, tries + 1):
        try:
            action()
            return k
        except Exception:
            if k == tries:
                raise
            sleep(first_wait * 2 ** (k - 1))
    return 0


def work(spark: SparkSession, folder: str, state: str, enrich: Callable[[DataFrame], None], tries: int = 5, first_wait: float = 5.0, per_minute: float | None = 100, files_per_batch: int = 5, once: bool = True, sleep: Callable[[float], None] = time.sleep) -> Counters:
    """The worker of the jobs that sinks.enqueue() appends to `folder`.

    Each micro-batch hands its distinct (semantic_hash, symbols_table) to `enrich`, which must be
    idempotent: a batch that was cut off runs again from the checkpoint at `state`. A failing batch
    is tried `tries` times with exponential waits, then its jobs go back to the folder with attempt
    + 1, up to `tries` attempts, and to `failed` beside it from then on. `per_minute` bounds the
    batches' files, as each enqueue writes few; once=False waits for further jobs until stopped.
    """
    from quern.schema import JOBS

    counters, started = Counters(), [time.monotonic(), 0]

    def run(batch: DataFrame, number: int) -> None:
        jobs = batch.groupBy("semantic_hash", "symbols_table").agg(F.max("attempt").alias("attempt"), F.min("enqueued_at").alias("enqueued_at")).persist()
        try:
            if per_minute:
                due = started[0] + started[1] * files_per_batch * 60 / per_minute
                sleep(max(0.0, due - time.monotonic()))
                started[1] += 1
            attempt(lambda: enrich(jobs.select("semantic_hash", "symbols_table")), tries, first_wait, sleep)
        except Exception:
            counters.failed += 1
            again = jobs.withColumn("attempt", F.col("attempt") + 1).select("semantic_hash", "symbols_table", "enqueued_at", "attempt")
            again.where(F.col("attempt") < tries).write.mode("append").parquet(folder)
            again.where(F.col("attempt") >= tries).write.mode("append").parquet(f"{folder.rstrip('/')}-failed")
        finally:
            jobs.unpersist()

    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    spark.streams.addListener(counters)
    try:
        stream = spark.readStream.schema(JOBS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
        writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", state)
        query = (writer.trigger(availableNow=True) if once else writer).start()
        query.awaitTermination()
    finally:
        spark.streams.removeListener(counters)
    return counters


def keep_last_failures(failures: DataFrame, most: int = 100) -> DataFrame:
    """The newest failed jobs of each table."""
    w = Window.partitionBy("symbols_table").orderBy(F.desc("enqueued_at"), "semantic_hash")
    return failures.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")
