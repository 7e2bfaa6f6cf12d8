"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable Parquet shards. Shards of similar size (one tier) are
merged in runs, oldest first, until files reach the target size. Which shards make up the table
is said by a manifest; a new version of it is written aside and committed by creating one log
entry that must not exist yet, so readers see the old table or the new one and of two writers one
fails. Merging copies files without a shuffle: one task streams a run's row groups into one file
of its own name, so a lost or repeated task leaves at most a file that no manifest names. Files
that no version still kept names are deleted only once they are older than any write may take.

Manifests are tables: they are planned, rewritten and vacuumed by executors, and the driver holds
counts of them only.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lean import mapped
from .store import Scratch, filesystem, free, shared_dir

TARGET_BYTES = 128 << 20
FAN_IN = 4
#: Rows of an arrival's shard at most.
ARRIVAL_ROWS = 2000
#: Shards that are planned together; a manifest of more unfinished ones is planned in several tasks.
PLANNED = 50_000
#: Merges that one task makes one after the other are as many as keep a job at so many tasks.
MERGE_TASKS = 20_000
#: Seconds for which files and versions stay after they have been replaced: longer than any reader or writer takes.
RETENTION = 7 * 24 * 3600
ENTRY = "path string, bytes bigint, rows bigint, seq bigint"


class Conflict(RuntimeError):
    """Another writer has committed this version."""


def tier(size: int, smallest: int, fan_in: int = FAN_IN) -> int:
    """0 up to `smallest` bytes, then one more for each factor of fan_in."""
    t = 0
    while size > smallest:
        size, t = size / fan_in, t + 1
    return t


def plan(entries: list[tuple[str, int, int]], target: int = TARGET_BYTES, fan_in: int = FAN_IN, smallest: int = 1 << 20) -> list[list[str]]:
    """Runs of shards to merge, from (path, bytes, seq).

    In each tier, oldest first, runs grow until they hold fan_in shards and the next would take
    them beyond the target; a tier with fewer than fan_in shards waits. What a merge would give
    takes part in the next tier at once, so each byte is copied once however many tiers it rises.
    Shards of at least the target are done. Ties in age go by path.
    """
    nodes = [([p], size, seq) for p, size, seq in sorted(entries, key=lambda x: (x[2], x[0])) if size < target]
    done: list[list[str]] = []
    while True:
        tiers: dict[int, list] = {}
        for node in nodes:
            tiers.setdefault(tier(node[1], smallest, fan_in), []).append(node)
        ripe = [t for t in sorted(tiers) if len(tiers[t]) >= fan_in]
        if not ripe:
            return done + [n[0] for n in nodes if len(n[0]) > 1]
        members, merged, run, size = tiers[ripe[0]], [], [], 0
        for node in members:
            if run and size + node[1] > target:
                merged.append((run, size))
                run, size = [], 0
            run, size = [*run, node], size + node[1]
            if len(run) >= fan_in and size < target and tier(size, smallest, fan_in) > ripe[0]:
                merged.append((run, size))
                run, size = [], 0
        merged += [(run, size)] if run else []
        if all(len(r) == 1 for r, _ in merged):
            done += [n[0] for n in members if len(n[0]) > 1]  # two of these would exceed the target
            used = {id(n) for n in members}
            nodes = [n for n in nodes if id(n) not in used]
            continue
        used = {id(n) for n in members}
        left = [n for n in nodes if id(n) not in used]
        for r, size in merged:
            node = ([p for n in r for p in n[0]], size, r[0][2])
            if size >= target:
                done.append(node[0])
            else:
                left.append(node)
        nodes = sorted(left, key=lambda n: (n[2], n[0][0]))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for out, seq, paths in zip(*(batch.column(k).to_pylist() for k in range(3))):
            out = f"{out}/{uuid.uuid4().hex}.parquet"
            fs, at = pa.fs.FileSystem.from_uri(out)
            rows, writer = 0, None
            for path in paths:
                with fs.open_input_file(pa.fs.FileSystem.from_uri(path)[1]) as source:
                    file = pq.ParquetFile(source)
                    old = any(file.schema.column(k).physical_type == "INT96" for k in range(len(file.schema)))
                    if writer is None:
                        writer = pq.ParquetWriter(at, file.schema_arrow, filesystem=fs, use_deprecated_int96_timestamps=old, compression="zstd")
                    for part in file.iter_batches(batch_size=2048):
                        writer.write_table(pa.Table.from_batches([part]).cast(file.schema_arrow), row_group_size=1 << 20)
                        rows += part.num_rows
            writer.close()
            yield pa.record_batch([[out], [fs.get_file_info(at).size], [rows], [seq]], pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("rows", pa.int64()), ("seq", pa.int64())]))


class ShardedTable:
    """A table of shards below `root`, a location that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root if "://" in root else "file://" + root

    def version(self) -> int:
        """The last committed version; 0 of a new table."""
        fs, log = filesystem(self.spark, f"{self.root}/_log")
        return max([0, *(int(x.getPath().getName()[:-5]) for x in fs.listStatus(log) if x.getPath().getName()[0].isdigit())]) if fs.exists(log) else 0

    def manifest(self, version: int | None = None) -> DataFrame:
        """(path, bytes, rows, seq) of the shards of a version."""
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], ENTRY)
        fs, at = filesystem(self.spark, f"{self.root}/_log/{version:012d}.json")
        stream = fs.open(at)
        where = json.loads(bytes(stream.readAllBytes()))["manifest"]
        stream.close()
        return self.spark.read.schema(ENTRY).parquet(where)

    def commit(self, entries: DataFrame, after: int) -> int:
        """Make `entries` version after + 1, or raise Conflict if that exists."""
        where = f"{self.root}/_manifests/{after + 1:012d}-{uuid.uuid4().hex[:8]}"
        entries.write.parquet(where)
        body = json.dumps({"version": after + 1, "manifest": where}).encode()
        entry = f"{self.root}/_log/{after + 1:012d}.json"
        fs, log = filesystem(self.spark, f"{self.root}/_log")
        fs.mkdirs(log)
        aside = f"{self.root}/_log/.{uuid.uuid4().hex}"
        if self.root.startswith("file:"):
            local = lambda x: unquote(urlparse(x).path)
            with open(local(aside), "wb") as f:
                f.write(body)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(local(aside), local(entry))
            except FileExistsError as e:
                raise Conflict(entry) from e
            finally:
                os.unlink(local(aside))
        else:
            jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs
            _, at = filesystem(self.spark, aside)
            stream = fs.create(at, False)
            stream.write(bytearray(body))
            stream.close()
            options = self.spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0)
            context = jvm.FileContext.getFileContext(at.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            try:
                context.rename(at, jvm.Path(entry), options)
            except Exception as e:
                fs.delete(at, False)
                raise Conflict(entry) from e
        return after + 1

    def append(self, df: DataFrame, rows: int = ARRIVAL_ROWS) -> int:
        """Add the rows as new shards of up to `rows` rows, as the scan deals them out: no shuffle."""
        after = self.version()
        where = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows).parquet(where)
        new = self.spark.read.schema(df.schema).parquet(where)
        file = new.metadataColumn("_metadata")
        new = new.select(file["file_path"].alias("path"), file["file_size"].alias("bytes"))
        new = new.groupBy("path", "bytes").agg(F.count("*").alias("rows")).withColumn("seq", F.lit(after + 1).cast("bigint"))
        return self.commit(self.manifest(after).unionByName(new), after)

    def compact(self, target: int = TARGET_BYTES, fan_in: int = FAN_IN, planned: int = PLANNED) -> int:
        """Merge what plan() says of the shards below the target and commit it; the same version if there's nothing to merge."""
        after, scratch = self.version(), Scratch(self.spark, "compact")
        entries = self.manifest(after)
        small = entries.where(F.col("bytes") < target)
        groups = max(1, -(-small.count() // planned))

        def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by: dict[int, list] = {}
            for r in (r for b in batches for r in b.to_pylist()):
                by.setdefault(r["g"], []).append(r)
            made = [(min(seq[p] for p in run), run) for g in by.values() for seq in [{r["path"]: r["seq"] for r in g}] for run in plan([(r["path"], r["bytes"], r["seq"]) for r in g], target, fan_in)]
            yield pa.record_batch([pa.array([x[0] for x in made], pa.int64()), pa.array([x[1] for x in made], pa.list_(pa.string()))], ["seq", "paths"])

        dealt = small.select("path", "bytes", "seq", F.pmod(F.xxhash64("path"), F.lit(groups)).alias("g")).repartition(groups, "g")
        tasks = scratch.write(dealt.transform(mapped, runs, "seq bigint, paths array<string>"), "plan")
        n = tasks.count()
        if not n:
            return after
        where = f"{self.root}/data/{uuid.uuid4().hex}"
        fs, folder = filesystem(self.spark, where)
        fs.mkdirs(folder)
        each = tasks.select(F.lit(where).alias("out"), "seq", "paths", F.monotonically_increasing_id().alias("task")).repartitionByRange(min(n, MERGE_TASKS), "task").drop("task")
        merged = scratch.write(each.transform(mapped, _merge, ENTRY), "merged")  # run once: what is written here is what is committed
        gone = tasks.select(F.explode("paths").alias("path"))
        return self.commit(entries.join(gone, "path", "left_anti").unionByName(merged), after)

    def vacuum(self, retention: float = RETENTION) -> int:
        """Delete files that no kept version names and that are older than `retention` seconds; their number.

        The last version is kept, and so are those that were committed or replaced within the
        retention, with what DataFrames read of them. A file that another writer has written but
        not yet committed is younger than the retention, and stays.
        """
        fs, log = filesystem(self.spark, f"{self.root}/_log")
        oldest = (time.time() - retention) * 1000
        commits = sorted((int(x.getPath().getName()[:-5]), x.getModificationTime()) for x in fs.listStatus(log) if x.getPath().getName()[0].isdigit()) if fs.exists(log) else []
        kept = [v for k, (v, _) in enumerate(commits) if k + 1 == len(commits) or commits[k + 1][1] > oldest]
        _, data = filesystem(self.spark, f"{self.root}/data")
        if not kept or not fs.exists(data):
            return 0
        at = F.url_decode(F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/+", "/"), "\\+", "%2B")).alias("at")
        named = reduce(DataFrame.union, [self.manifest(v).select(at) for v in kept]).distinct()
        folders = [(f"{self.root}/data/{x.getPath().getName()}",) for x in fs.listStatus(data) if x.isDirectory()]

        def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for folder in (x for b in batches for x in b.column(0).to_pylist()):
                where, inside = pa.fs.FileSystem.from_uri(folder)
                found = [x for x in where.get_file_info(pa.fs.FileSelector(inside)) if x.extension == "parquet"]
                yield pa.record_batch([pa.array([f"{folder}/{x.base_name}" for x in found], pa.string()), pa.array([x.mtime.timestamp() * 1000 for x in found], pa.float64())], ["path", "ms"])

        listed = self.spark.createDataFrame(folders, "path string").repartition(min(len(folders) or 1, MERGE_TASKS)).transform(mapped, files, "path string, ms double")
        old = listed.where(F.col("ms") < oldest).select("path", at)

        def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for path in b.column(0).to_pylist():
                    where, file = pa.fs.FileSystem.from_uri(path)
                    if where.get_file_info(file).type != pa.fs.FileType.NotFound:  # a task that runs again finds it gone
                        where.delete_file(file)
                yield b

        return old.join(named, "at", "left_anti").select("path").transform(mapped, delete, "path string").count()

    def read(self, schema, version: int | None = None, names: tuple[str, str] = ("__shard", "__shard_bytes")) -> DataFrame:
        """The rows of a version with two more columns: the shard's file name and its bytes."""
        paths = [r["path"] for r in self.manifest(version).select("path").collect()]  # as many as Spark's own file index holds
        if not paths:
            return self.spark.createDataFrame([], schema).withColumns({names[0]: F.lit(None).cast("string"), names[1]: F.lit(None).cast("bigint")})
        rows = self.spark.read.schema(schema).parquet(*paths)
        file = rows.metadataColumn("_metadata")
        return rows.select("*", file["file_name"].alias(names[0]), file["file_size"].alias(names[1]))


def shard(df: DataFrame, spark: SparkSession, target: int = TARGET_BYTES, fan_in: int = FAN_IN, rows: int = ARRIVAL_ROWS, root: str | None = None) -> tuple[DataFrame, ShardedTable]:
    """Append a table, compact it, and return (its rows as committed, the sharded table).

    Every row comes back once, repeated rows, nulls and empty or very long texts included; the
    rows have the columns of df, then shard (the file), shard_bytes and manifest_version, or
    these names with underscores before them where df has them already. An empty table is
    committed as a version of no rows. Without a root the table is a new one that nobody else
    knows, so what its compaction has replaced is deleted at once; else after RETENTION.
    """
    table = ShardedTable(spark, root or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex[:12]}")
    table.append(df, rows)
    version = table.compact(target, fan_in)
    table.vacuum(RETENTION if root else -60)
    names = free(df, "shard", "shard_bytes", "manifest_version")
    return table.read(df.schema, version, tuple(names[:2])).withColumn(names[2], F.lit(version).cast("bigint")), table
