"""Snapshot tables: a version is written aside and then named by a pointer file; readers see whole versions only.

One writer at a time is assumed. The pointer is replaced by one atomic rename, so a write that fails
at any point leaves the old version in place; versions without a pointer to one of them are an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def current(self) -> str | None:
        fs, p = self._fs(f"{self.root}/CURRENT")
        if not fs.exists(p):
            _, root = self._fs(self.root)
            names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
            if sum(n.startswith("v-") for n in names) > 1:  # one alone is a first write that failed
                raise FileNotFoundError(f"{self.root} has versions, but nothing says which one is the table")
            return None
        s = fs.open(p)
        name = bytes(s.readAllBytes()).decode()
        s.close()
        return f"{self.root}/{name}"

    def read(self) -> DataFrame | None:
        at = self.current()
        return None if at is None else self.spark.read.parquet(at)

    def replace(self, df: DataFrame, sort: tuple[str, ...] = ()) -> DataFrame:
        """Write df as the next version, sorted within files so that their statistics prune scans, and point to it."""
        name = f"v-{uuid.uuid4().hex}"
        (df.sortWithinPartitions(*sort) if sort else df).write.parquet(f"{self.root}/{name}")
        fs, aside = self._fs(f"{self.root}/.CURRENT-{name}")
        out = fs.create(aside, True)
        out.write(bytearray(name.encode()))
        out.close()
        _, at = self._fs(f"{self.root}/CURRENT")
        jvm, conf = self.spark.sparkContext._jvm.org.apache.hadoop.fs, self.spark.sparkContext._jsc.hadoopConfiguration()
        options = self.spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
        options[0] = jvm.Options.Rename.OVERWRITE
        aside, at = aside.makeQualified(fs.getUri(), fs.getWorkingDirectory()), at.makeQualified(fs.getUri(), fs.getWorkingDirectory())
        jvm.FileContext.getFileContext(at.toUri(), conf).rename(aside, at, options)
        return self.spark.read.parquet(f"{self.root}/{name}")

    def update(self, change: Callable[[DataFrame], DataFrame], sort: tuple[str, ...] = ()) -> DataFrame:
        now = self.read()
        if now is None:
            raise FileNotFoundError(self.root)
        return self.replace(change(now), sort)
