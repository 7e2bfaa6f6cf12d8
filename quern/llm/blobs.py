"""A shuffle of packed keys: one binary row per bucket and batch in place of a row per key.

A hashed key is 8 bytes and its payload 8; as a row each would cost tens of bytes and about a
microsecond. Sorted runs of them travel as blobs and are merged with numpy behind the exchange.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "bucket int, blob binary"
#: Entries that a task gathers before it sends them: so many (8 bytes a column each), or so many for each bucket if that is more.
ENTRIES, ENTRIES_A_BLOB = 1 << 20, 32


def buckets(spark: SparkSession) -> int:
    """Buckets of an exchange: as many as shuffle partitions, so that their size follows the session's."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def scatter(keys: np.ndarray, n: int, *columns: np.ndarray) -> pa.RecordBatch:
    """Blobs of (keys, columns) by bucket of the key; every column has 8 bytes an entry."""
    where = (keys % np.uint64(n)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    edges = np.searchsorted(where[order], np.arange(n + 1))
    sorted_columns = [np.ascontiguousarray(c[order]).view(np.uint64) for c in (keys, *columns)]
    some = np.flatnonzero(np.diff(edges))
    out = [np.concatenate([c[edges[b] : edges[b + 1]] for c in sorted_columns]).tobytes() for b in some]
    return pa.record_batch([pa.array(some, pa.int32()), pa.array(out, pa.binary())], ["bucket", "blob"])


def scatter_all(chunks: Iterable[tuple[np.ndarray, ...]], n: int) -> Iterator[pa.RecordBatch]:
    """scatter() of (keys, *columns) gathered over batches, so that blobs hold many keys however many buckets there are."""
    kept: list[tuple[np.ndarray, ...]] = []
    size, most = 0, max(ENTRIES, ENTRIES_A_BLOB * n)
    for chunk in chunks:
        kept.append(tuple(np.ascontiguousarray(c).view(np.uint64) for c in chunk))
        size += len(chunk[0])
        if size >= most:
            keys, *columns = (np.concatenate(x) for x in zip(*kept))
            kept, size = [], 0
            yield scatter(keys, n, *columns)
    if size:
        keys, *columns = (np.concatenate(x) for x in zip(*kept))
        yield scatter(keys, n, *columns)


def gather(batches, width: int) -> list[np.ndarray]:
    """The columns of all blobs of a partition, as 64-bit words."""
    parts = [np.frombuffer(b.as_buffer(), np.uint64).reshape(width, -1) for batch in batches for b in batch.column(1)]
    return list(np.concatenate(parts, 1)) if parts else [np.zeros(0, np.uint64)] * width


def exchange(df: DataFrame, n: int) -> DataFrame:
    """Bucket k to partition k: hashed keys are even already, and hashing bucket numbers again would pile several into one."""
    return df.repartitionById(n, "bucket")
