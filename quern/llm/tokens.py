"""Token counts by heap-and-linked-list byte-pair merging.

Each pretoken starts as a linked list of its bytes. A heap holds the adjacent pairs that the
vocabulary can merge; the lowest rank (then the leftmost) is popped, merged and its two new
neighbours are pushed. The count is the initial symbols minus the merges: no identifier is
looked up or emitted. A pretoken of n bytes takes O(n log n), so a run of 10^5 letters is no
special case.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lean import mapped

#: The split that the rank files were made for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Counts of pretokens that one Python worker remembers; beyond it the memory starts anew, which changes no result.
REMEMBERED = 600_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank by byte string, from lines of base64 and a number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(x): int(y) for x, y in (line.split() for line in lines if line.strip())}


def count_tokens(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Symbols left of one pretoken when no adjacent pair has a rank; 0 of an empty one."""
    n = len(piece)
    if n < 2:
        return n
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapify(heap)
    merges = 0
    while heap:
        _, left, right, end = heappop(heap)
        if after[left] != right or after[right] != end:
            continue  # one of the two has been merged since
        merges += 1
        after[left], after[right] = end, -1
        if end < n:
            before[end] = left
            if (r := get(piece[left : after[end]])) is not None:
                heappush(heap, (r, left, end, after[end]))
        if (p := before[left]) >= 0 and (r := get(piece[p:end])) is not None:
            heappush(heap, (r, p, left, end))
    return n - merges


class Counter(dict):
    """Tokens by pretoken, counted when first asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: str) -> int:
        n = count_tokens(piece.encode("utf-8", "surrogatepass"), self.ranks)
        if len(piece) <= 64:
            self[piece] = n
        return n


def token_counts(df: DataFrame, spark: SparkSession, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of every row, repeated rows included, in one scan without a shuffle.

    A null text has a null count and an empty text 0. A null key stays null. Texts are counted
    whole. Other columns are neither read nor returned, so their names can't clash. An empty
    table gives an empty one. The vocabulary (about 1 MB) is read by the driver and broadcast.
    """
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(PATTERN).findall
        counts = Counter(ranks.value)
        for batch in batches:
            out = []
            for t in batch.column(1):
                t = t.as_py()
                out.append(None if t is None else sum(map(counts.__getitem__, split(t))))
                if len(counts) > REMEMBERED:
                    counts.clear()
            yield pa.record_batch([batch.column(0), pa.array(out, pa.int64())], ["k", "n"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).transform(mapped, run, f"k {kind}, n bigint")
    return rows.select(F.col("k").alias(key), F.col("n").alias("n_tokens"))
