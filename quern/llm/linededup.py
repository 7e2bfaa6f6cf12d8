"""Line deduplication by a deletion-neighbourhood join.

A line is its sequence of words. Two lines match within one edit (a word replaced, inserted or
deleted) exactly if deleting at most one word from each can make them equal, so each line emits
the hash of itself and of itself without each word, and equal hashes meet. A line is dropped for
the earliest line, by (document, line number), that it matches, even where that line is itself
dropped for another: of a chain of lines one edit apart only the first stays.

Two exact reductions come first: equal lines count once, and only lines that share their first or
last half with a different line (as any two within one edit do) emit their neighbourhood.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blobs
from . import text as T
from .lean import mapped
from .store import Scratch

U64 = np.uint64
#: Lines of fewer words than this only match equal ones: one edit would be too large a part of them.
LEAST_WORDS = 6
#: Surviving lines up to this many are sent to all executors (about 20 bytes each, so 100 MB); beyond it they are joined by shuffle.
BROADCAST_LINES = 5_000_000
_B = 0x9E3779B97F4A7C15
_INVERSE = pow(_B, -1, 1 << 64)


class Lines:
    """Lines that have a word, of a range of documents: words w[at[k]:at[k+1]], document doc[k], number no[k] from 0."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        folded = T.fold(data)
        w, doc, start, _ = T.words(folded, offsets)
        breaks = np.flatnonzero(data == 10)
        before = np.searchsorted(breaks, start)
        first = np.searchsorted(breaks, offsets[:-1])
        no = before - first[doc] if len(doc) else before
        new = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(no) != 0)])) if len(doc) else np.zeros(0, np.int64)
        self.w, self.at = w, np.concatenate([new, [len(w)]]).astype(np.int64)
        self.doc, self.no = doc[new], no[new].astype(np.int64)
        self.size = np.diff(self.at)
        power = np.cumprod(np.full(len(w) + 1, _B, U64))
        self.total = np.concatenate([np.zeros(1, U64), np.cumsum(w * power[: len(w)])])
        self.inverse = np.cumprod(np.full(len(w) + 1, _INVERSE, U64))

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the words a..b-1 of self.w, the same wherever they stand."""
        return T.mix((self.total[b] - self.total[a]) * self.inverse[np.minimum(a, len(self.inverse) - 1)] + (b - a).astype(U64))

    def hashes(self) -> np.ndarray:
        return self.span(self.at[:-1], self.at[1:])

    def halves(self, rows: np.ndarray) -> np.ndarray:
        """Six keys of each line: its head and tail as a line of one word less, as many, and one more would be halved."""
        a, b, n = self.at[:-1][rows], self.at[1:][rows], self.size[rows]
        out = []
        for d in (-1, 0, 1):
            head = (n + d) // 2
            tail = n + d - head
            out.append(T.mix(self.span(a, a + np.minimum(head, n)) + (n + d).astype(U64) * U64(2)))
            out.append(T.mix(self.span(b - np.minimum(tail, n), b) + (n + d).astype(U64) * U64(2) + U64(1)))
        return np.stack(out, 1)

    def variants(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, index into rows, place) of each line's neighbourhood; place is the word left out, or -1."""
        n = self.size[rows]
        k = np.repeat(np.arange(len(rows)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a, b = self.at[:-1][rows][k], self.at[1:][rows][k]
        cut = a + place
        # the words behind the cut move one place to the left: one power less
        left = (self.total[cut] - self.total[a]) + (self.total[b] - self.total[cut + 1]) * U64(_INVERSE)
        gone = T.mix(left * self.inverse[a] + (b - a - 1).astype(U64))
        whole = self.hashes()[rows]
        return np.concatenate([whole, gone]), np.concatenate([np.arange(len(rows)), k]), np.concatenate([np.full(len(rows), -1), place])


def _each(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Lines]]:
    data, offsets = T.utf8(batch.column(1))
    for i, j in T.blocks(data, offsets):
        yield i, j, Lines(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _occurrences(parts: int):
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for i, _, x in _each(batch):
                yield x.hashes(), ids[i + x.doc], x.no

    return lambda batches: blobs.scatter_all(lines(batches), parts)


def _half_keys(parts: int, least: int):
    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for _, _, x in _each(batch):
                rows = np.flatnonzero(x.size >= least - 1)
                _, one = np.unique(x.hashes()[rows], return_index=True)
                rows = rows[one]
                yield x.halves(rows).reshape(-1), np.repeat(x.hashes()[rows], 6)

    return lambda batches: blobs.scatter_all(halves(batches), parts)


def _runs(key: np.ndarray) -> np.ndarray:
    """First index of each run of a sorted array."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def _equal_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every occurrence of a line with the first one of that line."""
    key, doc, no = blobs.gather(batches, 3)
    doc, no = doc.view(np.int64), no.view(np.int64)
    order = np.lexsort((no, doc, key))
    key, doc, no = key[order], doc[order], no[order]
    start = _runs(key)
    first = np.repeat(start, np.diff(np.concatenate([start, [len(key)]])))
    for a in range(0, len(key), 100_000):
        s = slice(a, a + 100_000)
        yield pa.record_batch([pa.array(x) for x in (key[s].view(np.int64), doc[s], no[s], doc[first[s]], no[first[s]])], ["h", "d", "l", "fd", "fl"])


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that share a half with a different line, each once in a partition."""
    key, line = blobs.gather(batches, 2)
    order = np.lexsort((line, key))
    key, line = key[order], line[order]
    start = _runs(key)
    end = np.concatenate([start[1:], [len(key)]]) - 1
    some = np.repeat(line[start] != line[end], end - start + 1) if len(key) else np.zeros(0, bool)
    yield pa.record_batch([pa.array(np.unique(line[some]).view(np.int64))], ["h"])


def _neighbourhoods(parts: int, least: int):
    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            ids, wanted = np.asarray(batch.column(0)), batch.column(2)
            flat = np.asarray(wanted.flatten())
            count = np.asarray(pc.list_value_length(wanted))
            base = np.concatenate([[0], np.cumsum(count)])
            for i, j, x in _each(batch):
                asked = np.repeat(np.arange(j - i), count[i:j]) << 40 | flat[base[i] : base[j]]
                rows = np.flatnonzero(np.isin(x.doc << 40 | x.no, asked) & (x.size >= least - 1))
                key, k, place = x.variants(rows)
                use = (x.size[rows][k] >= least) | (place < 0)  # a shorter line may only be one with a word deleted
                key, k, place = key[use], k[use], place[use]
                yield key, ids[i + x.doc[rows[k]]], x.no[rows[k]] << 24 | (place + 1)

    return lambda batches: blobs.scatter_all(variants(batches), parts)


def _earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each line the earliest earlier one with an equal variant that one edit explains."""
    key, doc, code = blobs.gather(batches, 3)
    doc, place, no = doc.view(np.int64), (code & U64((1 << 24) - 1)).astype(np.int64) - 1, (code >> U64(24)).astype(np.int64)
    out = []
    for same in (True, False):  # the same place left out of both; or nothing of one and any word of the other
        order = np.lexsort((no, doc, place, key)) if same else np.lexsort((no, doc, place >= 0, key))
        k, d, p, n = key[order], doc[order], place[order], no[order]
        if same:
            group = np.concatenate([[True], (k[1:] != k[:-1]) | (p[1:] != p[:-1])]) if len(k) else np.zeros(0, bool)
            start = np.flatnonzero(group)
            first = np.repeat(start, np.diff(np.concatenate([start, [len(k)]])))
        else:
            start = _runs(k)
            end = np.concatenate([start[1:], [len(k)]])
            whole = p < 0
            wholes = np.add.reduceat(whole, start) if len(k) else np.zeros(0, np.int64)
            mixed = (wholes > 0) & (wholes < end - start)
            first_whole, first_cut = start, np.minimum(start + wholes, np.maximum(len(k) - 1, 0))
            each = np.repeat(np.arange(len(start)), end - start)
            first = np.where(whole, first_cut[each], first_whole[each])
            first = np.where(mixed[each], first, np.arange(len(k)))
        keep = np.flatnonzero((d[first] < d) | (d[first] == d) & (n[first] < n))
        out.append(np.stack([d[keep], n[keep], d[first[keep]], n[first[keep]]]))
    rows = np.unique(np.concatenate(out, 1), axis=1)
    yield pa.record_batch([pa.array(np.ascontiguousarray(x)) for x in rows], ["d", "l", "nd", "nl"])


def word_edits(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of word sequences, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        cost = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        new = np.concatenate([[i], cost])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
        if row.min() > most:
            return most + 1
    return int(row[-1])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        one, two = b.column(4), b.column(5)
        words = lambda x: np.frombuffer(x.as_buffer(), U64)
        keep = [k for k in range(b.num_rows) if word_edits(words(one[k]), words(two[k]), 1) <= 1]
        yield b.take(pa.array(keep, pa.int64())).select([0, 1, 2, 3])


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, wanted = np.asarray(batch.column(0)), batch.column(2)
        flat, count = np.asarray(wanted.flatten()), np.asarray(pc.list_value_length(wanted))
        base = np.concatenate([[0], np.cumsum(count)])
        for i, j, x in _each(batch):
            asked = np.repeat(np.arange(j - i), count[i:j]) << 40 | flat[base[i] : base[j]]
            rows = np.flatnonzero(np.isin(x.doc << 40 | x.no, asked))
            yield pa.record_batch([pa.array(ids[i + x.doc[rows]]), pa.array(x.no[rows]), pa.array([x.w[x.at[k] : x.at[k + 1]].tobytes() for k in rows], pa.binary())], ["d", "l", "w"])


def _numbered(df: DataFrame, key: str, text: str, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """((id, t) of the rows with key and text, names of the ids or None): whole numbers are their own ids, other keys get ids in their order."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    if df.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return rows.select(F.col("k").cast("bigint").alias("id"), "t"), None
    names = scratch.write(rows.select("k").distinct().orderBy("k").select("k", F.monotonically_increasing_id().alias("id")), "keys")
    return rows.join(names, "k").select("id", "t"), names


def duplicate_lines(df: DataFrame, spark: SparkSession, text: str = "text", key: str = "doc_id", least: int = LEAST_WORDS) -> DataFrame:
    """(key, line_no, kept_<key>, kept_line_no) of every line to drop and the earliest line it matches.

    Lines are numbered from 0 within a document and split at newlines. Equal lines (the same
    words, whatever their case and punctuation) match at any length; lines of at least `least`
    words also match one word apart, where the shorter of the two may have one word less than
    that. Lines without a word, null and empty texts have nothing to match. Rows without key are
    left out. Keys may be of any type that can be ordered; those that aren't whole numbers cost a
    sort of the keys and a join with the texts. Rows that repeat a key with the same text are one
    document; with different texts their lines count under the same numbers. Lines of any length
    and number count; other columns aren't read. An empty table gives an empty result.
    """
    scratch, parts = Scratch(spark, "lines"), blobs.buckets(spark)
    docs, names = _numbered(df, key, text, scratch)

    def near(fn, *shape):
        return blobs.exchange(docs.transform(mapped, fn, blobs.SCHEMA), parts).transform(mapped, *shape)

    lines = scratch.write(near(_occurrences(parts), _equal_lines, "h bigint, d bigint, l bigint, fd bigint, fl bigint"), "lines")
    meeting = near(_half_keys(parts, least), _meeting, "h bigint").distinct()
    survivors = lines.where("d = fd and l = fl").select("h", "d", "l").distinct().join(meeting, "h", "left_semi")
    survivors = scratch.write(survivors.groupBy("d").agg(F.collect_set("l").alias("wanted")), "survivors")

    def with_lines(which: DataFrame) -> DataFrame:
        few = (which.agg(F.sum(F.size("wanted"))).first()[0] or 0) <= BROADCAST_LINES
        return docs.join(F.broadcast(which) if few else which, docs["id"] == which["d"]).select("id", "t", "wanted")

    sent = blobs.exchange(with_lines(survivors).transform(mapped, _neighbourhoods(parts, least), blobs.SCHEMA), parts)
    pairs = sent.transform(mapped, _earliest, "d bigint, l bigint, nd bigint, nl bigint")
    pairs = scratch.write(pairs.groupBy("d", "l").agg(F.min(F.struct("nd", "nl")).alias("n")).select("d", "l", "n.nd", "n.nl"), "pairs")
    both = pairs.select("d", "l").union(pairs.select("nd", "nl")).groupBy("d").agg(F.collect_set("l").alias("wanted"))
    words = with_lines(scratch.write(both, "asked")).transform(mapped, _words_of, "d bigint, l bigint, w binary").groupBy("d", "l").agg(F.max("w").alias("w"))
    other = words.select(F.col("d").alias("nd"), F.col("l").alias("nl"), F.col("w").alias("nw"))
    sure = pairs.join(words, ["d", "l"]).join(other, ["nd", "nl"]).select("d", "l", "nd", "nl", "w", "nw").transform(mapped, _verify, "d bigint, l bigint, nd bigint, nl bigint")
    sure = sure.select(F.col("d").alias("fd"), F.col("l").alias("fl"), "nd", "nl")
    out = lines.join(sure, ["fd", "fl"], "left").select("d", "l", F.when(F.col("nd").isNull(), F.struct("fd", "fl")).otherwise(F.least(F.struct("fd", "fl"), F.struct(F.col("nd").alias("fd"), F.col("nl").alias("fl")))).alias("k"))
    out = out.where("k.fd < d or (k.fd = d and k.fl < l)").distinct()
    out = out.select("d", "l", F.col("k.fd").alias("fd"), F.col("k.fl").alias("fl"))
    if names is not None:
        for x in ("d", "fd"):
            out = out.join(names.select(F.col("k").alias("name"), F.col("id").alias(x)), x).drop(x).withColumnRenamed("name", x)
    kind = df.schema[key].dataType
    return out.select(F.col("d").cast(kind).alias(key), F.col("l").alias("line_no"), F.col("fd").cast(kind).alias(f"kept_{key}"), F.col("fl").alias("kept_line_no"))
