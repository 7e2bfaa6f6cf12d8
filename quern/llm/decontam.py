"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet where they share a run of `least` tokens (the seeds). Each such
pair is tiled: the longest common runs are found by running Karp-Rabin hashes of falling window
length, marked from the longest down so that no token lies in two tiles, until none of `least`
tokens is left. A document is contaminated by an item whose tokens the tiles cover to at least
`coverage`, in whatever order the passages come.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .lean import mapped

U64 = np.uint64
LEAST, COVERAGE = 5, 0.5
#: Characters of benchmark that one pass over the documents holds in memory; a larger benchmark takes several passes.
PASS_CHARS = 32_000_000
_FIRST = 20  # window with which a tiling starts
_BASE = 0x9E3779B97F4A7C15
_MAP_BITS = 22


def windows(tokens: np.ndarray, size: int) -> np.ndarray:
    """Running Karp-Rabin hash (modulo 2^64) of every window of `size` tokens."""
    n = len(tokens)
    if n < size:
        return np.zeros(0, U64)
    power = np.cumprod(np.full(n, _BASE, U64))
    inverse = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), U64))
    total = np.concatenate([np.zeros(1, U64), np.cumsum(tokens * power)])
    return (total[size:] - total[:-size]) * inverse[: n - size + 1]


def _runs(p: np.ndarray, t: np.ndarray, free_p: np.ndarray, free_t: np.ndarray, size: int) -> np.ndarray:
    """(length, start in p, start in t) of the maximal unmarked common runs of at least `size` tokens."""
    none = np.zeros((0, 3), np.int64)
    if min(len(p), len(t)) < size:
        return none

    def whole(free: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(free)])
        return np.flatnonzero(upto[size:] - upto[:-size] == size)

    i, j = whole(free_p), whole(free_t)
    hp, ht = windows(p, size)[i], windows(t, size)[j]
    order = np.argsort(hp, kind="stable")
    i, hp = i[order], hp[order]
    lo, hi = np.searchsorted(hp, ht, "left"), np.searchsorted(hp, ht, "right")
    count = hi - lo
    if not count.sum():
        return none
    jj = np.repeat(j, count)
    ii = i[np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
    true = np.ones(len(ii), bool)
    for k in range(size):  # equal hashes are compared token by token
        true &= p[ii + k] == t[jj + k]
    ii, jj = ii[true], jj[true]
    if not len(ii):
        return none
    order = np.lexsort((ii, jj - ii))
    ii, jj = ii[order], jj[order]
    start = np.flatnonzero(np.concatenate([[True], (np.diff(ii) != 1) | (np.diff(jj - ii) != 0)]))
    length = np.diff(np.concatenate([start, [len(ii)]])) + size - 1
    return np.stack([length, ii[start], jj[start]], 1)


def tile(p: np.ndarray, t: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles (length, start in p, start in t), longest first; ties go to the first in p, then in t."""
    free_p, free_t, out, size = np.ones(len(p), bool), np.ones(len(t), bool), [], max(least, _FIRST)
    while True:
        runs = _runs(p, t, free_p, free_t, size)
        longest = int(runs[:, 0].max()) if len(runs) else 0
        if longest > 2 * size:
            size = longest
            continue
        queue: dict[int, list[tuple[int, int]]] = {}
        for length, i, j in runs.tolist():
            queue.setdefault(length, []).append((i, j))
        while queue:
            length = max(queue)
            for i, j in sorted(queue.pop(length)):
                ok = free_p[i : i + length] & free_t[j : j + length]
                if ok.all():
                    free_p[i : i + length] = False
                    free_t[j : j + length] = False
                    out.append((length, i, j))
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate([[0], ok.view(np.int8), [0]])))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    if b - a >= size:
                        queue.setdefault(b - a, []).append((i + a, j + a))
        if size == least:
            return sorted(out, key=lambda x: (-x[0], x[1], x[2]))
        size = max(least, size // 2)


class Seeds:
    """Benchmark items by their runs of `least` tokens."""

    def __init__(self, ids: pa.Array, texts: pa.Array, least: int):
        data, offsets = T.utf8(texts)
        h, doc, _, _ = T.words(T.fold(data), offsets)
        at = np.searchsorted(doc, np.arange(len(ids) + 1))
        self.ids, self.least = ids, least
        self.tokens = [h[at[k] : at[k + 1]] for k in range(len(ids))]
        parts = [(windows(x, least), k) for k, x in enumerate(self.tokens)]
        key = np.concatenate([w for w, _ in parts]) if parts else np.zeros(0, U64)
        item = np.concatenate([np.full(len(w), k) for w, k in parts]) if parts else np.zeros(0, np.int64)
        pos = np.concatenate([np.arange(len(w)) for w, _ in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.pos = key[order], item[order], pos[order]
        self.map = np.zeros(1 << _MAP_BITS, bool)
        self.map[(self.key >> U64(64 - _MAP_BITS)).astype(np.int64)] = True


def tile_documents(texts: pa.Array, seeds: Seeds, coverage: float = COVERAGE) -> list[tuple[int, int, float, int, int]]:
    """(row, item, coverage, tiles, longest tile) of the contaminated rows, in order; the item is an index of seeds.ids."""
    out, least = [], seeds.least
    data, offsets = T.utf8(texts)
    for first, last in T.blocks(data, offsets):
        h, doc, _, _ = T.words(T.fold(data[offsets[first] : offsets[last]]), offsets[first : last + 1] - offsets[first])
        if len(h) < least or not len(seeds.key):
            continue
        key = windows(h, least)
        hit = np.flatnonzero(seeds.map[(key >> U64(64 - _MAP_BITS)).astype(np.int64)])
        hit = hit[doc[hit] == doc[hit + least - 1]]
        lo, hi = np.searchsorted(seeds.key, key[hit], "left"), np.searchsorted(seeds.key, key[hit], "right")
        count = hi - lo
        entry = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        at, item, pos = np.repeat(hit, count), seeds.item[entry], seeds.pos[entry]
        order = np.lexsort((at, item, doc[at]))
        at, item, pos = at[order], item[order], pos[order]
        row = doc[at]
        start = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(item) != 0)])) if len(at) else []
        for s, e in zip(start, [*start[1:], len(at)]):
            p = seeds.tokens[item[s]]
            could = np.zeros(len(p), bool)
            for k in range(least):
                could[pos[s:e] + k] = True
            if could.sum() < coverage * len(p):
                continue  # no tile lies outside the seeds, so no tiling can reach the coverage
            where = np.unique(at[s:e, None] + np.arange(least))
            gap = np.flatnonzero(np.diff(where) > 1) + 1
            t = np.insert(h[where], gap, np.arange(len(gap), dtype=U64))  # tokens that no item has part the stretches
            tiles = tile(p, t, least)
            share = sum(x[0] for x in tiles) / len(p)
            if share >= coverage:
                out.append((first + int(row[s]), int(item[s]), share, len(tiles), tiles[0][0]))
    return out


def _passes(spark: SparkSession, benchmark: DataFrame, text: str, key: str, least: int, most: int) -> Iterator:
    """Broadcast seeds of the benchmark, in as many slices as its size asks for."""
    items = benchmark.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).distinct()
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = int(chars // most) + 1
    for part in range(n):
        table = items.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == part).toArrow().sort_by("k")
        ids, texts = (table[c].combine_chunks() if len(table) else pa.array([], table[c].type) for c in ("k", "t"))
        yield spark.sparkContext.broadcast(Seeds(ids, texts, least))


def contaminated(df: DataFrame, benchmark: DataFrame, spark: SparkSession, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", least: int = LEAST, coverage: float = COVERAGE, pass_chars: int = PASS_CHARS) -> DataFrame:
    """(key, item_id, coverage, tiles, longest_tile) of every document and item it contains.

    One scan without a shuffle for each PASS_CHARS of benchmark. Clean documents aren't
    returned. Null or empty texts contain nothing, and an item of under `least` tokens is
    contained in nothing: a few common words aren't a passage. Rows without key are returned with
    a null key if contaminated; repeated rows give repeated results. Items that share an id are
    compared one by one, and those without id or text aren't. Keys and ids may be of any type.
    Whole texts are compared; other columns aren't read. An empty table on either side gives
    an empty result.
    """
    docs = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind, item_kind = df.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()

    def run(seeds):
        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = tile_documents(b.column(1), seeds.value, coverage)
                rows, items = (pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))
                columns = [pa.array([x[k] for x in found], t) for k, t in ((2, pa.float64()), (3, pa.int32()), (4, pa.int32()))]
                yield pa.record_batch([b.column(0).take(rows), seeds.value.ids.take(items), *columns], ["k", "i", "c", "n", "l"])

        return docs.transform(mapped, one, f"k {kind}, i {item_kind}, c double, n int, l int")

    out = reduce(DataFrame.union, [run(s) for s in _passes(spark, benchmark, item_text, item_key, least, pass_chars)])
    return out.select(F.col("k").alias(key), F.col("i").alias("item_id"), F.round("c", 6).alias("coverage"), F.col("n").alias("tiles"), F.col("l").alias("longest_tile"))


def keep_clean(df: DataFrame, benchmark: DataFrame, spark: SparkSession, text: str = "text", item_text: str = "text", item_key: str = "item_id", least: int = LEAST, coverage: float = COVERAGE, pass_chars: int = PASS_CHARS) -> DataFrame:
    """The rows that no item contaminates, with all their columns (see contaminated)."""
    at = df.columns.index(text)

    def run(seeds):
        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[x[0] for x in tile_documents(b.column(at), seeds.value, coverage)]] = False
                yield b.filter(pa.array(keep))

        return one

    for s in _passes(spark, benchmark, item_text, item_key, least, pass_chars):
        df = df.transform(mapped, run(s), df.schema)
    return df
