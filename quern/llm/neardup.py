"""Near-duplicate documents by SetSketch registers.

A document is its set of hashed word shingles. Register i of its sketch is the minimum over the
set of independent exponentials, spaced exponentially and truncated: K_i = 1 + floor(-log_b min h_i),
within 0..65535. Sketches of parts merge by the registers' maximum. The m exponentials of one
shingle are made in ascending order (spacings of order statistics, registers along a random
cycle), so only those below the document's current highest minimum are ever computed.

Bands of equal registers propose candidates; the maximum-likelihood Jaccard of the joint counts
(above, below, equal) and the sets' sizes sieves them; exact Jaccard of the sets verifies; groups
are the connected components of what is verified. What is compared are the distinct sets, each by
a 64-bit hash of it, so keys may be of any type and copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blobs
from . import text as T
from .components import components
from .lean import mapped
from .store import Scratch, free

U64 = np.uint64
#: Between two documents that each change one word in twenty of a third, the Jaccard is about 0.58.
SHINGLE, THRESHOLD = 3, 0.5
#: With this base unrelated registers are equal once in 200 times, so bands of four seldom meet by chance.
BASE, RATE, TOP = 1.02, 20.0, 65534
ROWS, BANDS = 4, 50
REGISTERS = ROWS * BANDS
#: The estimate's standard deviation is 0.035 at most; candidates this far below the threshold are still verified, and only those this far above it need no other partner of the bucket.
SLACK = 0.1
#: Documents (of candidates, or to drop) up to this many are sent to all executors (two words each, about 30 bytes, so 120 MB); beyond it they are joined by shuffle.
BROADCAST_IDS = 4_000_000
#: Members of a bucket that one task compares are two blocks of so many at most (13 MB of sketches); larger buckets are compared block by block.
BLOCK = 16_384
#: Partners of a document that one task verifies; more are dealt to several tasks.
HUB = 50_000
_STEPS = np.array([t for t in range(1, REGISTERS) if np.gcd(t, REGISTERS) == 1])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the distinct shingles, sorted by document and hash (44 bits of it)."""
    folded = T.fold(data)
    hashes, doc, _, _ = T.words(folded, offsets)
    h, d = T.shingles(hashes, doc, k)
    if len(h) == 0:
        return h, d
    docs, dense = np.unique(d, return_inverse=True)
    packed = np.unique(dense.astype(U64) << U64(44) | h >> U64(20))
    return packed & U64((1 << 44) - 1), docs[(packed >> U64(44)).astype(np.int64)]


def sketch(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Registers (n documents x REGISTERS, uint16) of the sets of shingle_sets()."""
    m = REGISTERS
    low = np.full((n, m), np.inf)
    flat = low.reshape(-1)
    state = T.mix(h + U64(0x632BE59BD9B4E019))
    reg = (state >> U64(40)).astype(np.int64) % m
    step = _STEPS[(state & U64(0xFFFFF)).astype(np.int64) % len(_STEPS)]
    x = np.zeros(len(h))
    for j in range(m):
        u = ((T.mix(state + U64((j + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53
        x = x - np.log(u) / (RATE * (m - j))
        if j:
            keep = x < low.max(1)[doc]
            x, doc, state, reg, step = x[keep], doc[keep], state[keep], reg[keep], step[keep]
            if not len(x):
                break
        np.minimum.at(flat, doc * m + reg, x)
        reg = (reg + step) % m
    with np.errstate(divide="ignore"):
        return np.clip(1 + np.floor(-np.log(low) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def _above(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def jaccard_mle(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard of pairs of sketches (rows of a and b) of sets of known sizes."""
    up, down = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - up - down
    u = na / np.maximum(na + nb, 1)
    v = 1 - u
    lo, hi = np.zeros(len(a)), np.minimum(u, v) / np.maximum(np.maximum(u, v), 1e-12)

    def likelihood(j: np.ndarray) -> np.ndarray:
        p, q = np.maximum(_above(u - v * j), 1e-12), np.maximum(_above(v - u * j), 1e-12)
        return up * np.log(p) + down * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12))

    for _ in range(22):  # the likelihood is unimodal in j
        one, two = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        left = likelihood(one) >= likelihood(two)
        hi, lo = np.where(left, two, hi), np.where(left, lo, one)
    return (lo + hi) / 2


def set_hash(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the sets h[at[k]:at[k+1]], none of them empty."""
    return T.mix(np.add.reduceat(T.mix(h + U64(1)), at[:-1]) + np.diff(at).astype(U64)).view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, handle, hash of its set, size of the set, registers) of every document; nulls where it has no word."""
    for batch in batches:
        data, offsets = T.utf8(batch.column(2))
        for i, j in T.blocks(data, offsets, 1 << 21):
            h, doc = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            size = np.bincount(doc, minlength=j - i)
            rows, none = np.flatnonzero(size), size == 0
            at = np.concatenate([[0], np.cumsum(size[rows])])
            sid = np.zeros(j - i, np.int64)
            body, ends = b"", np.zeros(j - i + 1, np.int32)
            if len(rows):
                sid[rows] = set_hash(h, at)
                body = sketch(h, np.searchsorted(rows, doc), len(rows)).tobytes()
                ends[1:] = np.cumsum(~none) * (2 * REGISTERS)
            sk = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(body)])
            yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(sid, mask=none), pa.array(size.astype(np.int64)), sk], ["id", "h", "sid", "n", "sk"])


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(T.utf8(column.cast(pa.binary()).view(pa.string()))[0], np.uint16).reshape(-1, REGISTERS)


def _bands(parts: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            reg = _registers(batch.column(1)).astype(U64).reshape(-1, BANDS, ROWS)
            key = np.zeros(reg.shape[:2], U64)
            for r in range(ROWS):
                key = key << U64(16) | reg[:, :, r]
            key = T.mix(key ^ T.mix(np.arange(1, BANDS + 1, dtype=U64))).reshape(-1)
            yield key, np.repeat(np.asarray(batch.column(0)), BANDS)

    return lambda batches: blobs.scatter_all(keys(batches), parts)


def _lists(gid: np.ndarray, flat: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    at = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
    return pa.record_batch([pa.array(gid.view(np.int64)), pa.ListArray.from_arrays(at, pa.array(flat.view(np.int64)))], ["gid", "members"])


def _cells(members: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """A bucket as lists of any two of its blocks, so that every pair is in a list."""
    parts = np.array_split(members, -(-len(members) // block))
    for k, one in enumerate(parts):
        for two in parts[k + 1 :]:
            both = np.concatenate([one, two])
            yield _lists(T.mix(T.mix(both).sum(keepdims=True) + U64(len(both))), both, np.array([len(both)]))


def _shared_buckets(batches: Iterator[pa.RecordBatch], block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Member lists of the band buckets of two documents or more, each list once; of more than two blocks, by pairs of blocks."""
    key, doc = blobs.gather(batches, 2)
    order = np.lexsort((doc.view(np.int64), key))
    key, doc = key[order], doc[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([starts, [len(key)]]))
    for k in np.flatnonzero(size > 2 * block):
        yield from _cells(doc[starts[k] : starts[k] + size[k]], block)
    some = (size > 1) & (size <= 2 * block)
    starts, size = starts[some], size[some]
    if not len(starts):
        return
    inside = np.concatenate([[0], np.cumsum(size)])
    rows = np.repeat(starts - inside[:-1], size) + np.arange(inside[-1])
    member = doc[rows]
    gid = T.mix(np.add.reduceat(T.mix(member), inside[:-1]) + size.astype(U64))
    _, first = np.unique(gid, return_index=True)
    for some in np.array_split(first, max(1, len(first) // 50_000)):
        yield _lists(gid[some], np.concatenate([member[inside[g] : inside[g + 1]] for g in some]), size[some])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups (runs of the first column) from batches sorted by it."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        g = np.asarray(batch.column(0))
        if not len(g):
            continue
        cut = int(np.searchsorted(g == g[-1], True)) if g[0] != g[-1] else 0
        if cut or (kept and np.asarray(kept[-1].column(0))[-1] != g[0]):
            done = [*kept, batch.slice(0, cut)] if cut else kept
            yield pa.Table.from_batches(done)
            kept = [batch.slice(cut)]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept)


def _candidates(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            g, ids, n = (np.asarray(table.column(k).combine_chunks()) for k in range(3))
            reg = _registers(table.column(3).combine_chunks())
            starts = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
            size = np.diff(starts)
            two = starts[:-1][size == 2]
            left, right, est = [two], [two + 1], [jaccard_mle(reg[two], reg[two + 1], n[two], n[two + 1])]
            for s, e in zip(starts[:-1][size > 2], starts[1:][size > 2]):
                attached = np.zeros(e - s, bool)
                joined = np.arange(e - s)  # the cluster that sure links make so far

                def compare(i: int, other: np.ndarray) -> Iterator[np.ndarray]:
                    """Those of `other` that are surely near i."""
                    for part in np.array_split(other, len(other) // 20_000 + 1):
                        j = jaccard_mle(np.broadcast_to(reg[s + i], (len(part), REGISTERS)), reg[s + part], np.full(len(part), n[s + i]), n[s + part])
                        left.append(np.full(len(part), s + i))
                        right.append(s + part)
                        est.append(j)
                        near = part[j >= threshold + SLACK]
                        joined[np.isin(joined, joined[near])] = joined[i]
                        yield near

                for i in range(e - s - 1):
                    if attached[i]:
                        continue
                    for near in compare(i, np.flatnonzero(attached | (np.arange(e - s) > i))):
                        attached[near[near > i]] = True
                for i in np.flatnonzero(attached):  # two attached documents need no comparison only if they are in one cluster
                    other = np.flatnonzero(attached & (joined != joined[i]) & (np.arange(e - s) > i))
                    if len(other):
                        list(compare(i, other))
            a, b, j = np.concatenate(left), np.concatenate(right), np.concatenate(est)
            keep = j >= threshold - SLACK
            a, b = ids[a[keep]], ids[b[keep]]
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["u", "v"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = T.utf8(batch.column(1))
        for i, j in T.blocks(data, offsets):
            h, doc = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            at = np.searchsorted(doc, np.arange(j - i + 1))
            asked = np.asarray(batch.column(0).slice(i, j - i))
            rows = np.flatnonzero(np.diff(at))
            if len(rows):  # a document whose handle happens to be another's has another set
                rows = rows[set_hash(h, np.append(at[rows], len(h))) == asked[rows]]
            yield pa.record_batch([pa.array(asked[rows]), pa.array([h[at[k] : at[k + 1]].tobytes() for k in rows], pa.binary())], ["sid", "s"])


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for batch in batches:
            u, v = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            keep = []
            for k in range(len(u)):
                s = np.frombuffer(batch.column(2)[k].as_buffer(), U64)
                if v[k] == u[k]:
                    hub, hub_set = u[k], s
                    continue
                if hub != u[k]:
                    raise RuntimeError("a pair came without its first document")
                both = len(np.intersect1d(hub_set, s, assume_unique=True))
                if both >= threshold * (len(hub_set) + len(s) - both):
                    keep.append(k)
            yield pa.record_batch([pa.array(u[keep]), pa.array(v[keep])], ["u", "v"])

    return run


def _groups_of(df: DataFrame, spark: SparkSession, text: str, key: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """((id, h, keeper) of the documents that another one stands for, (id, h) of those that several rows repeat); h is a hash of key and text."""
    scratch, parts = Scratch(spark, "neardup"), blobs.buckets(spark)
    kind = df.schema[key].dataType.simpleString()
    docs = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.xxhash64(key, text).alias("h"), F.col(text).alias("t"))
    rows = scratch.write(docs.transform(mapped, _sketches, f"id {kind}, h bigint, sid bigint, n bigint, sk binary"), "sketches")
    reps = scratch.write(rows.where("sid is not null").groupBy("sid").agg(F.max("n").alias("n"), F.min(F.struct("id", "h")).alias("first"), F.first("sk").alias("sk")), "sets")
    proposed = blobs.exchange(reps.select("sid", "sk").transform(mapped, _bands(parts), blobs.SCHEMA), parts)
    lists = proposed.transform(mapped, _shared_buckets, "gid bigint, members array<bigint>").dropDuplicates(["gid"])
    members = lists.select("gid", F.explode("members").alias("sid")).join(reps.select("sid", "n", "sk"), "sid").select("gid", "sid", "n", "sk")
    members = members.repartition(parts, "gid").sortWithinPartitions("gid", "sid")
    edges = scratch.write(members.transform(mapped, _candidates(threshold), "u bigint, v bigint").where("u <> v").distinct(), "candidates")
    slices = edges.groupBy("u").agg(F.ceil(F.count("*") / HUB).cast("int").alias("slices"))
    asked = edges.join(slices, "u").select("u", F.pmod(F.xxhash64("v"), "slices").cast("int").alias("slice"), "v")
    asked = asked.union(slices.select("u", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)), "u"))
    sids = edges.select(F.explode(F.array("u", "v")).alias("sid")).distinct()
    few = sids.count() <= BROADCAST_IDS
    handles = reps.select("sid", F.col("first.h").alias("h")).join(F.broadcast(sids) if few else sids, "sid")
    wanted = docs.join(F.broadcast(handles) if few else handles, "h").select("sid", "t").transform(mapped, _sets, "sid bigint, s binary").groupBy("sid").agg(F.max("s").alias("s"))
    pairs = asked.join(wanted.withColumnRenamed("sid", "v"), "v").select("u", "v", "s", "slice")
    pairs = pairs.repartition(parts, "u", "slice").sortWithinPartitions("u", "slice", "v")  # v >= u: the first row of a slice is u's own
    found = components(pairs.transform(mapped, _verified(threshold), "u bigint, v bigint"), scratch)
    firsts = found.join(reps.select(F.col("sid").alias("node"), "first"), "node")
    keepers = firsts.groupBy("component").agg(F.min("first").alias("keeper"))
    linked = firsts.join(keepers, "component").select(F.col("node").alias("sid"), "keeper")
    by_set = reps.select("sid", "first").join(linked, "sid", "left").select("sid", F.coalesce("keeper", "first").alias("keeper"))
    dropped = rows.where("sid is not null").select("sid", "id", "h").join(by_set, "sid").where(F.struct("id", "h") != F.col("keeper"))
    out = scratch.write(dropped.select("id", "h", F.col("keeper.id").alias("keeper")), "groups")
    known = scratch.write(rows.groupBy("id", "h").count().where("count > 1").select("id", "h"), "repeated")
    scratch.drop("sketches"), scratch.drop("sets"), scratch.drop("candidates")
    return out, known


def near_duplicates(df: DataFrame, spark: SparkSession, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(key, duplicate_of) of every document that has a lower-keyed keeper in its group.

    Two documents are near duplicates when their sets of word shingles have a Jaccard of at
    least `threshold`; a group is a connected component of such pairs, its keeper the lowest
    key, and clean documents aren't returned. Rows without key, or without any word (null,
    empty, punctuation only), are compared with nothing. Keys may be of any type that can be
    ordered. Rows that repeat a key and its text are one document; rows that repeat a key with
    another text are documents of their own, so a key may come with several keepers, and isn't
    returned for a keeper of its own key. Texts are taken whole; other columns aren't read, so
    their names can't clash. An empty table gives an empty result.

    Equal sets collapse to one before anything is compared, so thousands of copies cost no more
    than one. No bucket is capped: in each, every document that isn't surely within the
    threshold of an earlier one is compared with all others of the bucket, and the rest with
    each other unless such sure links already join them; a bucket of more than two BLOCKs is
    compared in as many tasks as it has pairs of blocks.
    """
    dropped, _ = _groups_of(df, spark, text, key, threshold)
    return dropped.where("id <> keeper").select(F.col("id").alias(key), F.col("keeper").alias("duplicate_of")).distinct()


def keep_one(df: DataFrame, spark: SparkSession, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that stay, with all their columns: one of each group of near_duplicates().

    Of rows that repeat a key and its text one stays, the one whose columns come first as JSON;
    rows that repeat a key with texts that aren't near duplicates all stay, and so do rows
    without key. Extra columns of any name are kept as they are.
    """
    dropped, repeated = _groups_of(df, spark, text, key, threshold)
    h, gone, gone_h, n, at = free(df, "h", "gone", "gone_h", "n", "json")
    rows = df.withColumn(h, F.xxhash64(key, text))

    def of(pairs: DataFrame) -> tuple[DataFrame, F.Column]:
        """Handles and keys for a join by handle, sent to all executors if they are few: the texts needn't be shuffled then."""
        other = pairs.select(F.col("id").alias(gone), F.col("h").alias(gone_h))
        other = F.broadcast(other) if pairs.count() <= BROADCAST_IDS else other
        return other, (F.col(h) == F.col(gone_h)) & (F.col(key) <= F.col(gone)) & (F.col(key) >= F.col(gone))  # the handle alone is a word, which keeps the table small

    drop, same = of(dropped)
    kept = rows.join(drop, same, "left_anti")
    if repeated.isEmpty():
        return kept.drop(h)
    again, same = of(repeated)
    order = Window.partitionBy(key, h).orderBy(at)
    first = kept.join(again, same, "left_semi").withColumn(at, F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).withColumn(n, F.row_number().over(order))
    return kept.join(again, same, "left_anti").drop(h).unionByName(first.where(F.col(n) == 1).drop(h, at, n))
