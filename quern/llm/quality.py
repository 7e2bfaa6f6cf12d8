"""Quality by a byte-level convolutional network in numpy.

Bytes are embedded; filters of WIDTH bytes slide by STRIDE over the whole document; rectified
outputs are max-pooled over overlapping chunks of CHUNK bytes (half a chunk apart); the mean and
the maximum of the chunks' vectors go through one logistic unit to a single probability. Each
position is convolved once, though two chunks pool it. Trained here by back-propagation and Adam.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .features import bounded_sample
from .lean import mapped

EMBED, FILTERS, WIDTH, STRIDE, CHUNK = 8, 24, 8, 4, 512
HALF = CHUNK // 2 // STRIDE
#: Labelled documents that the network is fitted to, at most about this many; whole documents all.
SAMPLE = 1500


@dataclass
class Network:
    embed: np.ndarray  # 257 x EMBED, the last row for the padding
    conv: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS
    base: np.ndarray  # 1


def new_network(seed: int = 11) -> Network:
    rng = np.random.default_rng(seed)
    f = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    return Network(f(257, EMBED, scale=0.5), f(WIDTH * EMBED, FILTERS, scale=0.25), np.zeros(FILTERS, np.float32), f(2 * FILTERS, scale=0.1), np.zeros(1, np.float32))


class Layout:
    """Bytes of documents padded so that every window and chunk stays within one document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        size = np.diff(offsets)
        steps = np.maximum(-(-size // STRIDE), 1)  # positions of a document; windows overhang into padding
        self.first = np.concatenate([[0], np.cumsum(steps + 1)])  # one position of padding behind each
        self.codes = np.full(self.first[-1] * STRIDE, 256, np.int16)
        shift = np.repeat(self.first[:-1] * STRIDE - offsets[:-1], size)
        self.codes[np.arange(len(data)) + shift] = data
        halves = -(-steps // HALF)
        self.half_first = np.concatenate([[0], np.cumsum(halves)])
        inside = np.arange(self.half_first[-1]) - np.repeat(self.half_first[:-1], halves)
        self.half_at = np.repeat(self.first[:-1], halves) + inside * HALF
        self.pad = self.first[1:] - 1
        # chunk c of a document pools halves c and c + 1; a document of one half is one chunk
        self.chunks = np.maximum(halves - 1, 1)
        self.chunk_first = np.concatenate([[0], np.cumsum(self.chunks)])
        within = np.arange(self.chunk_first[-1]) - np.repeat(self.chunk_first[:-1], self.chunks)
        self.left = np.repeat(self.half_first[:-1], self.chunks) + within
        self.right = np.minimum(self.left + 1, np.repeat(self.half_first[1:] - 1, self.chunks))


def forward(net: Network, x: Layout) -> tuple[np.ndarray, tuple]:
    """(logits by document, what backward() needs)."""
    e = net.embed[x.codes].reshape(-1, STRIDE * EMBED)
    k = STRIDE * EMBED
    z = e @ net.conv[:k]
    z[:-1] += (e @ net.conv[k:])[1:]
    z += net.bias
    np.maximum(z, 0, out=z)
    z[x.pad] = 0
    half = np.maximum.reduceat(z, x.half_at, axis=0)
    chunk = np.maximum(half[x.left], half[x.right])
    top = np.maximum.reduceat(chunk, x.chunk_first[:-1], axis=0)
    mean = np.add.reduceat(chunk, x.chunk_first[:-1], axis=0) / x.chunks[:, None].astype(np.float32)
    pooled = np.concatenate([mean, top], 1)
    return pooled @ net.out + net.base, (e, z, half, chunk, top, pooled)


def backward(net: Network, x: Layout, kept: tuple, error: np.ndarray) -> list[np.ndarray]:
    """Gradients of (embed, conv, bias, out, base) for the logits' errors; a tie of maxima shares none: the first takes all."""
    e, z, half, chunk, top, pooled = kept
    d_pool = error[:, None] * net.out[None]
    doc = np.repeat(np.arange(len(x.chunks)), x.chunks)
    d_chunk = (d_pool[:, :FILTERS] / x.chunks[:, None])[doc]
    d_chunk = d_chunk + np.where(_first_equal(chunk, top[doc], doc), d_pool[:, FILTERS:][doc], 0)
    d_half = np.zeros_like(half)
    left = half[x.left] >= half[x.right]
    np.add.at(d_half, x.left, np.where(left, d_chunk, 0))
    np.add.at(d_half, x.right, np.where(left, 0, d_chunk))
    group = np.searchsorted(x.half_at, np.arange(len(z)), "right") - 1
    d_z = np.where(_first_equal(z, half[group], group) & (z > 0), d_half[group], 0).astype(np.float32)
    k = STRIDE * EMBED
    after = np.concatenate([e[1:], np.zeros((1, k), np.float32)])
    d_conv = np.concatenate([e.T @ d_z, after.T @ d_z])
    d_e = d_z @ net.conv[:k].T
    d_e[1:] += d_z[:-1] @ net.conv[k:].T
    d_embed = np.stack([np.bincount(x.codes, d_e.reshape(-1, EMBED)[:, c], 257) for c in range(EMBED)], 1)
    return [d_embed.astype(np.float32), d_conv, d_z.sum(0), (error[:, None] * pooled).sum(0), error.sum(keepdims=True)]


def _first_equal(values: np.ndarray, most: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Where a value is the first of its group (sorted) that equals the group's maximum, by column."""
    hit = values == most
    count = np.cumsum(hit, axis=0, dtype=np.int32)
    start = np.searchsorted(group, group)
    before = count[start] - hit[start]
    return hit & (count - before == 1)


def probabilities(net: Network, texts: pa.Array) -> np.ndarray:
    """Quality of each text over all of its bytes; one without bytes has 0."""
    data, offsets = T.utf8(texts)
    out = np.zeros(len(offsets) - 1)
    for i, j in T.blocks(data, offsets, 1 << 18):
        logits, _ = forward(net, Layout(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
        out[i:j] = 1 / (1 + np.exp(-logits.astype(np.float64)))
    out[np.diff(offsets) == 0] = 0
    return out


def fit(texts: pa.Array, labels: np.ndarray, epochs: int = 10, rate: float = 0.01, batch: int = 24, seed: int = 5) -> Network:
    """A network for labels of 0 and 1; without both of them it gives the share of ones."""
    net, y = new_network(), np.asarray(labels, np.float32)
    if len(y) == 0 or y.min() == y.max():
        net.out[:] = 0
        net.base[:] = 0 if len(y) == 0 else 6 * (2 * y[0] - 1)
        return net
    net.base[:] = np.log(y.mean() / (1 - y.mean()))
    values = [net.embed, net.conv, net.bias, net.out, net.base]
    m, v, step = [np.zeros_like(a) for a in values], [np.zeros_like(a) for a in values], 0
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            data, offsets = T.utf8(texts.take(pa.array(rows)))
            x = Layout(data, offsets)
            logits, kept = forward(net, x)
            error = ((1 / (1 + np.exp(-logits)) - y[rows]) / len(rows)).astype(np.float32)
            step += 1
            for a, g, b, c in zip(values, backward(net, x, kept, error), m, v):
                b += 0.1 * (g - b)
                c += 0.005 * (g * g - c)
                a -= rate * (1 - epoch / epochs) * (b / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.995**step)) + 1e-7)
    return net


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE, label_key: str = "doc_id") -> Network:
    """A network fitted to a bounded sample of the labelled documents with text."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col(label_key).isNotNull()).groupBy(F.col(label_key).alias("k")).agg(F.max("quality").alias("q"))
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t") > 0)
    table = texts.join(F.broadcast(bounded_sample(known, "k", sample)), "k").toArrow().sort_by([("k", "ascending"), ("t", "ascending")])
    return fit(table["t"].combine_chunks() if len(table) else pa.array([], pa.string()), table["q"].to_numpy())


def quality(df: DataFrame, labels: DataFrame, spark: SparkSession, text: str = "text", key: str = "doc_id", sample: int = SAMPLE, label_key: str = "doc_id") -> DataFrame:
    """(key, quality) of every row: the probability that it is good, over all bytes of its text.

    Null and empty texts have quality 0. Null keys stay null, repeated rows give repeated
    results, ties don't matter, and other columns aren't read. Without labels of both kinds
    every text has the one label's probability (0.5 without any). An empty table gives an
    empty one. One scan for the scores without a shuffle, after one for the sample.
    """
    net = spark.sparkContext.broadcast(train(df, labels, text, key, sample, label_key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(probabilities(net.value, b.column(1)))], ["k", "q"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).transform(mapped, run, f"k {kind}, q double")
    return out.select(F.col("k").alias(key), F.round("q", 6).alias("quality"))
