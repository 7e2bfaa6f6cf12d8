"""Mixing sources to target weights by soft membership.

A softmax classifier of a labelled table predicts each document's domain posteriors. Nonnegative
document rates are fitted by projected-gradient least squares so that the expected tokens of each
domain, the sum of rate x tokens x posterior, meet its target. Of the rates that do, those nearest
to 1 are sought (a slight pull makes them unique). The objective depends on the documents only
through one sum for each domain, so a step is one pass over a narrow table and sends a handful of
numbers. Steps are summed before they are projected, so the rates follow from the sum alone, are
never stored, and don't depend on the way the iteration took.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .features import bounded_sample, frequencies, gram_matrix, gram_scores, sums
from .lean import mapped
from .store import Scratch

U64 = np.uint64
TARGETS = {"good": 0.85, "low": 0.10, "toxic": 0.05}
#: Labelled documents that the classifier is fitted to, at most about this many.
SAMPLE = 4000
GRAM, GRAM_BITS, WORD_BITS = 3, 10, 18
#: Word buckets that tell the domains of the sample apart best; the others have no weight.
WORDS = 256
ITERATIONS, TOLERANCE = 60, 1e-5
#: Weight of the distance of rates from 1 against that of shares from targets.
PULL = 1e-7


@dataclass
class Domains:
    """Softmax over mean n-gram and word weights; an untrained one gives the prior."""

    names: list[str]
    grams: np.ndarray
    words: np.ndarray
    bias: np.ndarray


def _word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, doc, _, _ = T.words(T.fold(data), offsets)
    return (h >> U64(64 - WORD_BITS)).astype(np.int64), doc


def _telling(ids: np.ndarray, doc: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Up to WORDS buckets, in order, whose share of documents differs most from the average in some class, by z-score."""
    pair = np.unique(doc << WORD_BITS | ids)
    bucket, row = pair & (1 << WORD_BITS) - 1, pair >> WORD_BITS
    n, size = len(y), np.maximum(y.sum(0), 1)
    share = np.bincount(bucket, minlength=1 << WORD_BITS) / max(n, 1)
    z = np.zeros(1 << WORD_BITS)
    for c in range(y.shape[1]):
        inside = np.bincount(bucket, y[row, c], 1 << WORD_BITS) / size[c]
        z = np.maximum(z, np.abs(inside - share) / np.sqrt(share * (1 - share) / size[c] + 1 / size[c] ** 2))
    top = np.argsort(-z, kind="stable")[:WORDS]
    return np.sort(top[z[top] > 0])


def fit(texts: pa.Array, labels: list[str], names: list[str], epochs: int = 60, rate: float = 0.05, decay: float = 3e-5, seed: int = 3) -> Domains:
    """Multinomial logistic regression by Adam on standardised frequencies; classes weigh as they occur.

    The rate falls to nothing, so that the biases settle: the mean posterior is the classes' share then.
    """
    k = len(names)
    data, offsets = T.utf8(texts)
    n = len(offsets) - 1
    if n == 0:
        return Domains(names, np.zeros((1 << GRAM_BITS, k), np.float32), np.zeros((1 << WORD_BITS, k), np.float32), np.zeros(k))
    y = np.eye(k, dtype=np.float32)[[names.index(v) for v in labels]]
    w_id, w_doc = _word_features(data, offsets)
    at = np.searchsorted(w_doc, np.arange(n + 1))
    chosen = _telling(w_id, w_doc, y)
    place = np.full(1 << WORD_BITS, len(chosen))
    place[chosen] = np.arange(len(chosen))
    bits = max(1, int(len(chosen)).bit_length())
    w = frequencies(place[w_id], at, bits)[:, : len(chosen)]
    x = np.concatenate([gram_matrix(data, offsets, GRAM, GRAM_BITS), w], 1)
    scale = 1 / (np.sqrt((x * x).mean(0)) + 1e-3)
    scale /= np.sqrt(((x * scale) ** 2).sum(1).mean())
    x *= scale
    weight, bias = np.zeros((x.shape[1], k), np.float32), np.zeros(k, np.float32)
    m, v, mb, vb, step = np.zeros_like(weight), np.zeros_like(weight), np.zeros_like(bias), np.zeros_like(bias), 0
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        order, slower = rng.permutation(n), rate * (1 - epoch / epochs)
        for at in range(0, n, 128):
            rows = order[at : at + 128]
            z = x[rows] @ weight + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            e = (p - y[rows]) / len(rows)
            gw, gb, step = x[rows].T @ e + decay * weight, e.sum(0), step + 1
            for value, grad, a, b in ((weight, gw, m, v), (bias, gb, mb, vb)):
                a += 0.1 * (grad - a)
                b += 0.001 * (grad * grad - b)
                value -= slower * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    table = weight * scale[:, None]
    words = np.zeros((1 << WORD_BITS, k), np.float32)
    words[chosen] = table[1 << GRAM_BITS :]
    return Domains(names, table[: 1 << GRAM_BITS].astype(np.float32), words, bias.astype(np.float64))


def posteriors(model: Domains, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(domain posteriors, word counts) of each text; an empty text has the bias's posterior and 0 words."""
    data, offsets = T.utf8(texts)
    n = len(offsets) - 1
    z = gram_scores(data, offsets, model.grams, GRAM, GRAM_BITS)[0] + model.bias
    count = np.zeros(n, np.int64)
    for i, j in T.blocks(data, offsets):
        ids, doc = _word_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        at = np.searchsorted(doc, np.arange(j - i + 1))
        count[i:j] = np.diff(at)
        for c in range(z.shape[1]):
            z[i:j, c] += sums(np.ascontiguousarray(model.words[:, c])[ids], at) / np.maximum(np.diff(at), 1)
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True), count


def domain_of(quality: str = "quality", toxic: str = "toxic"):
    """Domain of a labelled row: toxic before low before good; null if neither label is known."""
    return F.when(F.col(toxic) == 1, "toxic").when(F.col(quality) == 0, "low").when(F.col(quality) == 1, "good")


def train(docs: DataFrame, labels: DataFrame, names: list[str], text: str = "text", key: str = "doc_id", sample: int = SAMPLE, label_key: str = "doc_id") -> Domains:
    """A classifier of a bounded sample of the labelled documents; labels without document, or of other domains, don't count."""
    known = labels.select(F.col(label_key).alias("k"), domain_of().alias("l")).where(F.col("l").isin(names) & F.col("k").isNotNull()).dropDuplicates(["k"])
    picked = bounded_sample(known, "k", sample)
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t") > 0)
    table = texts.join(F.broadcast(picked), "k").toArrow().sort_by([("k", "ascending"), ("t", "ascending")])
    return fit(table["t"].combine_chunks() if len(table) else pa.array([], pa.string()), table["l"].to_pylist(), names)


def rates(p: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
    """Rates after the gradient steps of `history` from 1, projected on what isn't negative.

    A step is taken in the metric that weighs a document by its tokens, in which the gradient of
    a document is posterior . residual whatever its length.
    """
    return np.maximum(1.0 - p @ np.sum(history, 0), 0.0) if len(history) else np.ones(len(p))


@dataclass
class Fit:
    """What rebuilds the rates: the steps of the iterations; `met` are the shares reached."""

    history: list[np.ndarray]
    met: np.ndarray


def solve(weights: DataFrame, names: list[str], targets: dict[str, float], iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> Fit:
    """Fit rates over (n, p): least squares of the domains' token shares, with the corpus size as budget.

    Residuals are scaled by the inverse second moments of the posteriors of the documents whose
    rate is positive: a projected gradient in a variable metric that needs few steps however
    correlated domains are. A step that doesn't bring the rates nearer to the optimum is taken
    back and tried again at a quarter of its length. Ends when the largest residual is below the
    tolerance; targets out of reach are approached as far as the pull to 1 allows.
    """
    k = len(names)
    total = weights.agg(F.sum("n")).first()[0] or 0
    if not total:
        return Fit([], np.zeros(k))
    goal = np.array([targets[x] for x in names]) / sum(targets.values())
    columns = [f"s{i}" for i in range(k + k * k + 1)]

    def reached(past: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, float]:
        """Shares reached, the moments of the documents with a positive rate, and the objective of the sum of steps."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(k + k * k + 1)
            for b in batches:
                p, n = np.asarray(b.column(1).flatten()).reshape(-1, k), np.asarray(b.column(0)).astype(np.float64)
                r = rates(p, past)
                out[:k] += (n * r) @ p
                out[k:-1] += ((p * (n * (r > 0))[:, None]).T @ p).reshape(-1)
                out[-1] += n @ (r * r) / 2
            yield pa.record_batch([[x] for x in out], columns)

        rows = weights.select("n", "p").transform(mapped, run, ", ".join(f"{c} double" for c in columns))
        all_sums = np.array(list(rows.agg(*[F.sum(c) for c in columns]).first())) / total
        at = np.sum(past, 0) if past else np.zeros(k)
        return all_sums[:k], all_sums[k:-1].reshape(k, k), all_sums[-1] + goal @ at + PULL / 2 * at @ at

    history: list[np.ndarray] = []
    met, moments, value = reached(history)
    full, scale, spent = moments, 1.0, 0
    while spent < iterations:
        residual = met - goal - PULL * (np.sum(history, 0) if history else np.zeros(k))
        if np.abs(residual).max() < tolerance:
            break
        metric = moments if np.trace(moments) > 1e-9 * np.trace(full) else full
        step = np.linalg.solve(metric + PULL * np.eye(k), residual)
        while spent < iterations:
            trial, spent = [*history, scale * step], spent + 1
            met_then, moments_then, value_then = reached(trial)
            if value_then <= value - 1e-4 * scale * (step @ residual):
                history, met, moments, value, scale = trial, met_then, moments_then, value_then, min(1.0, 4 * scale)
                break
            scale /= 4
            if scale < 1e-6:
                return Fit(history, met)
    return Fit(history, met)


def _weigh(model, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, n = posteriors(model.value, b.column(1))
            yield pa.record_batch([b.column(0), pa.array(n), pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, k), pa.int32()), pa.array(p.reshape(-1)))], ["k", "n", "p"])

    return run


def document_rates(df: DataFrame, labels: DataFrame, spark: SparkSession, targets: dict[str, float] = TARGETS, text: str = "text", key: str = "doc_id", sample: int = SAMPLE, label_key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, p_<domain>..., rate) of every row; a token is a word (see text.py), as byte pairs would cost eight times the rest.

    Null and empty texts have no tokens: they bear on no target, and their rate follows from the
    prior's posterior like any other's. Null keys stay null; repeated rows are weighed each, and
    get equal rates. Without any labelled document the posteriors are even. Other columns
    aren't read. An empty table gives an empty one. A target that no document can serve is
    approached as far as least squares allows.
    """
    names = sorted(targets)
    model = spark.sparkContext.broadcast(train(df, labels, names, text, key, sample, label_key))
    scratch, k = Scratch(spark, "mixing"), len(names)
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(F.col(key).alias("k"), F.col(text).alias("t")).transform(mapped, _weigh(model, k), f"k {kind}, n bigint, p array<double>")
    weights = scratch.write(docs, "weights")
    found = solve(weights, names, targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.asarray(b.column(2).flatten()).reshape(-1, k)
            yield pa.record_batch([b.column(0), b.column(1), *[pa.array(p[:, i]) for i in range(k)], pa.array(rates(p, found.history))], ["k", "n", *[f"p{i}" for i in range(k)], "r"])

    out = weights.transform(mapped, run, f"k {kind}, n bigint, {', '.join(f'p{i} double' for i in range(k))}, r double")
    return out.select(F.col("k").alias(key), F.col("n").alias("n_tokens"), *[F.round(f"p{i}", 6).alias(f"p_{x}") for i, x in enumerate(names)], F.round("r", 6).alias("rate"))


def mix(df: DataFrame, labels: DataFrame, spark: SparkSession, targets: dict[str, float] = TARGETS, text: str = "text", key: str = "doc_id", sample: int = SAMPLE, label_key: str = "doc_id") -> DataFrame:
    """The rows, each repeated by its rate: the whole part, and once more with the probability of the rest.

    The chance is a hash of key and text, so it is the same at each run; rows that repeat share
    it. All columns are kept. See document_rates for the special cases.
    """
    names = sorted(targets)
    model = spark.sparkContext.broadcast(train(df, labels, names, text, key, sample, label_key))
    scratch = Scratch(spark, "mixing")
    docs = df.select(F.col(key).alias("k"), F.col(text).alias("t")).transform(mapped, _weigh(model, len(names)), f"k {df.schema[key].dataType.simpleString()}, n bigint, p array<double>")
    found = solve(scratch.write(docs.select("n", "p"), "weights"), names, targets)
    at, extra = df.columns.index(text), F.pmod(F.xxhash64(F.lit("mixing"), F.col(key), F.col(text)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, _ = posteriors(model.value, b.column(at))
            copies = np.floor(rates(p, found.history) + np.asarray(b.column(b.num_columns - 1))).astype(np.int64)
            yield b.select(list(range(b.num_columns - 1))).take(pa.array(np.repeat(np.arange(b.num_rows), copies)))

    chance = "__chance"
    while chance in {c.lower() for c in df.columns}:
        chance = "_" + chance
    return df.withColumn(chance, extra).transform(mapped, run, df.schema)
