"""Hierarchical language identification.

The family is predicted first, then one-versus-one linear support vector machines vote between
the related languages of that family. Features are relative frequencies of hashed byte trigrams
over the whole folded text, so a score is a mean of table entries and any length takes one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .features import bounded_sample, gram_matrix, gram_scores, sums
from .lean import mapped

FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "es": "romance", "fr": "romance", "it": "romance", "pt": "romance"}
#: Labelled rows that the machines are fitted to, at most about this many.
SAMPLE = 2000
BITS, GRAM = 13, 3
#: Below this margin of the family or of the language's closest vote a text is undetermined ("und").
MARGIN = 0.02
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 256)]] = True
_SPACE = np.full(256, 32, np.uint8)
_SPACE[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]


def normal(data: np.ndarray) -> np.ndarray:
    """Folded bytes with everything but letters as spaces."""
    return _SPACE[T.fold(data)]


@dataclass
class Model:
    """One column of `table` per machine: one against the rest per family, one per pair of languages of a family."""

    families: list[str]
    members: dict[str, list[str]]
    machines: list[tuple[str, str, str]]  # family or "", first, second
    table: np.ndarray
    bias: np.ndarray


def svm(x: np.ndarray, y: np.ndarray, epochs: int = 12, cost: float = 10.0, seed: int = 7) -> tuple[np.ndarray, float]:
    """Linear support vector machine (L2 loss) by dual coordinate descent; classes weigh the same."""
    x1 = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    upper = np.where(y > 0, len(y) / 2 / max(1, (y > 0).sum()), len(y) / 2 / max(1, (y < 0).sum())) * cost
    square = (x1 * x1).sum(1) + 1 / (2 * upper)
    alpha, w, rng = np.zeros(len(y)), np.zeros(x1.shape[1]), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            step = y[i] * (x1[i] @ w) - 1 + alpha[i] / (2 * upper[i])
            new = max(0.0, alpha[i] - step / square[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x1[i]
                alpha[i] = new
    return w[:-1], float(w[-1])


def fit(texts: pa.Array, labels: list[str], families: dict[str, str] = FAMILIES) -> Model:
    """Machines of all families and of all pairs within one; a language of no known family is its own."""
    data, offsets = T.utf8(texts)
    x = gram_matrix(normal(data), offsets, GRAM, BITS)
    scale = 1 / np.maximum(np.sqrt((x * x).sum(1)).mean() if len(x) else 1.0, 1e-9)
    x *= scale
    lang = np.array(labels, object)
    members: dict[str, list[str]] = {}
    for name in sorted(set(labels)):
        members.setdefault(families.get(name, name), []).append(name)
    names = sorted(members)
    family = np.array([families.get(k, k) for k in labels], object)
    machines, columns, bias = [], [], []

    def add(key: tuple[str, str, str], rows: np.ndarray, positive: np.ndarray) -> None:
        w, b = svm(x[rows], np.where(positive, 1.0, -1.0))
        machines.append(key)
        columns.append(w * scale)
        bias.append(b)

    if len(names) == 2:
        add(("", names[0], names[1]), np.arange(len(x)), family == names[0])
    elif len(names) > 2:
        for k in names:
            add(("", k, ""), np.arange(len(x)), family == k)
    for k in names:
        for a, b in combinations(members[k], 2):
            rows = np.flatnonzero((lang == a) | (lang == b))
            add((k, a, b), rows, lang[rows] == a)
    return Model(names, members, machines, np.stack(columns, 1).astype(np.float32) if columns else np.zeros((1 << BITS, 0), np.float32), np.array(bias))


def predict(model: Model, texts: pa.Array, margin: float = MARGIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, family, confidence) of each text; "und" where it has no letter or its margin is too small."""
    data, offsets = T.utf8(texts)
    n = len(offsets) - 1
    scores, letters = np.zeros((n, len(model.machines))), np.zeros(n)
    for i, j in T.blocks(data, offsets):  # a block at a time, so that no array grows with the batch
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        scores[i:j] = gram_scores(normal(part), at, model.table, GRAM, BITS)[0]
        letters[i:j] = sums(_LETTER[part], at)
    scores += model.bias
    top = {key: scores[:, k] for k, key in enumerate(model.machines) if key[0] == ""}
    if not model.families:
        chosen, sure = np.zeros(n, np.int64), np.zeros(n)
    elif len(model.families) == 1:
        chosen, sure = np.zeros(n, np.int64), np.ones(n)
    elif len(model.families) == 2:
        s = next(iter(top.values()))
        chosen, sure = (s < 0).astype(np.int64), np.abs(s)
    else:
        s = np.stack([top["", k, ""] for k in model.families], 1)
        chosen, sure = s.argmax(1), (np.sort(s, 1)[:, -1] - np.sort(s, 1)[:, -2]) / 2
    lang, family = np.full(n, "und", object), np.full(n, "und", object)
    for f, name in enumerate(model.families):
        rows = np.flatnonzero(chosen == f)
        langs = model.members[name]
        votes = np.zeros((len(rows), len(langs)))
        total = np.zeros((len(rows), len(langs)))
        least = np.full((len(rows), len(langs)), np.inf)
        for k, (where, a, b) in enumerate(model.machines):
            if where == name:
                s = scores[rows, k]
                for one, sign in ((langs.index(a), s), (langs.index(b), -s)):
                    votes[:, one] += sign > 0
                    total[:, one] += sign
                    least[:, one] = np.minimum(least[:, one], sign)
        best = np.lexsort((np.arange(len(langs))[None].repeat(len(rows), 0), -total, -votes), 1)[:, 0] if len(rows) else np.zeros(0, np.int64)
        lang[rows] = np.array(langs, object)[best]
        family[rows] = name
        if len(langs) > 1:
            sure[rows] = np.minimum(sure[rows], least[np.arange(len(rows)), best])
    no = (letters == 0) | (sure < margin)
    lang[no] = "und"
    family[letters == 0] = "und"
    return lang, family, np.where(letters == 0, 0.0, np.maximum(sure, 0.0))


def train(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", sample: int = SAMPLE, families: dict[str, str] = FAMILIES) -> Model:
    """A model of a bounded sample of the labelled rows; rows without label or text don't count."""
    rows = labelled.where(F.col(label).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).alias("l"))
    table = bounded_sample(rows, "k", sample).toArrow().sort_by("k")
    return fit(table["t"].combine_chunks() if len(table) else pa.array([], pa.string()), table["l"].to_pylist(), families)


def language_id(df: DataFrame, spark: SparkSession, model: Model, text: str = "text", key: str = "doc_id", margin: float = MARGIN) -> DataFrame:
    """(key, predicted_lang, family, confidence) of every row, in one scan without a shuffle.

    Null, empty and letterless texts are "und" with confidence 0; so is, with its confidence, a
    text nearer than `margin` to a separating plane. Repeated rows give repeated results, and
    other columns aren't read. An empty table gives an empty one; an empty model gives "und".
    """
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, family, sure = predict(shared.value, b.column(1), margin)
            yield pa.record_batch([b.column(0), pa.array(lang, pa.string()), pa.array(family, pa.string()), pa.array(sure, pa.float64())], ["k", "l", "f", "c"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).transform(mapped, run, f"k {kind}, l string, f string, c double")
    return out.select(F.col("k").alias(key), F.col("l").alias("predicted_lang"), F.col("f").alias("family"), F.round("c", 6).alias("confidence"))


def keep_identified(df: DataFrame, spark: SparkSession, model: Model, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows whose language is determined, with all their columns; "und" rows go (see language_id)."""
    shared, at = spark.sparkContext.broadcast(model), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(predict(shared.value, b.column(at), margin)[0] != "und", pa.bool_()))

    return df.transform(mapped, run, df.schema)
