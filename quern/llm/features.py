"""Hashed byte n-grams and words, linear scores over them, and bounded labelled samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

U64 = np.uint64


def bounded_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """About `bound` rows, the same ones at each run: those whose key hashes low enough.

    Only rows that are sampled leave their partition; a table of up to `bound` rows is taken whole.
    """
    share = min(1.0, bound / max(1, df.count()))
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def gram_ids(data: np.ndarray, n: int, bits: int, offsets: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram (n <= 4) that starts at each byte; behind the end of a document there are zeros, whatever follows it."""
    code, ends = data.astype(np.uint32), np.unique(offsets[1:])
    for j in range(1, n):
        code <<= np.uint32(8)
        after = np.zeros(len(data), np.uint8)
        after[: len(data) - j] = data[j:]
        for k in range(1, j + 1):
            after[ends[ends >= k] - k] = 0
        code |= after
    code *= np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA77)
    return code >> np.uint32(32 - bits)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i+1]] along the first axis; empty ranges give 0."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), np.float64)
    some = np.flatnonzero(np.diff(offsets) > 0)
    if len(some):
        out[some] = np.add.reduceat(values, offsets[:-1][some], axis=0, dtype=np.float64)
    return out


def gram_scores(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the table's rows over each document's n-grams, and their number."""
    out = np.zeros((len(offsets) - 1, table.shape[1]))
    for i, j in T.blocks(data, offsets, 1 << 19):
        part = data[offsets[i] : offsets[j]]
        if len(part):
            at = offsets[i : j + 1] - offsets[i]
            ids = gram_ids(part, n, bits, at)
            for c in range(table.shape[1]):
                out[i:j, c] = sums(np.ascontiguousarray(table[:, c])[ids], at)
    size = np.diff(offsets)
    return out / np.maximum(size, 1)[:, None], size


def frequencies(ids: np.ndarray, doc_at: np.ndarray, bits: int) -> np.ndarray:
    """Relative frequency of each bucket by document, whose ids are ids[doc_at[i]:doc_at[i+1]] (for bounded samples)."""
    m = len(doc_at) - 1
    out = np.zeros((m, 1 << bits), np.float32)
    for i in range(m):
        part = ids[doc_at[i] : doc_at[i + 1]]
        if len(part):
            out[i] = np.bincount(part, minlength=1 << bits) / len(part)
    return out


def gram_matrix(data: np.ndarray, offsets: np.ndarray, n: int, bits: int) -> np.ndarray:
    """frequencies() of each document's n-grams."""
    return frequencies(gram_ids(data, n, bits, offsets), offsets, bits)
