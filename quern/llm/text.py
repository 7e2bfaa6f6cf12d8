"""Vectorised text primitives over Arrow buffers: no Python object per word.

Words are maximal runs of ASCII letters, digits, underscore and non-ASCII letters, with ASCII
and Latin-1 letters folded to lower case. General punctuation (U+2000-U+207F), Latin-1 signs
(U+0080-U+00BF) and CJK punctuation separate words; every CJK or astral character is its own word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Bytes of text that one step works on; whole documents, so a longer one is a step of its own.
BLOCK = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], U64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0 or column.null_count == n:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def blocks(data: np.ndarray, offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` bytes, at least one document each."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def fold(data: np.ndarray) -> np.ndarray:
    """A copy in lower case (ASCII and the letters of Latin-1)."""
    out = _FOLD[data]
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[lead + 1 < len(data)] + 1
    low = data[lead]
    lead = lead[(low >= 0x80) & (low <= 0x9E) & (low != 0x97)]
    out[lead] += 32
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of folded bytes; no word crosses documents."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = _WORD[data]
    high = np.flatnonzero(data >= 0xC2)
    cut = np.zeros(0, np.int64)
    if len(high):
        lead = data[high]
        second = data[np.minimum(high + 1, n - 1)]
        at = high[lead == 0xC2]
        word[at] = False
        word[np.minimum(at + 1, n - 1)] = False
        at = high[(lead == 0xE2) & ((second | 1) == 0x81) | (lead == 0xE3) & (second == 0x80)]
        for k in range(3):
            word[np.minimum(at + k, n - 1)] = False
        one = (lead >= 0xE3) & (lead <= 0xED) | (lead >= 0xF0)
        at, width = high[one], np.where(lead[one] >= 0xF0, 4, 3)
        cut = np.concatenate([at, at + width])
    begin = np.empty(n + 1, bool)
    begin[0], begin[n] = True, True
    np.logical_not(word[:-1], out=begin[1:n])
    begin[offsets] = True
    begin[cut[cut < n]] = True
    starts = np.flatnonzero(begin[:n] & word)
    ends = np.flatnonzero(word & np.concatenate([begin[1:n] | ~word[1:], [True]])) + 1
    return starts, ends


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, read eight bytes at a time."""
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = mix((wide[starts] & _MASK[np.minimum(size, 8)]) + size.astype(U64) * U64(0x9E3779B97F4A7C15))
    live = np.flatnonzero((size > 8) & (size <= 256))
    k = 8
    while len(live):
        left = size[live] - k
        out[live] = mix(out[live] * U64(0x9E3779B97F4A7C15) + (wide[starts[live] + k] & _MASK[np.minimum(left, 8)]))
        live, k = live[left > 8], k + 8
    for i in np.flatnonzero(size > 256):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, start, end) of every word of folded bytes."""
    starts, ends = word_spans(data, offsets)
    doc = np.searchsorted(offsets, starts, "right") - 1
    return word_hashes(data, starts, ends), doc, starts, ends


def shingles(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every run of k words; a document of fewer words is one run."""
    n = len(hashes)
    if n == 0:
        return hashes, doc
    total = np.zeros(n, U64)
    whole = np.ones(n, bool)
    for j in range(k):
        inside = np.zeros(n, bool)
        if j < n:
            inside[: n - j] = doc[: n - j] == doc[j:]
            part = np.zeros(n, U64)
            part[: n - j] = hashes[j:] * U64((0x9E3779B97F4A7C15 * (2 * j + 1)) % 2**64 | 1)
            total += np.where(inside, part, U64(0))
        whole &= inside
    first = np.ones(n, bool)
    first[1:] = doc[1:] != doc[:-1]
    keep = whole | first
    return mix(total[keep]), doc[keep]
