"""A progressive JPEG encoder, with which tables without pictures get a media column, and tests a round trip."""

from __future__ import annotations

import heapq
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lean import mapped
from .media import COSINE, ZIGZAG

_LUMA = np.array([16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99])
#: (components, Ss, Se, Ah, Al): both kinds of progression, on luma and chroma.
SCRIPT = [((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 2), ((2,), 1, 63, 0, 1), ((1,), 1, 63, 0, 1), ((0,), 6, 63, 0, 2), ((0,), 1, 63, 2, 1), ((0, 1, 2), 0, 0, 1, 0), ((2,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((0,), 1, 63, 1, 0)]


def _code(symbols: Counter) -> tuple[bytes, bytes, dict[int, tuple[int, int]]]:
    """Huffman code lengths of up to 16 bits without the code of all ones; (counts, symbols, code by symbol)."""
    heap = [(n, k, (s,)) for k, (s, n) in enumerate(sorted(symbols.items()))] + [(0, 1 << 20, (-1,))]
    heapq.heapify(heap)
    length: Counter = Counter()
    fresh = 1 << 21
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            length[s] += 1
        heapq.heappush(heap, (a[0] + b[0], fresh, a[2] + b[2]))
        fresh += 1
    if max(length.values(), default=1) > 16:
        length = Counter({s: 8 for s in symbols})
    order = sorted((n, s) for s, n in length.items() if s >= 0)
    code, last, out, counts = 0, 0, {}, [0] * 16
    for n, s in order:
        code <<= n - last
        out[s], last = (code, n), n
        counts[n - 1] += 1
        code += 1
    return bytes(counts), bytes(s for _, s in order), out


class _Writer:
    """Symbols and raw bits of a scan, in order."""

    def __init__(self):
        self.items: list[tuple[int, int, int]] = []  # symbol or -1, bits, number of bits
        self.eob, self.kept = 0, []

    def symbol(self, s: int, bits: int = 0, n: int = 0) -> None:
        self.items.append((s, bits, n))

    def flush(self) -> None:
        if self.eob:
            n = self.eob.bit_length() - 1
            self.symbol(n << 4, self.eob & (1 << n) - 1, n)
            self.eob = 0
            self.raw(self.kept)
            self.kept = []

    def raw(self, bits: list[int]) -> None:
        self.items += [(-1, b, 1) for b in bits]

    def body(self, code: dict) -> bytes:
        value = n = 0
        for s, bits, k in self.items:
            if s >= 0:
                c, size = code[s]
                value, n = value << size | c, n + size
            value, n = value << k | bits, n + k
        pad = -n % 8
        return (value << pad | (1 << pad) - 1).to_bytes((n + pad) // 8, "big").replace(b"\xff", b"\xff\x00")


def _magnitude(v: int) -> tuple[int, int]:
    n = abs(v).bit_length()
    return (v if v >= 0 else v + (1 << n) - 1), n


def _ac_first(w: _Writer, z: list[int], ss: int, se: int, al: int) -> None:
    r = 0
    for k in range(ss, se + 1):
        v = abs(z[k]) >> al
        if not v:
            r += 1
            continue
        w.flush()
        while r > 15:
            w.symbol(0xF0)
            r -= 16
        bits, n = _magnitude(v if z[k] > 0 else -v)
        w.symbol(r << 4 | n, bits, n)
        r = 0
    if r:
        w.eob += 1
        if w.eob == 0x7FFF:
            w.flush()


def _ac_refine(w: _Writer, z: list[int], ss: int, se: int, al: int) -> None:
    size = [abs(v) >> al for v in z]
    last = max([k for k in range(ss, se + 1) if size[k] == 1], default=-1)
    r, pending = 0, []
    for k in range(ss, se + 1):
        if not size[k]:
            r += 1
            continue
        while r > 15 and k <= last:
            w.flush()
            w.symbol(0xF0)
            w.raw(pending)
            pending, r = [], r - 16
        if size[k] > 1:
            pending.append(size[k] & 1)
            continue
        w.flush()
        w.symbol(r << 4 | 1, int(z[k] > 0), 1)
        w.raw(pending)
        pending, r = [], 0
    if r or pending:
        w.eob += 1
        w.kept += pending
        if w.eob == 0x7FFF or len(w.kept) > 900:
            w.flush()


def quantised(rgb: np.ndarray, scale: float) -> tuple[list[tuple[int, int, int, int, list[list[int]]]], np.ndarray]:
    """((h, v, rows, columns, zigzag blocks) of Y, Cb, Cr at 4:2:0, quantiser)."""
    height, width = rgb.shape[:2]
    r, g, b = (rgb[..., k].astype(np.float64) for k in range(3))
    ycc = np.stack([0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b])
    ycc = np.pad(ycc, ((0, 0), (0, -height % 16), (0, -width % 16)), "edge")
    q = np.clip(np.rint(_LUMA * scale), 1, 255)
    out = []
    for k in range(3):
        plane = ycc[k] if k == 0 else ycc[k].reshape(ycc.shape[1] // 2, 2, ycc.shape[2] // 2, 2).mean((1, 3))
        rows, columns = plane.shape[0] // 8, plane.shape[1] // 8
        block = (plane - 128).reshape(rows, 8, columns, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        z = np.rint((COSINE @ block @ COSINE.T).reshape(-1, 64) / q)[:, ZIGZAG].astype(int).tolist()
        out.append((2 if k == 0 else 1, 2 if k == 0 else 1, rows, columns, z))
    return out, q[ZIGZAG].astype(np.uint8)


def encode(rgb: np.ndarray, scale: float = 0.4, restart: int = 0) -> bytes:
    """A progressive JPEG of an RGB tensor, chroma at half resolution."""
    height, width = rgb.shape[:2]
    parts, q = quantised(rgb, scale)
    marker = lambda m, body: bytes([0xFF, m]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + marker(0xDB, b"\x00" + q.tobytes())
    out += marker(0xC2, struct.pack(">BHHB", 8, height, width, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00")
    if restart:
        out += marker(0xDD, struct.pack(">H", restart))
    for chosen, ss, se, ah, al in SCRIPT:
        units = []
        if len(chosen) > 1:
            for my in range(parts[1][2]):
                for mx in range(parts[1][3]):
                    units.append([(k, (my * parts[k][1] + y) * parts[k][3] + mx * parts[k][0] + x) for k in chosen for y in range(parts[k][1]) for x in range(parts[k][0])])
        else:
            k = chosen[0]
            f = 1 if k == 0 else 2
            units = [[(k, y * parts[k][3] + x)] for y in range(-(-(-(-height // f)) // 8)) for x in range(-(-(-(-width // f)) // 8))]
        writers, step = [], restart or len(units)
        for at in range(0, len(units), step):
            w, before = _Writer(), [0, 0, 0]
            for unit in units[at : at + step]:
                for k, n in unit:
                    z = parts[k][4][n]
                    if ss == 0 and ah:
                        w.raw([z[0] >> al & 1])
                    elif ss == 0:
                        v = z[0] >> al
                        bits, size = _magnitude(v - before[k])
                        w.symbol(size, bits, size)
                        before[k] = v
                    else:
                        (_ac_refine if ah else _ac_first)(w, z, ss, se, al)
            w.flush()
            writers.append(w)
        counts, symbols, code = _code(Counter(s for w in writers for s, _, _ in w.items if s >= 0) or Counter({0: 1}))
        if not (ss == 0 and ah):
            out += marker(0xC4, bytes([16 if ss else 0]) + counts + symbols)
        out += marker(0xDA, bytes([len(chosen), *[x for k in chosen for x in (k + 1, 0)], ss, se, ah << 4 | al]))
        for k, w in enumerate(writers):
            out += (bytes([0xFF, 0xD0 + (k - 1) % 8]) if k else b"") + w.body(code)
    return out + b"\xff\xd9"


def picture(vector: np.ndarray, height: int = 24, width: int = 20) -> np.ndarray:
    """A small picture of a vector: its values as a coarse grid of three smooth colours."""
    v = np.resize(np.nan_to_num(np.asarray(vector, np.float64)), 64).reshape(8, 8) if len(vector) else np.zeros((8, 8))
    v = np.clip(v * 4, -1, 1)
    y, x = np.linspace(0, 6.999, height), np.linspace(0, 6.999, width)
    iy, ix = y.astype(int), x.astype(int)
    fy, fx = (y - iy)[:, None], (x - ix)[None]
    rgb = []
    for g in (v, v.T, np.roll(v, 3, 0)):
        a = g[iy][:, ix] * (1 - fy) * (1 - fx) + g[iy + 1][:, ix] * fy * (1 - fx) + g[iy][:, ix + 1] * (1 - fy) * fx + g[iy + 1][:, ix + 1] * fy * fx
        rgb.append(np.clip(np.rint(128 + 110 * a), 0, 255))
    return np.stack(rgb, 2).astype(np.uint8)


def pictures(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, jpeg): a progressive JPEG of each vector's picture; null for a null vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [None if v.as_py() is None else encode(picture(np.array(v.as_py(), np.float64))) for v in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(rows, pa.binary())], ["k", "jpeg"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(vector).alias("v")).transform(mapped, run, f"k {kind}, jpeg binary").withColumnRenamed("k", key)
