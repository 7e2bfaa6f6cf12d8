"""Progressive JPEG to RGB tensors.

Every scan adds to the components' coefficient arrays: spectral selection gives it a band of
coefficients, successive approximation a bit plane. After the last scan all blocks are dequantised
and inverse-transformed in numpy, chroma is upsampled to full resolution, and the colours are
converted. Sequential Huffman files (one scan of everything) go the same way.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lean import mapped

ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
_X = np.arange(8)
#: Rows are the cosine basis, scaled so that the transform is orthonormal.
COSINE = np.cos((2 * _X[None] + 1) * _X[:, None] * np.pi / 16) * np.where(_X == 0, np.sqrt(1 / 8), 0.5)[:, None]
SCHEMA = "height int, width int, rgb binary, error string"
#: Bytes of a tensor at most: what an Arrow binary value can hold, about 715 million pixels.
MOST_BYTES = 2**31 - 1
#: Bytes of tensors that a task holds before it sends them.
BATCH_BYTES = 64 << 20


class JpegError(ValueError):
    pass


class Bits:
    """Bits of one entropy-coded segment; behind its end there are zeros."""

    def __init__(self, data: bytes):
        data = data.replace(b"\xff\x00", b"\xff")
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)
        if len(data) > 64:  # long integers shift slowly: take 48 bytes at a time
            self.data, self.at = data, 0
            self.value, self.left = 0, 0
        else:
            self.data, self.at = b"", 0
        self.over = 0

    def need(self, n: int) -> None:
        while self.left < n:
            part = self.data[self.at : self.at + 48]
            if part:
                self.value = (self.value & (1 << self.left) - 1) << 8 * len(part) | int.from_bytes(part, "big")
                self.left += 8 * len(part)
                self.at += len(part)
            else:
                self.value, self.left, self.over = (self.value & (1 << self.left) - 1) << 64, self.left + 64, self.over + 64

    def take(self, n: int) -> int:
        if self.left < n:
            self.need(n)
        self.left -= n
        return self.value >> self.left & (1 << n) - 1

    def symbol(self, table: "Huffman") -> int:
        if self.left < 16:
            self.need(16)
        hit = table.short[self.value >> self.left - 8 & 255] or table.longer(self.value >> self.left - 16 & 65535)
        self.left -= hit >> 8
        return hit & 255


class Huffman:
    def __init__(self, counts: bytes, symbols: bytes):
        self.short, self.long, code, k = [0] * 256, {}, 0, 0
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                if code >= 1 << n:
                    raise JpegError("too many Huffman codes")
                if n <= 8:
                    low = code << 8 - n
                    self.short[low : low + (1 << 8 - n)] = [n << 8 | symbols[k]] * (1 << 8 - n)
                else:
                    self.long[n, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1

    def longer(self, code: int) -> int:
        """(length << 8 | symbol) of the code of more than 8 bits that 16 bits start with."""
        for n in range(9, 17):
            hit = self.long.get((n, code >> 16 - n))
            if hit is not None:
                return n << 8 | hit
        raise JpegError("no such Huffman code")


@dataclass
class Component:
    h: int
    v: int
    table: int
    rows: int = 0  # blocks, padded to whole interleaved units
    columns: int = 0
    own_rows: int = 0  # blocks that a scan of this component alone has
    own_columns: int = 0
    blocks: array | None = None  # 64 coefficients of 16 bits for each block, in zigzag order
    before: int = 0


def _signed(bits: Bits, n: int) -> int:
    if not n:
        return 0
    v = bits.take(n)
    return v if v >> n - 1 else v - (1 << n) + 1


class Scan:
    """Decoder of one scan's blocks; eob counts the blocks that an end-of-band run still covers."""

    def __init__(self, ss: int, se: int, ah: int, al: int, progressive: bool):
        self.ss, self.se, self.ah, self.al, self.progressive, self.eob = ss, se, ah, al, progressive, 0

    def block(self, c: Component, at: int, bits: Bits, dc: Huffman | None, ac: Huffman | None) -> None:
        b = c.blocks
        if self.ss == 0:
            if self.ah:
                b[at] |= bits.take(1) << self.al
            else:
                c.before += _signed(bits, bits.symbol(dc))
                b[at] = c.before << self.al
        if self.se == 0:
            return
        if self.progressive:
            (self.refine if self.ah else self.first)(b, at, bits, ac)
            return
        k = 1
        while k < 64:
            rs = bits.symbol(ac)
            r, s = rs >> 4, rs & 15
            if s == 0:
                if r < 15:
                    break
                k += 16
                continue
            k += r
            if k > 63:
                raise JpegError("a coefficient beyond the block")
            b[at + k] = _signed(bits, s)
            k += 1

    def first(self, b: array, at: int, bits: Bits, ac: Huffman) -> None:
        if self.eob:
            self.eob -= 1
            return
        k, end, al, short = at + self.ss, at + self.se, self.al, ac.short
        value, left = bits.value, bits.left
        while k <= end:
            if left < 32:  # a code and what follows it
                bits.left = left
                bits.need(32)
                value, left = bits.value, bits.left
            hit = short[value >> left - 8 & 255] or ac.longer(value >> left - 16 & 65535)
            left -= hit >> 8
            r, s = hit >> 4 & 15, hit & 15
            if s:
                k += r
                if k > end:
                    raise JpegError("a coefficient beyond the band")
                left -= s
                v = value >> left & (1 << s) - 1
                b[k] = (v if v >> s - 1 else v - (1 << s) + 1) << al
                k += 1
            elif r == 15:
                k += 16
            else:
                left -= r
                self.eob = (1 << r) - 1 + (value >> left & (1 << r) - 1)
                break
        bits.left = left

    def refine(self, b: array, at: int, bits: Bits, ac: Huffman) -> None:
        k, end, one, short = at + self.ss, at + self.se, 1 << self.al, ac.short
        if not self.eob:
            while k <= end:
                if bits.left < 32:
                    bits.need(32)
                value, left = bits.value, bits.left
                hit = short[value >> left - 8 & 255] or ac.longer(value >> left - 16 & 65535)
                left -= hit >> 8
                r, new = hit >> 4 & 15, 0
                if hit & 15:
                    left -= 1
                    new = one if value >> left & 1 else -one
                elif r < 15:
                    left -= r
                    self.eob = (1 << r) + (value >> left & (1 << r) - 1)
                    bits.left = left
                    break
                while k <= end:  # pass r coefficients that are still zero, correcting the others on the way
                    v = b[k]
                    if v:
                        if not left:
                            bits.left = 0
                            bits.need(32)
                            value, left = bits.value, bits.left
                        left -= 1
                        if value >> left & 1 and not abs(v) & one:
                            b[k] = v + one if v > 0 else v - one
                    elif r == 0:
                        break
                    else:
                        r -= 1
                    k += 1
                bits.left = left
                if new:
                    if k > end:
                        raise JpegError("a coefficient beyond the band")
                    b[k] = new
                k += 1
        if self.eob:
            for k in range(k, end + 1):
                v = b[k]
                if v and bits.take(1) and not abs(v) & one:
                    b[k] = v + one if v > 0 else v - one
            self.eob -= 1


def _segments(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Entropy-coded segments (between restart markers) from `at`, and where the next marker is."""
    out, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return [*out, data[start:]], len(data)
        m = data[at + 1]
        if m == 0 or m == 0xFF:
            at += 2 if m == 0 else 1
        elif 0xD0 <= m <= 0xD7:
            out.append(data[start:at])
            at = start = at + 2
        else:
            return [*out, data[start:at]], at


@dataclass
class Image:
    height: int
    width: int
    components: dict[int, Component]
    quantisers: dict[int, np.ndarray]
    transform: int | None = None


def coefficients(data: bytes) -> Image:
    """All scans accumulated. Raises JpegError for what isn't a Huffman-coded JPEG of 8-bit samples."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("no start of image")
    at, image, tables, quantisers, restart, progressive, transform, scans = 2, None, {}, {}, 0, False, None, 0
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        m = data[at + 1]
        if m == 0xFF or m == 0 or 0xD0 <= m <= 0xD8 or m == 1:
            at += 1 if m == 0xFF else 2
            continue
        if m == 0xD9:
            break
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if size < 2 or at + 2 + size > len(data):
            break  # the file ends within this segment
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if m == 0xDB:
            while body:
                wide, n = body[0] >> 4, body[0] & 15
                raw = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1")
                if len(raw) != 64:
                    raise JpegError("a short quantisation table")
                quantisers[n], body = raw.astype(np.float32), body[65 + 64 * wide :]
        elif m == 0xC4:
            while len(body) >= 17:
                n = sum(body[1:17])
                tables[body[0]], body = Huffman(body[1:17], body[17 : 17 + n]), body[17 + n :]
        elif m == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif m == 0xEE and body[:5] == b"Adobe":
            transform = body[11]
        elif m in (0xC0, 0xC1, 0xC2):
            progressive = m == 0xC2
            bits, height, width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not height or not width or n not in (1, 3) or 3 * height * width > MOST_BYTES:
                raise JpegError("samples, size or components that aren't supported")
            parts = {body[6 + 3 * k]: Component(body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
            if any(not (1 <= c.h <= 4 and 1 <= c.v <= 4) for c in parts.values()):
                raise JpegError("sampling factors out of range")
            hm, vm = max(c.h for c in parts.values()), max(c.v for c in parts.values())
            for c in parts.values():
                c.columns, c.rows = -(-width // (8 * hm)) * c.h, -(-height // (8 * vm)) * c.v
                c.own_columns, c.own_rows = -(-(-(-width * c.h // hm)) // 8), -(-(-(-height * c.v // vm)) // 8)
            if sum(c.own_rows * c.own_columns for c in parts.values()) > 8 * len(data):
                raise JpegError("fewer bits than blocks")  # even a first scan has a bit for each; a header can't claim gigabytes
            for c in parts.values():
                c.blocks = array("h", bytes(128 * c.rows * c.columns))
            image = Image(height, width, parts, quantisers)
        elif 0xC3 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC):
            raise JpegError("a coding process that isn't supported")
        elif m == 0xDA:
            if image is None:
                raise JpegError("a scan before the frame")
            segments, at = _segments(data, at)
            _scan(image, body, segments, tables, restart, progressive)
            scans += 1
    if image is None or not scans:
        raise JpegError("no image")
    image.transform = transform
    return image


def _scan(image: Image, body: bytes, segments: list[bytes], tables: dict, restart: int, progressive: bool) -> None:
    n = body[0]
    try:
        chosen = [(image.components[body[1 + 2 * k]], tables.get(body[2 + 2 * k] >> 4), tables.get(16 | body[2 + 2 * k] & 15)) for k in range(n)]
    except KeyError as e:
        raise JpegError("a scan of an unknown component") from e
    ss, se, a = body[1 + 2 * n : 4 + 2 * n]
    if not ss <= se <= 63 or progressive and ss == 0 and se > 0 or ss > 0 and n > 1:
        raise JpegError("a band that isn't allowed")
    scan = Scan(ss, se if progressive else 63, a >> 4, a & 15, progressive)
    if any((scan.ss == 0 and not scan.ah and dc is None) or (scan.se > 0 and ac is None) for _, dc, ac in chosen):
        raise JpegError("a Huffman table is missing")
    if n == 1:
        c = chosen[0][0]
        count = c.own_rows * c.own_columns
    else:
        c = chosen[0][0]
        across = c.columns // c.h
        count = c.rows // c.v * across
    step = restart or count
    for first in range(0, count, step):
        if first // step >= len(segments):
            return  # the file ends early: what is missing stays as it is
        bits, scan.eob = Bits(segments[first // step]), 0
        for x, _, _ in chosen:
            x.before = 0
        try:
            for k in range(first, min(first + step, count)):
                if bits.left < bits.over:
                    return
                if n == 1:
                    y, x = divmod(k, c.own_columns)
                    scan.block(c, (y * c.columns + x) * 64, bits, *chosen[0][1:])
                    continue
                my, mx = divmod(k, across)
                for part, dc, ac in chosen:
                    for y in range(my * part.v, my * part.v + part.v):
                        at = (y * part.columns + mx * part.h) * 64
                        for x in range(part.h):
                            scan.block(part, at + 64 * x, bits, dc, ac)
        except JpegError:
            if bits.over:
                return  # what was read last stands behind the file's end
            raise


def planes(image: Image) -> list[np.ndarray]:
    """8-bit sample planes of the components, each at its own resolution, from strips of blocks."""
    out = []
    for c in image.components.values():
        if c.table not in image.quantisers:
            raise JpegError("a quantisation table is missing")
        coefficient, quantiser = np.frombuffer(c.blocks, np.int16).reshape(-1, 64), image.quantisers[c.table]
        plane = np.empty((c.rows * 8, c.columns * 8), np.uint8)
        step = max(1, 8192 // c.columns)
        for y in range(0, c.rows, step):
            part = coefficient[y * c.columns : (y + step) * c.columns]
            block = np.zeros((len(part), 64), np.float32)
            block[:, ZIGZAG] = part * quantiser
            block = np.clip(np.rint(COSINE.T @ block.reshape(-1, 8, 8) @ COSINE + 128), 0, 255)
            rows = len(part) // c.columns
            plane[y * 8 : (y + rows) * 8] = block.reshape(rows, c.columns, 8, 8).swapaxes(1, 2).reshape(rows * 8, c.columns * 8)
        out.append(plane)
    return out


def decode(data: bytes) -> np.ndarray:
    """RGB tensor (height, width, 3) of 8-bit samples."""
    try:
        image = coefficients(data)
    except OverflowError as e:
        raise JpegError("a coefficient of more than 16 bits") from e
    parts, sampled = planes(image), list(image.components.values())
    hm, vm = max(c.h for c in sampled), max(c.v for c in sampled)
    rgb = np.empty((image.height, image.width, 3), np.uint8)
    x = np.arange(image.width)
    step = max(1, (1 << 20) // image.width)
    for top in range(0, image.height, step):
        y = np.arange(top, min(top + step, image.height))
        p = [part[(y * c.v // vm)[:, None], x * c.h // hm] for part, c in zip(parts, sampled)]  # chroma at full resolution
        if len(p) == 1:
            rgb[y] = p[0][..., None]
        elif image.transform == 0:
            rgb[y] = np.stack(p, 2)
        else:
            luma, cb, cr = (v.astype(np.float64) for v in p)
            cb, cr = cb - 128, cr - 128
            mixed = np.stack([luma + 1.402 * cr, luma - 0.344136 * cb - 0.714136 * cr, luma + 1.772 * cb], 2)
            rgb[y] = np.clip(np.rint(mixed), 0, 255)
    return rgb


def rgb_tensors(df: DataFrame, media: str = "jpeg", key: str = "doc_id") -> DataFrame:
    """(key, height, width, rgb, error) of every row; rgb holds height x width x 3 bytes, row by row.

    A null image gives nulls and no error; what can't be decoded gives nulls and the reason: an
    empty value, a damaged file, one whose tensor exceeds what an Arrow value can hold (2 GB), one
    with fewer bits than its size has blocks. A file that ends early keeps what its scans have
    told. Null keys stay null, repeated rows give repeated results, other columns aren't read, and
    an empty table gives an empty one. One scan without a shuffle; a task holds the coefficients
    of one image (at most 1 kB for each byte of its file) and tensors of BATCH_BYTES or one image.
    """
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string())

    def tensor(value: bytes | None) -> tuple:
        try:
            t = None if value is None else decode(value)
        except (ValueError, struct.error, IndexError) as e:
            return None, None, None, str(e) or "damaged"
        return (None, None, None, None) if t is None else (*t.shape[:2], t.tobytes(), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size, sent = [], 0, 0
            for n, value in enumerate(b.column(1), 1):
                row = tensor(value.as_py())
                more = len(row[2] or b"")
                if rows and size + more > BATCH_BYTES:
                    yield made(b.column(0).slice(sent, len(rows)), rows)
                    rows, size, sent = [], 0, n - 1
                rows.append(row)
                size += more
            yield made(b.column(0).slice(sent), rows)

    def made(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([keys, *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], ["k", "height", "width", "rgb", "error"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("k"), F.col(media).alias("m")).transform(mapped, run, f"k {kind}, {SCHEMA}")
    return out.withColumnRenamed("k", key)
