"""Lossless WebP: a decoder of the whole format, an encoder of it, and documents kept as images.

The decoder reads prefix codes (simple and coded lengths, several groups), back-references with plane
distances, and the colour cache; it inverts the predictor, cross-colour, subtract-green and palette
transforms. Where only the green channel needs bits (as in images of single samples), it follows the
code by arrays: for every bit the length of the code that starts there gives the next place, and
places eight codes on are had by composing that map with itself, so that Python steps once in eight.

The encoder can apply every transform, the colour cache and several prefix-code groups. A document's
payload (its UTF-8 and zeros up to a multiple of 64) is one grey sample a pixel in green: with 16
distinct samples or fewer it uses a palette and packs pixels, else plain prefix codes with
back-references for lines that come again, or, where the entropy of the residuals promises less, a
predictor; the smaller file stays. A colour cache can save nothing there, as grey samples have one
coded channel. A payload of over 2^28 bytes, the largest image, is a row of files one after another.

Defined results: a null text counts as empty (64 zeros); equal texts give equal bytes and features;
repeated rows each get a row; null ids stay; an empty table gives an empty result; other columns are
left out. A malformed file raises ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import chunks, table

# Fixed values of the format.
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
#: (x, y) of the distance codes 1 to 120.
PLANE = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
#: Predictors of a pixel by the one before it and the one above it.
LEFT, TOP = 1, 2
LARGEST_SIDE = 1 << 14
BLACK = 0xFF000000

#: Pixels in a row of a document's image, as long as it is not too high.
ROW = 64
#: Bytes whose codes are followed at a time.
_SPAN = 1 << 14
_LONGEST_COPY, _FARTHEST, _LEAST_LINE = 4096, (1 << 20) - 120, 24


class Bits:
    """Reads numbers of some bits, the lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(16), 0

    def read(self, n: int) -> int:
        i = self.at >> 3
        out = int.from_bytes(self.data[i : i + 8], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        if self.at > 8 * (len(self.data) - 8):
            raise ValueError("the image ends too early")
        return out


class BitsOut:
    def __init__(self) -> None:
        self.value, self.n, self.done = 0, 0, bytearray()

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n
        if self.n > 4096:
            self._flush()

    def _flush(self) -> None:
        k = self.n >> 3
        self.done += (self.value & ((1 << 8 * k) - 1)).to_bytes(k, "little")
        self.value >>= 8 * k
        self.n -= 8 * k

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Numbers of up to 24 bits, one after another."""
        ends = np.cumsum(sizes) + self.n % 8
        at = ends - sizes
        self._flush()
        total = int(ends[-1]) if len(ends) else self.n
        words = np.bincount(at >> 5, (values.astype(np.int64) << (at & 31)).astype(np.float64), (total >> 5) + 2).astype(np.int64)
        words[0] += self.value
        low = words & 0xFFFFFFFF
        low[1:] += words[:-1] >> 32
        raw = low.astype("<u4").tobytes()
        k = total >> 3
        self.done += raw[:k]
        self.n = total & 7
        self.value = raw[k] & ((1 << self.n) - 1)

    def bytes(self) -> bytes:
        self._flush()
        return bytes(self.done) + (bytes([self.value]) if self.n else b"")


@cache
def _reversed(n: int) -> np.ndarray:
    out = np.zeros(1, np.int32)
    for _ in range(n):
        out = np.concatenate([out << 1, out << 1 | 1])
    return out


class Code:
    """A canonical prefix code: table of (symbol << 4 | length) by the next `bits` bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) == 0:
            raise ValueError("a prefix code without symbols")
        if len(used) == 1:
            self.bits, self.table, self.single = 0, np.array([int(used[0]) << 4], np.int32), int(used[0])
        else:
            n = lengths[used]
            self.bits, self.single = int(n.max()), None
            order = np.argsort(n, kind="stable")
            used, n = used[order], n[order]
            if int((1 << (self.bits - n)).sum()) != 1 << self.bits:
                raise ValueError("a prefix code that is not complete")
            self.table = np.repeat((used << 4 | n).astype(np.int32), 1 << (self.bits - n))[_reversed(self.bits)]
        self.mask, self.quick = (1 << self.bits) - 1, None

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        if self.quick is None:
            self.quick = self.table.tolist()
        i = bits.at >> 3
        x = self.quick[int.from_bytes(bits.data[i : i + 4], "little") >> (bits.at & 7) & self.mask]
        bits.at += x & 15
        return x >> 4


def _read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1), *([bits.read(8)] if two else [])]
        if max(symbols) >= size:
            raise ValueError("a symbol beyond its alphabet")
        lengths[symbols] = 1
        return Code(lengths)
    first = np.zeros(19, np.int64)
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        first[k] = bits.read(3)
    code, left = Code(first), size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
        if left > size:
            raise ValueError("more code lengths than symbols")
    out, last = [], 8
    while len(out) < size and left:
        left -= 1
        k = code.read(bits)
        if k < 16:
            out.append(k)
            last = k or last
        else:
            out += ([last] * (3 + bits.read(2))) if k == 16 else [0] * ((3 + bits.read(3)) if k == 17 else (11 + bits.read(7)))
    if len(out) > size:
        raise ValueError("more code lengths than symbols")
    lengths[: len(out)] = out
    return Code(lengths)


def _extra(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + bits.read(n) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = PLANE[code - 1]
    return max(1, x + y * width)


def _copy(out: np.ndarray, at: int, distance: int, n: int) -> int:
    if distance > at or at + n > len(out):
        raise ValueError("a back-reference outside the image")
    while n > 0:  # what overlaps repeats itself
        k = min(n, distance)
        out[at : at + k] = out[at - distance : at - distance + k]
        at, n, distance = at + k, n - k, distance + k if k == distance else distance
    return at


def _read_green(bits: Bits, codes: list[Code], width: int, total: int) -> np.ndarray:
    """Pixels of which only green (and back-references) takes bits."""
    green, base = codes[0], codes[3].single << 24 | codes[1].single << 16 | codes[2].single
    out, done = np.empty(total, np.uint32), 0
    data = np.frombuffer(bits.data, np.uint8)
    while done < total:
        start = bits.at >> 3
        span = data[start : start + _SPAN + 3].astype(np.uint32)
        n = len(span) - 3
        if n <= 0:
            raise ValueError("the image ends too early")
        words = span[:-3] | span[1:-2] << np.uint32(8) | span[2:-1] << np.uint32(16)
        found = green.table[((words[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32(green.mask)).ravel()]
        symbol = found >> 4
        ends = 8 * n
        here = np.arange(ends + 16, dtype=np.int32)
        one = here.copy()
        one[:ends] += np.where(symbol < 256, found & 15, 0)
        two = one[one]
        four = two[two]
        jump = memoryview(four[four])
        p = bits.at - 8 * start
        while done < total:
            stops, q = [p], jump[p]
            append, most = stops.append, (total - done) // 8 + 2
            while q != stops[-1] and len(stops) <= most:
                append(q)
                q = jump[q]
            a = np.array(stops, np.int32)
            b = np.stack([a, two[a], four[a], two[four[a]]], axis=1).ravel()
            places = np.stack([b, one[b]], axis=1).ravel()
            end = places[-1]
            k = int(np.searchsorted(places, end)) if one[end] == end else len(places)
            k = min(k, total - done)
            out[done : done + k] = base | symbol[places[:k]].astype(np.uint32) << np.uint32(8)
            done += k
            if done == total:
                bits.at = 8 * start + (int(one[places[k - 1]]) if k else p)
                break
            p = int(one[places[k - 1]]) if k else p
            bits.at = 8 * start + p
            if p >= ends:
                break
            if symbol[p] < 256:
                continue
            s = green.read(bits)
            if s >= 280:
                raise ValueError("a cached colour without a cache")
            length = _extra(bits, s - 256)
            done = _copy(out, done, _distance(_extra(bits, codes[4].read(bits)), width), length)
            p = bits.at - 8 * start
            if p >= ends:
                break
    return out


def _read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """One entropy-coded image, row after row."""
    total = width * height
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache that is too large")
    meta = None
    if main and bits.read(1):
        shift = bits.read(3) + 2
        across = (width + (1 << shift) - 1) >> shift
        down = (height + (1 << shift) - 1) >> shift
        meta = (_read_pixels(bits, across, down, False) >> np.uint32(8) & np.uint32(0xFFFF)).tolist()
    groups = [[_read_code(bits, n) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(max(meta) + 1 if meta else 1)]
    g = groups[0]
    if not meta and not cache_bits and all(c.single is not None for c in g[1:4]):
        if g[0].single is not None and g[0].single < 256:
            return np.full(total, g[3].single << 24 | g[1].single << 16 | g[0].single << 8 | g[2].single, np.uint32)
        if g[0].single is None:
            return _read_green(bits, g, width, total)
    out, done, kept, cached = np.empty(total, np.uint32), 0, [0] * (1 << cache_bits), 0
    while done < total:
        if meta:
            g = groups[meta[(done // width >> shift) * across + (done % width >> shift)]]
        s = g[0].read(bits)
        if s < 256:
            red = g[1].read(bits)
            blue = g[2].read(bits)
            out[done] = g[3].read(bits) << 24 | red << 16 | s << 8 | blue
            done += 1
        elif s < 280:
            length = _extra(bits, s - 256)
            done = _copy(out, done, _distance(_extra(bits, g[4].read(bits)), width), length)
        else:
            out[done] = kept[s - 280]
            done += 1
        if cache_bits:
            for x in out[cached:done].tolist():
                kept[(CACHE_FACTOR * x & 0xFFFFFFFF) >> (32 - cache_bits)] = x
            cached = done
        if bits.at > 8 * len(bits.data):
            raise ValueError("the image ends too early")
    return out


def _channels(argb: np.ndarray) -> np.ndarray:
    """(..., 4) of blue, green, red and alpha as small integers."""
    return argb.astype("<u4").view(np.uint8).reshape(*argb.shape, 4).astype(np.int32)


def _joined(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x & 255).astype(np.uint8).view("<u4")[..., 0].astype(np.uint32)


def _predict(mode: int, left, top, right, corner):
    """The prediction from the neighbours' channels: left, above, above right and above left."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return ((left + right >> 1) + top) >> 1
    if mode == 6:
        return left + corner >> 1
    if mode == 7:
        return left + top >> 1
    if mode == 8:
        return corner + top >> 1
    if mode == 9:
        return top + right >> 1
    if mode == 10:
        return ((left + corner >> 1) + (top + right >> 1)) >> 1
    if mode == 11:
        nearer = np.abs(top - corner).sum(-1, keepdims=True) < np.abs(left - corner).sum(-1, keepdims=True)
        return np.where(nearer, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        half = left + top >> 1
        return np.clip(half + np.trunc((half - corner) / 2).astype(np.int32), 0, 255)
    out = np.zeros_like(left)
    out[..., 3] = 255
    return out


def _neighbours(x: np.ndarray, y: int, a: int, b: int):
    """Above, above right and above left of the pixels a to b of row y; x: (height, width, 4)."""
    width, above = x.shape[1], x[y - 1]
    right = above[a + 1 : b + 1] if b < width else np.concatenate([above[a + 1 : b], x[y, :1]])
    return above[a:b], right, above[a - 1 : b - 1]


def _unpredict(residual: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    """residual: (height, width, 4); modes by block."""
    x = residual.copy()
    height, width, _ = x.shape
    x[0, 0] = (x[0, 0] + np.array([0, 0, 0, 255])) & 255
    x[0] = np.cumsum(x[0], axis=0) & 255
    for y in range(1, height):
        x[y, 0] = (x[y, 0] + x[y - 1, 0]) & 255
        for block in range((width + (1 << shift) - 1) >> shift):
            a, b = max(1, block << shift), min(width, (block + 1) << shift)
            mode = int(modes[y >> shift, block])
            if a >= b:
                continue
            if mode in (0, 2, 3, 4, 8, 9) or mode > 13:
                x[y, a:b] = (x[y, a:b] + _predict(mode, x[y, a:b], *_neighbours(x, y, a, b))) & 255
            elif mode == 1:
                x[y, a - 1 : b] = np.cumsum(x[y, a - 1 : b], axis=0) & 255
            else:
                for k in range(a, b):
                    x[y, k : k + 1] = (x[y, k : k + 1] + _predict(mode, x[y, k - 1 : k], *_neighbours(x, y, k, k + 1))) & 255
    return x


def _predicted(x: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    """What _unpredict() turns back into x."""
    height, width, _ = x.shape
    out = x.copy()
    out[0, 1:] -= x[0, :-1]
    out[0, 0] -= np.array([0, 0, 0, 255])
    for y in range(1, height):
        out[y, 0] -= x[y - 1, 0]
        for block in range((width + (1 << shift) - 1) >> shift):
            a, b = max(1, block << shift), min(width, (block + 1) << shift)
            if a < b:
                out[y, a:b] -= _predict(int(modes[y >> shift, block]), x[y, a - 1 : b - 1], *_neighbours(x, y, a, b))
    return out & 255


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x + 128) & 255) - 128


def _cross(x: np.ndarray, elements: np.ndarray, shift: int, sign: int) -> np.ndarray:
    """Cross-colour, forward (sign -1) or inverse (sign 1); elements: (down, across, 4)."""
    height, width, _ = x.shape
    e = elements[np.arange(height)[:, None] >> shift, np.arange(width)[None] >> shift]
    delta = lambda t, c: _signed(t) * _signed(c) >> 5
    out = x.copy()
    out[..., 2] = (x[..., 2] + sign * delta(e[..., 0], x[..., 1])) & 255
    red = out[..., 2] if sign > 0 else x[..., 2]
    out[..., 0] = (x[..., 0] + sign * (delta(e[..., 1], x[..., 1]) + delta(e[..., 2], red))) & 255
    return out


def _packing(colours: int) -> int:
    """log2 of the palette indexes in a pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file: (height, width) of 0xAARRGGBB."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or len(data) < 25 or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    size = int.from_bytes(data[16:20], "little")
    bits = Bits(data[21 : 20 + size])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    steps, across = [], width
    while bits.read(1):
        kind = bits.read(2)
        if any(kind == s[0] for s in steps):
            raise ValueError("a transform comes twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = bits.read(3) + 2
            w, h = (across + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift
            steps.append((kind, across, shift, _channels(_read_pixels(bits, w, h, False).reshape(h, w))))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            colours = _joined(np.cumsum(_channels(_read_pixels(bits, n, 1, False)), axis=0))
            steps.append((kind, across, _packing(n), np.concatenate([colours, np.zeros(256 - n, np.uint32)])))
            across = (across + (1 << _packing(n)) - 1) >> _packing(n)
        else:
            steps.append((kind, across, 0, None))
    pixels = _read_pixels(bits, across, height, True).reshape(height, across)
    for kind, w, shift, extra in reversed(steps):
        if kind == PREDICTOR:
            pixels = _joined(_unpredict(_channels(pixels), extra[..., 1], shift))
        elif kind == CROSS_COLOUR:
            pixels = _joined(_cross(_channels(pixels), extra, shift, 1))
        elif kind == SUBTRACT_GREEN:
            x = _channels(pixels)
            x[..., 0] += x[..., 1]
            x[..., 2] += x[..., 1]
            pixels = _joined(x)
        else:
            index = pixels >> np.uint32(8) & np.uint32(255)
            each = 8 >> shift
            if shift:
                index = (index[..., None] >> np.arange(0, 8, each, dtype=np.uint32) & np.uint32((1 << each) - 1)).reshape(height, -1)[:, :w]
            pixels = extra[index]
    return pixels


def _lengths(counts: list[tuple[int, int]], longest: int) -> dict[int, int]:
    """Code lengths of (count, symbol) pairs of at least two symbols, none over `longest`."""
    floor = 0
    while True:
        heap = [(max(c, floor), s, (s,)) for c, s in counts]
        depth = dict.fromkeys((s for _, s in counts), 0)
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            both = a[2] + b[2]
            for s in both:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), both))
        if max(depth.values()) <= longest:
            return depth
        floor = max(1, 2 * floor, sum(c for c, _ in counts) >> (longest + 3))


def _codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes, turned round as they are written."""
    out, code, last = np.zeros(len(lengths), np.int64), 0, 0
    for n, s in sorted((int(lengths[s]), int(s)) for s in np.flatnonzero(lengths)):
        code <<= n - last
        out[s] = int(f"{code:0{n}b}"[::-1], 2)
        code, last = code + 1, n
    return out


def _write_code(out: BitsOut, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes the prefix code for the counts; its codes and their sizes."""
    used = np.flatnonzero(counts).tolist()
    codes, sizes = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    if len(used) <= 2 and max(used, default=0) < 256:
        used = used or [0]
        out.put(1 | (len(used) - 1) << 1 | 1 << 2, 3)
        for k, s in enumerate(used):
            out.put(s, 8)
            codes[s], sizes[s] = k, len(used) - 1
        return codes, sizes
    if len(used) == 1:
        lengths = {used[0]: 1}
    else:
        lengths = _lengths([(int(counts[s]), s) for s in used], 15)
    for s, n in lengths.items():
        sizes[s] = n
    runs, i, flat = [], 0, sizes[: max(used) + 1].tolist()
    while i < len(flat):
        j = i
        while j < len(flat) and flat[j] == flat[i] and j - i < (138 if not flat[i] else 7):
            j += 1
        n = j - i
        if not flat[i] and n >= 3:
            runs.append((18, n - 11, 7) if n >= 11 else (17, n - 3, 3))
        elif flat[i] and n >= 4:
            runs += [(flat[i], 0, 0), (16, n - 4, 2)]
        else:
            runs += [(flat[i], 0, 0)] * n
        i = j
    tally: dict[int, int] = {}
    for k, _, _ in runs:
        tally[k] = tally.get(k, 0) + 1
    first = _lengths([(c, s) for s, c in tally.items()], 7) if len(tally) > 1 else {runs[0][0]: 1}
    first_sizes = np.array([first.get(k, 0) for k in range(19)])
    first_codes = _codes(first_sizes) if len(first) > 1 else np.zeros(19, np.int64)
    out.put(0, 1)
    n = max(4, 1 + max(i for i, k in enumerate(LENGTH_ORDER) if first.get(k)))
    out.put(n - 4, 4)
    for k in LENGTH_ORDER[:n]:
        out.put(first.get(k, 0), 3)
    if len(flat) < len(counts):  # the rest has no code
        most = len(runs) - 2
        width = max(2, most.bit_length() + most.bit_length() % 2)
        out.put(1 | (width - 2) // 2 << 1, 4)
        out.put(most, width)
    else:
        out.put(0, 1)
    for k, extra, width in runs:
        if len(first) > 1:
            out.put(int(first_codes[k]), int(first_sizes[k]))
        out.put(extra, width)
    if len(used) == 1:
        return codes, np.zeros(len(counts), np.int64)
    return _codes(sizes), sizes


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix code, extra bits' value and number for a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    n = v.bit_length() - 2
    return 2 * n + 2 + (v >> n & 1), v & ((1 << n) - 1), n


def _write_pixels(out: BitsOut, argb: np.ndarray, main: bool, copies: list[tuple[int, int, int]] = (), cache_bits: int = 0, groups: tuple[int, np.ndarray] | None = None) -> None:
    """One entropy-coded image. copies: (place, length, distance), in order, apart from each other;
    groups: log2 of the blocks' side and the prefix-code group of each block."""
    flat = argb.ravel()
    width = argb.shape[-1]
    out.put(1 | cache_bits << 1 if cache_bits else 0, 5 if cache_bits else 1)
    group = np.zeros(len(flat), np.int64)
    if main:
        out.put(int(groups is not None), 1)
        if groups is not None:
            shift, of = groups
            out.put(shift - 2, 3)
            _write_pixels(out, (of.astype(np.uint32) << np.uint32(8)) | np.uint32(BLACK), False)
            y, x = np.divmod(np.arange(len(flat)), width)
            group = of[y >> shift, x >> shift]
    literal = np.ones(len(flat), bool)
    for p, n, _ in copies:
        literal[p : p + n] = False
    green = (flat >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    plain = literal.copy()
    if cache_bits:
        key = ((flat.astype(np.uint64) * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)).astype(np.int64)
        kept = np.zeros(1 << cache_bits, np.uint32)
        for i, (k, x) in enumerate(zip(key.tolist(), flat.tolist(), strict=True)):
            if literal[i] and kept[k] == x:
                plain[i], green[i] = False, 280 + k
            kept[k] = x
    channels = [green, *((flat >> np.uint32(s) & np.uint32(255)).astype(np.int64) for s in (16, 0, 24))]
    jumps = [(p, *_prefix(n), *_prefix(d + 120)) for p, n, d in copies]
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = []
    for k in range(int(group.max()) + 1 if len(group) else 1):
        mine = (group == k) & literal
        counts = [np.bincount(channels[0][mine], minlength=sizes[0]), *(np.bincount(c[mine & plain], minlength=256) for c in channels[1:]), np.zeros(40, np.int64)]
        for p, a, _, _, d, _, _ in jumps:
            if group[p] == k:
                counts[0][256 + a] += 1
                counts[4][d] += 1
        codes.append([_write_code(out, c) for c in counts])
    one = len(codes) == 1
    at = np.flatnonzero(literal)
    columns = []
    for c, values in enumerate(channels):
        v, n = codes[0][c]
        if one and c and not n.any():
            continue
        if one:
            value, size = v[values[at]], n[values[at]]
        else:
            both = [np.stack(g[c]) for g in codes]
            table = np.stack(both)
            value, size = table[group[at], 0, values[at]], table[group[at], 1, values[at]]
        columns.append((value, size if not c else np.where(plain[at], size, 0)))
    value = columns[0][0] if len(columns) == 1 else np.stack([c[0] for c in columns], axis=1).ravel()
    size = columns[0][1] if len(columns) == 1 else np.stack([c[1] for c in columns], axis=1).ravel()
    value = np.where(size, value, 0)
    before = 0
    for p, a, a_extra, a_n, d, d_extra, d_n in jumps:
        k = len(columns) * int(np.searchsorted(at, p))
        out.put_all(value[before:k], size[before:k])
        before, g = k, codes[group[p]]
        for v, n in ((g[0][0][256 + a], g[0][1][256 + a]), (a_extra, a_n), (g[4][0][d], g[4][1][d]), (d_extra, d_n)):
            out.put(int(v), int(n))
    out.put_all(value[before:], size[before:])


def encode(argb: np.ndarray, predictor: tuple[int, np.ndarray] | None = None, cross: tuple[int, np.ndarray] | None = None, subtract_green: bool = False, palette: bool = False, cache_bits: int = 0, groups: tuple[int, np.ndarray] | None = None, copies: list[tuple[int, int, int]] = ()) -> bytes:
    """A lossless WebP file of (height, width) pixels. predictor: log2 of the blocks' side and their
    modes; cross: the same with elements (.., 4). A palette stands alone, for up to 256 colours."""
    height, width = argb.shape
    out = BitsOut()
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(int((argb >> np.uint32(24) != 255).any()), 4)
    if palette:
        colours, index = np.unique(argb, return_inverse=True)
        out.put(1 | PALETTE << 1, 3)
        out.put(len(colours) - 1, 8)
        x = _channels(colours)
        x[1:] -= _channels(colours)[:-1]
        _write_pixels(out, _joined(x)[None], False)
        index, shift = index.reshape(height, width), _packing(len(colours))
        if shift:
            index = np.pad(index, ((0, 0), (0, -width % (1 << shift)))).reshape(height, -1, 1 << shift)
            index = (index << np.arange(0, 8, 8 >> shift)).sum(2)
        argb = index.astype(np.uint32) << np.uint32(8) | np.uint32(BLACK)
    x = _channels(argb) if predictor or cross or subtract_green else None
    if predictor:
        shift, modes = predictor
        out.put(1 | PREDICTOR << 1 | shift - 2 << 3, 6)
        _write_pixels(out, modes.astype(np.uint32) << np.uint32(8) | np.uint32(BLACK), False)
        x = _predicted(x, modes, shift)
    if cross:
        shift, elements = cross
        out.put(1 | CROSS_COLOUR << 1 | shift - 2 << 3, 6)
        _write_pixels(out, _joined(elements), False)
        x = _cross(x, elements, shift, -1)
    if subtract_green:
        out.put(1 | SUBTRACT_GREEN << 1, 3)
        x = x.copy()
        x[..., 0] -= x[..., 1]
        x[..., 2] -= x[..., 1]
    out.put(0, 1)
    _write_pixels(out, argb if x is None else _joined(x), True, copies, cache_bits, groups)
    body = b"\x2f" + out.bytes()
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + bytes(len(body) % 2)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def _repeats(data: bytes) -> list[tuple[int, int, int]]:
    """Lines of some length that came before, and the zeros at the end, as copies."""
    out, seen, p = [], {}, 0
    for line in data.split(b"\n"):
        n = len(line)
        if n >= _LEAST_LINE:
            before = seen.get(line)
            if before is not None and p - before <= _FARTHEST:
                out += [(p + k, min(_LONGEST_COPY, n - k), p - before) for k in range(0, n, _LONGEST_COPY)]
            seen[line] = p
        p += n + 1
    return out


def _entropy(values: np.ndarray) -> float:
    """Bits that prefix codes need for bytes, about."""
    counts = np.bincount(values, minlength=256)
    counts = counts[counts > 0]
    return float((counts * np.log2(counts.sum() / counts)).sum())


def payload_image(payload: bytes) -> bytes:
    """The image of a payload whose length is a positive multiple of 64."""
    samples = np.frombuffer(payload, np.uint8)
    width = ROW
    while len(samples) > width * LARGEST_SIDE:
        width *= 2
    samples = np.pad(samples, (0, -len(samples) % width))
    argb = samples.reshape(-1, width).astype(np.uint32) << np.uint32(8) | np.uint32(BLACK)
    few = np.count_nonzero(np.bincount(samples, minlength=256)) <= 16
    if few:
        return encode(argb, palette=True)
    copies = _repeats(payload)
    out, literal = encode(argb, copies=copies), np.ones(len(samples), bool)
    for p, n, _ in copies:
        literal[p : p + n] = False
    bits, mode = min((_entropy(samples[k:] - samples[:-k]) if len(samples) > k else np.inf, mode) for mode, k in ((LEFT, 1), (TOP, width)))
    if bits < _entropy(samples[literal]) + 24 * len(copies):
        blocks = -(-len(argb) >> 9), -(-width >> 9)
        out = min(out, encode(argb, predictor=(9, np.full(blocks, mode))), key=len)
    return out


def payload_images(payload: bytes, most: int = LARGEST_SIDE**2) -> bytes:
    """The images of a payload, of at most `most` bytes (a multiple of 64) each."""
    return b"".join(payload_image(payload[k : k + most]) for k in range(0, len(payload), most))


def images_of(media: bytes) -> Iterator[np.ndarray]:
    """The pixels of files one after another."""
    at = 0
    while at < len(media):
        n = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        yield decode(media[at : at + n])
        at += n


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 64 if raw else 64)


def describe(green: np.ndarray, width: int, height: int) -> str:
    """Side lengths, mean, distinct samples and an average hash of 8 by 8 parts of the samples."""
    parts = green.reshape(64, -1) if len(green) % 64 == 0 else green[None]
    means = parts.mean(axis=1)
    marks = (means > means.mean()).astype(np.uint8)
    return f"{width}x{height};mean={green.mean():.4f};distinct={np.count_nonzero(np.bincount(green, minlength=256))};hash={np.packbits(marks).tobytes().hex()}"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, at in chunks(batches):
        raw = data.tobytes()
        media = [payload_images(padded(raw[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    for batch in batches:
        rows = []
        for media, n in zip(batch.column("media").to_pylist(), batch.column("n_bytes").to_pylist(), strict=True):
            images = [*images_of(media)]
            green = np.concatenate([(x >> np.uint32(8) & np.uint32(255)).astype(np.uint8).ravel() for x in images])[: max(64, n + -n % 64)]
            payload = green.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), describe(green, images[0].shape[1], sum(len(x) for x in images))))
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (the WebP file) of each document."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """What reading the stored images back gives."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_webp_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store(table(spark, sf_dir, "documents")))


QUERIES = {"op10_webp_lossless": op10_webp_lossless}
ORACLES: dict[str, str] = {}
