"""Media columns: payloads stored as lossless WebP, and read back into pixel arrays.

The reader decodes the whole lossless format: prefix codes (simple and normal,
one group or a group per tile), back-references with the two-dimensional
distance map, the colour cache, and the inverse predictor, cross-colour,
subtract-green and palette transforms.  The writer makes grey pictures of
8-bit samples (and, for any ARGB array, pictures with each of the transforms).

Where one prefix code carries a whole pixel, as in grey pictures, the reader
looks up the code at all bit positions at once and follows the chain of
positions; everything else is decoded a pixel at a time.

Edge cases: null and empty texts are one block of padding; long payloads are
cut into several pictures, one after another in the stored form; repeated rows
are stored each and equal texts give equal values; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import small_batches

WIDTH = 576
#: Rows of one picture at most; a longer payload goes on in the next picture.
HEIGHT = 1800
#: Order in which the lengths of the code-length code are stored.
_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Short distance codes: (dx, dy) by distance, left of or above the pixel.
_NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda d: (d[0] ** 2 + d[1] ** 2, abs(d[0]), d[0] < 0))
_HASH = 0x1E35A7BD
#: Longest green codes written: the reader's table then stays small (it reads up to 15 bits).
_LIMIT = 11


# --- prefix codes -----------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Prefix code lengths of at most ``limit`` bits; 0 for symbols that do not occur."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts).tolist()
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weights = [int(counts[s]) for s in used]
    while True:
        heap = [(w, k, k) for k, w in enumerate(weights)]
        heapq.heapify(heap)
        parent = {}
        n = len(used)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            parent[a[2]] = parent[b[2]] = n
            heapq.heappush(heap, (a[0] + b[0], n, n))
            n += 1
        depth = {n - 1: 0}
        for k in range(n - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        found = [depth[k] for k in range(len(used))]
        if max(found) <= limit:
            lengths[used] = found
            return lengths
        weights = [w // 2 + 1 for w in weights]


def _reversed_bytes() -> list[int]:
    out = [0]
    for bit in (128, 64, 32, 16, 8, 4, 2, 1):
        out += [x | bit for x in out]
    return out


_REVERSED = _reversed_bytes()


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes with their bits in stored order (the first bit is the lowest)."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths).tolist()
    code, last = 0, 0
    for n, s in sorted(zip(lengths[used].tolist(), used)):
        code <<= n - last
        last = n
        codes[s] = (_REVERSED[code & 255] << 8 | _REVERSED[code >> 8]) >> 16 - n
        code += 1
    return codes


class Code:
    """A prefix code for reading: (symbol << 4 | length) by the next ``bits`` bits; ``first`` is an only symbol."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths).tolist()
        if len(used) < 2:
            self.bits = 0
            self.table = np.array([(used[0] if used else 0) << 4], np.int32)
            self.first = used[0] if used else 0
            return
        sizes = lengths[used].tolist()
        self.bits = max(sizes)
        if sum(1 << self.bits - n for n in sizes) != 1 << self.bits:
            raise ValueError("incomplete prefix code")
        self.table = np.empty(1 << self.bits, np.int32)
        for s, n, code in zip(used, sizes, canonical(lengths)[used].tolist()):
            self.table[code :: 1 << n] = s << 4 | n
        self.first = -1


class Bits:
    """Bits of a byte string, lowest first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data + b"\0" * 8, at
        self.end = len(data) * 8

    def read(self, n: int) -> int:
        at = self.at
        self.at = at + n
        if self.at > self.end:
            raise ValueError("picture data ends early")
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7) & ((1 << n) - 1)

    def symbol(self, code: Code) -> int:
        if not code.bits:
            return code.first
        at = self.at
        k = int.from_bytes(self.data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7) & ((1 << code.bits) - 1)
        found = int(code.table[k])
        self.at = at + (found & 15)
        if self.at > self.end:
            raise ValueError("picture data ends early")
        return found >> 4


def read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        lengths[first] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    meta = np.zeros(19, np.int64)
    for k in range(4 + bits.read(4)):
        meta[_LENGTH_ORDER[k]] = bits.read(3)
    code = Code(meta)
    left = size if not bits.read(1) else 2 + bits.read(2 + 2 * bits.read(3))
    at, last = 0, 8
    while at < size and left:
        left -= 1
        s = bits.symbol(code)
        if s < 16:
            lengths[at] = s
            at += 1
            last = s or last
        else:
            n = (3 + bits.read(2)) if s == 16 else (3 + bits.read(3)) if s == 17 else 11 + bits.read(7)
            if at + n > size:
                raise ValueError("code lengths run over")
            lengths[at : at + n] = last if s == 16 else 0
            at += n
    return Code(lengths)


# --- reading ------------------------------------------------------------------


def _extra(bits: Bits, symbol: int) -> int:
    """Value of a length or distance symbol."""
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = _NEAR[code - 1]
    return max(1, x + y * width)


def _entropy_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels (ARGB in 32 bits) of an entropy-coded image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    tiles, tile_bits, groups = None, 0, 1
    if main and bits.read(1):
        tile_bits = bits.read(3) + 2
        tiles_x = -(-width >> tile_bits)
        tiles = (_entropy_image(bits, tiles_x, -(-height >> tile_bits), False) >> 8 & 0xFFFF).astype(np.int64)
        groups = int(tiles.max()) + 1
    sizes = (256 + 24 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    codes = [[read_code(bits, n) for n in sizes] for _ in range(groups)]
    n = width * height
    out = np.zeros(n, np.uint32)
    one = codes[0]
    grey = tiles is None and not cache_bits and one[0].bits and not (one[1].bits or one[2].bits or one[3].bits)
    if grey:
        _grey(bits, one, width, out)
        return out
    cache = [0] * (1 << cache_bits) if cache_bits else None
    kept = 0  # pixels already in the cache
    at = 0
    while at < n:
        group = codes[0] if tiles is None else codes[int(tiles[(at // width >> tile_bits) * tiles_x + (at % width >> tile_bits)])]
        s = bits.symbol(group[0])
        if s < 256:
            r, b, a = (bits.symbol(group[k]) for k in (1, 2, 3))
            out[at] = a << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 280:
            length = _extra(bits, s - 256)
            back = _distance(_extra(bits, bits.symbol(group[4])), width)
            _copy(out, at, back, length)
            at += length
        else:
            while kept < at:
                cache[(_HASH * int(out[kept]) & 0xFFFFFFFF) >> 32 - cache_bits] = int(out[kept])
                kept += 1
            out[at] = cache[s - 280]
            at += 1
    return out


def _copy(out: np.ndarray, at: int, back: int, length: int) -> None:
    if back > at or at + length > len(out):
        raise ValueError("bad back-reference")
    if back >= length:
        out[at : at + length] = out[at - back : at - back + length]
    else:
        out[at : at + length] = np.resize(out[at - back : at], length)


def _grey(bits: Bits, codes: list[Code], width: int, out: np.ndarray) -> None:
    """Pixels of one green symbol each: codes at all bit positions first, then the chain through them."""
    green = codes[0]
    rest = codes[3].first << 24 | codes[1].first << 16 | codes[2].first
    at, n = 0, len(out)
    base = bits.at >> 3
    data = np.frombuffer(bits.data, np.uint8)[base:].astype(np.int32)
    window = data[:-2] | data[1:-1] << 8 | data[2:] << 16
    window = (window[:, None] >> np.arange(8, dtype=np.int32)).ravel()
    window &= (1 << green.bits) - 1
    found = green.table[window]
    stop = len(found)
    step = np.arange(stop + 1, dtype=np.int32)
    step[:-1] += found & 15
    np.minimum(step, stop, out=step)
    step[:-1][found >= 256 << 4] = stop
    two = step[step]
    four = memoryview(two[two])
    origin = base * 8
    while at < n:
        q, spots = bits.at - origin, []
        for _ in range((n - at + 3) // 4):
            if q == stop:
                break
            spots.append(q)
            q = four[q]
        chain = np.empty((len(spots), 4), np.int32)
        chain[:, 0] = spots
        chain[:, 1] = step[chain[:, 0]]
        chain[:, 2] = two[chain[:, 0]]
        chain[:, 3] = step[chain[:, 2]]
        chain = chain.ravel()
        if len(chain) and (q == stop or len(chain) > n - at):
            chain = chain[: n - at]
            chain = chain[chain < stop]  # past a back-reference the chain stays at stop
            if len(chain) and found[chain[-1]] >= 256 << 4:
                chain = chain[:-1]
        m = len(chain)
        if m:
            out[at : at + m] = (found[chain] >> 4 << 8 | rest if rest < 1 << 31 else found[chain].astype(np.int64) >> 4 << 8 | rest)
            at += m
            last = int(chain[-1])
            bits.at = origin + last + (int(found[last]) & 15)
            if bits.at > bits.end:
                raise ValueError("picture data ends early")
        if at < n:
            s = bits.symbol(green)
            if s < 256:
                raise ValueError("picture data ends early")
            length = _extra(bits, s - 256)
            _copy(out, at, _distance(_extra(bits, bits.symbol(codes[4])), width), length)
            at += length


def _channels(pixels: np.ndarray) -> np.ndarray:
    """ARGB pixels as rows of four bytes: blue, green, red, alpha."""
    return np.ascontiguousarray(pixels).view(np.uint8).reshape(-1, 4)


def _tiled(values: np.ndarray, width: int, height: int, bits: int) -> np.ndarray:
    tiles_x = -(-width >> bits)
    return values.reshape(-1, tiles_x)[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits]


def predict(mode: int, left: list[int], top: list[int], top_left: list[int], top_right: list[int]) -> list[int]:
    """The predicted pixel, channel by channel, from its decoded neighbours."""
    half = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b)]
    clip = lambda v: 0 if v < 0 else 255 if v > 255 else v
    if mode == 0:
        return [0, 0, 0, 255]
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return half(half(left, top_right), top)
    if mode in (6, 7, 8, 9):
        return half(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return half(half(left, top_left), half(top, top_right))
    if mode == 11:
        by_left = sum(abs(t - c) for t, c in zip(top, top_left))
        by_top = sum(abs(s - c) for s, c in zip(left, top_left))
        return left if by_left < by_top else top
    if mode == 12:
        return [clip(s + t - c) for s, t, c in zip(left, top, top_left)]
    if mode == 13:
        mean = half(left, top)
        return [clip(m + int((m - c) / 2)) for m, c in zip(mean, top_left)]
    return [0, 0, 0, 255]


def _predictor_modes(x: int, y: int, mode: int) -> int:
    return 0 if not (x or y) else 1 if not y else 2 if not x else mode


def _predictor(pixels: np.ndarray, width: int, height: int, modes: np.ndarray, inverse: bool) -> np.ndarray:
    given = _channels(pixels).reshape(height, width, 4)
    result = np.zeros_like(given)
    known = result if inverse else given
    if inverse and (modes == modes.flat[0]).all() and modes.flat[0] in (0, 1, 2):
        return _simple_predictor(given, int(modes.flat[0]))
    for y in range(height):
        above = known[y - 1].tolist() if y else None
        row = None if inverse else given[y].tolist()
        source, done, left = given[y].tolist(), [], None
        for x in range(width):
            mode = _predictor_modes(x, y, int(modes[y, x]))
            top = above[x] if y else None
            top_left = above[x - 1] if y and x else None
            # Right of the last column stands the first pixel of the row at hand.
            if y:
                top_right = above[x + 1] if x + 1 < width else (done[0] if inverse else row[0]) if width > 1 or not inverse else (done[0] if done else [0, 0, 0, 0])
            else:
                top_right = None
            guess = predict(mode, left, top, top_left, top_right)
            sign = 1 if inverse else -1
            value = [(s + sign * g) & 255 for s, g in zip(source[x], guess)]
            done.append(value)
            left = value if inverse else source[x]
        result[y] = done
    return result.reshape(-1, 4).view(np.uint32).ravel()


def _simple_predictor(given: np.ndarray, mode: int) -> np.ndarray:
    """Inverse of no prediction, from the left, or from above, by running sums modulo 256."""
    out = given.astype(np.uint32)
    out[0, 0, 3] += 255
    if mode == 0:
        out[0] = np.cumsum(out[0], axis=0)
        out[1:, 0] += 0
        first = np.cumsum(out[:, 0], axis=0)
        out[1:, 1:, 3] += 255
        out[:, 0] = first
    elif mode == 1:
        out[:, 0] = np.cumsum(out[:, 0], axis=0)
        out = np.cumsum(out, axis=1)
    else:
        out[0] = np.cumsum(out[0], axis=0)
        out = np.cumsum(out, axis=0)
    return (out & 255).astype(np.uint8).reshape(-1, 4).view(np.uint32).ravel()


def _cross_colour(pixels: np.ndarray, width: int, height: int, tiles: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    c = _channels(pixels).copy()
    signed = lambda x: x.astype(np.uint8).view(np.int8).astype(np.int32)
    each = _tiled(tiles, width, height, bits).ravel()
    green_red, green_blue, red_blue = signed(each & 255), signed(each >> 8 & 255), signed(each >> 16 & 255)
    green = signed(c[:, 1])
    sign = 1 if inverse else -1
    was_red = c[:, 2].copy()
    c[:, 2] = (c[:, 2].astype(np.int32) + sign * (green_red * green >> 5)) & 255
    red = signed(c[:, 2] if inverse else was_red)
    c[:, 0] = (c[:, 0].astype(np.int32) + sign * ((green_blue * green >> 5) + (red_blue * red >> 5))) & 255
    return c.view(np.uint32).ravel()


def decode(stored: bytes) -> np.ndarray:
    """The ARGB pixels, height by width, of a lossless WebP file."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WEBP" or stored[12:16] != b"VP8L":
        raise ValueError("not a lossless WebP file")
    size = struct.unpack("<I", stored[16:20])[0]
    bits = Bits(stored[20 : 20 + size])
    if bits.read(8) != 0x2F:
        raise ValueError("bad signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, seen, full = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("transform given twice")
        seen.add(kind)
        if kind in (0, 1):
            b = bits.read(3) + 2
            tiles = _entropy_image(bits, -(-width >> b), -(-height >> b), False)
            undo.append((kind, width, b, tiles))
        elif kind == 2:
            undo.append((kind, width, 0, None))
        else:
            n = bits.read(8) + 1
            table = (np.cumsum(_channels(_entropy_image(bits, n, 1, False)), axis=0) & 255).astype(np.uint8)
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, width, packed, table.view(np.uint32).ravel()))
            width = -(-width >> packed)
    pixels = _entropy_image(bits, width, height, True)
    for kind, wide, b, extra in reversed(undo):
        if kind == 0:
            modes = _tiled(extra >> 8 & 15, wide, height, b)
            pixels = _predictor(pixels, wide, height, modes, True)
        elif kind == 1:
            pixels = _cross_colour(pixels, wide, height, extra, b, True)
        elif kind == 2:
            c = _channels(pixels).copy()
            c[:, 0] += c[:, 1]
            c[:, 2] += c[:, 1]
            pixels = c.view(np.uint32).ravel()
        else:
            index = pixels >> 8 & 255
            if b:
                each, n = 8 >> b, 1 << b
                index = (index.reshape(height, -1)[:, :, None] >> (np.arange(n, dtype=np.uint32) * each) & ((1 << each) - 1)).reshape(height, -1)[:, :wide].ravel()
            table = np.zeros(256, np.uint32)
            table[: len(extra)] = extra
            pixels = table[index]
    return pixels.reshape(height, full)


# --- writing ------------------------------------------------------------------


class Writer:
    """Fields of bits, lowest first, joined at the end."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.held |= value << self.n
        self.n += n

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._settle()
        self.parts.append((values, sizes))

    def _settle(self) -> None:
        if self.n:
            whole, rest = divmod(self.n, 32)
            words = np.frombuffer(self.held.to_bytes(4 * whole + 4, "little"), "<u4")
            self.parts.append((words.astype(np.uint64), np.array([32] * whole + [rest], np.int64)))
            self.held, self.n = 0, 0

    def bytes(self) -> bytes:
        self._settle()
        values, sizes = (np.concatenate(x) for x in zip(*self.parts))
        ends = np.cumsum(sizes)
        at = ends - sizes
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
        new = np.empty(len(word), bool)
        new[0] = True
        np.not_equal(word[1:], word[:-1], out=new[1:])
        starts = np.flatnonzero(new)
        out[word[starts]] = np.bitwise_or.reduceat(values << shift, starts)
        over = np.flatnonzero((at & 63) + sizes > 64)
        out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
        return out.astype("<u8").tobytes()[: (int(ends[-1]) + 7) // 8]


def _put_code(w: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and (not used or used[-1] < 256):
        first = used[0] if used else 0
        w.put(1 | (len(used) == 2) << 1 | (first > 1) << 2, 3)
        w.put(first, 8 if first > 1 else 1)
        if len(used) == 2:
            w.put(used[1], 8)
        return
    runs: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    for value, group in itertools.groupby(lengths.tolist()):
        n = len(list(group))
        if value:
            runs.append((value, 0, 0))
            n -= 1
        while n:
            if value == 0 and n >= 11:
                m = min(n, 138)
                runs.append((18, m - 11, 7))
            elif value == 0 and n >= 3:
                m = min(n, 10)
                runs.append((17, m - 3, 3))
            elif value and n >= 3:
                m = min(n, 6)
                runs.append((16, m - 3, 2))
            else:
                m = 1
                runs.append((value, 0, 0))
            n -= m
    meta = code_lengths(np.bincount([r[0] for r in runs], minlength=19), 7)
    last = max(k for k, s in enumerate(_LENGTH_ORDER) if meta[s])
    w.put(0, 1)
    w.put(max(last + 1, 4) - 4, 4)
    for k in range(max(last + 1, 4)):
        w.put(int(meta[_LENGTH_ORDER[k]]), 3)
    w.put(0, 1)
    codes, sizes = canonical(meta).tolist(), meta.tolist() if np.count_nonzero(meta) > 1 else [0] * 19
    held, at = 0, 0
    for s, extra, n in runs:
        held |= (codes[s] if sizes[s] else 0) << at | extra << at + sizes[s]
        at += sizes[s] + n
    w.put(held, at)


def _prefix(value: int) -> tuple[int, int, int]:
    """Symbol, extra value and extra bits of a length or distance code."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    return 2 * top + second, v - ((2 + second) << (top - 1)), top - 1


def _put_image(w: Writer, pixels: np.ndarray, width: int, main: bool, cache_bits: int = 0, run: int = 16) -> None:
    """One group of prefix codes; runs of a colour of ``run`` pixels or more are back-references."""
    n = len(pixels)
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    edges = np.flatnonzero(pixels[1:] != pixels[:-1]) + 1
    bounds = np.concatenate([[0], edges, [n]])
    long = np.flatnonzero(np.diff(bounds) > run)
    keep = np.ones(n, bool)
    refs: list[tuple[int, int]] = []  # position, length
    for k in long.tolist():
        a, b = int(bounds[k]) + 1, int(bounds[k + 1])
        keep[a:b] = False
        refs += [(s, min(4096, b - s)) for s in range(a, b, 4096)]
    at = np.flatnonzero(keep)
    c = _channels(pixels[at])
    green, literal = c[:, 1].astype(np.int64), np.ones(len(at), bool)
    if cache_bits:
        cache = np.full(1 << cache_bits, -1, np.int64)
        held, slot = pixels.astype(np.int64), (pixels.astype(np.uint64) * np.uint64(_HASH) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)
        slot, row = slot.astype(np.int64), 0
        for p in range(n):
            if keep[p]:
                if cache[slot[p]] == held[p]:
                    green[row], literal[row] = 280 + slot[p], False
                row += 1
            cache[slot[p]] = held[p]
    near = _NEAR.index((1, 0)) + 1
    far_symbol = _prefix(near)[0]
    coded = [_prefix(length) for _, length in refs]
    counts = np.bincount(green, minlength=280 + ((1 << cache_bits) if cache_bits else 0))
    for s, _, _ in coded:
        counts[256 + s] += 1
    plain = c if not cache_bits else c[literal]
    lengths = [code_lengths(counts, _LIMIT)]
    for k in (2, 0, 3):
        if len(plain) and (plain[:, k] == plain[0, k]).all():
            lengths.append(np.zeros(256, np.int64))
            lengths[-1][plain[0, k]] = 1
        else:
            lengths.append(code_lengths(np.bincount(plain[:, k], minlength=256), 15))
    lengths.append(np.zeros(40, np.int64))
    lengths[4][far_symbol] = bool(refs)
    for x in lengths:
        _put_code(w, x)
    for k, x in enumerate(lengths):
        if np.count_nonzero(x) == 1:
            lengths[k] = np.zeros_like(x)  # the only symbol takes no bits
    codes = [canonical(x) for x in lengths]
    values = codes[0][green].astype(np.uint64)
    sizes = lengths[0][green]
    for k, channel in ((1, 2), (2, 0), (3, 3)):
        if lengths[k].any():
            v, m = codes[k][c[:, channel]].astype(np.uint64), np.where(literal, lengths[k][c[:, channel]], 0)
            values = values | np.where(literal, v, 0).astype(np.uint64) << sizes.astype(np.uint64)
            sizes = sizes + m
    if refs:
        spots = np.searchsorted(at, [p for p, _ in refs])
        v = [int(codes[0][256 + s]) | x << int(lengths[0][256 + s]) for s, x, _ in coded]
        m = [int(lengths[0][256 + s]) + b + int(lengths[4][far_symbol]) for s, _, b in coded]
        v = [x | int(codes[4][far_symbol]) * bool(lengths[4][far_symbol]) << int(lengths[0][256 + s]) + b for x, (s, _, b) in zip(v, coded)]
        values, sizes = np.insert(values, spots, np.array(v, np.uint64)), np.insert(sizes, spots, m)
    w.put_all(values, sizes)


def encode(pixels: np.ndarray, transforms: tuple[str, ...] = (), cache_bits: int = 0, run: int = 16, mode: int = 11, cross: tuple[int, int, int] = (20, 236, 9)) -> bytes:
    """A lossless WebP file of ARGB pixels (height by width), with the named transforms in that order.

    ``predictor`` uses ``mode``, ``cross_colour`` the three multipliers ``cross``
    (signed bytes) in all tiles; ``palette`` takes at most 256 colours.
    """
    height, width = pixels.shape
    flat = np.ascontiguousarray(pixels, np.uint32).ravel()
    w = Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (int((_channels(flat)[:, 3] != 255).any()), 1), (0, 3)):
        w.put(value, n)
    for name in transforms:
        w.put(1, 1)
        if name == "predictor":
            b = 4
            w.put(0, 2)
            w.put(b - 2, 3)
            tiles = np.full(-(-width >> b) * -(-height >> b), 0xFF000000 | mode << 8, np.uint32)
            _put_image(w, tiles, -(-width >> b), False)
            flat = _predictor(flat, width, height, np.full((height, width), mode), False)
        elif name == "cross_colour":
            b = 4
            w.put(1, 2)
            w.put(b - 2, 3)
            tiles = np.full(-(-width >> b) * -(-height >> b), 0xFF000000 | cross[2] << 16 | cross[1] << 8 | cross[0], np.uint32)
            _put_image(w, tiles, -(-width >> b), False)
            flat = _cross_colour(flat, width, height, tiles, b, False)
        elif name == "subtract_green":
            w.put(2, 2)
            c = _channels(flat).copy()
            c[:, 0] -= c[:, 1]
            c[:, 2] -= c[:, 1]
            flat = c.view(np.uint32).ravel()
        else:
            w.put(3, 2)
            table, index = np.unique(flat, return_inverse=True)
            if len(table) > 256:
                raise ValueError("too many colours for a palette")
            w.put(len(table) - 1, 8)
            steps = _channels(table).copy()
            steps[1:] -= _channels(table)[:-1]
            _put_image(w, steps.view(np.uint32).ravel(), len(table), False)
            n = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
            index = index.reshape(height, width).astype(np.uint32)
            if n:
                each, per = 8 >> n, 1 << n
                packed = np.zeros((height, -(-width >> n) * per), np.uint32)
                packed[:, :width] = index
                index = (packed.reshape(height, -1, per) << (np.arange(per, dtype=np.uint32) * each)).sum(axis=2, dtype=np.uint32)
            width = index.shape[1]
            flat = (index.ravel() << 8) | np.uint32(0xFF000000)
    w.put(0, 1)
    _put_image(w, flat, width, True, cache_bits, run)
    body = w.bytes()
    body += b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body


def _entropy(samples: np.ndarray) -> float:
    """Bits of the samples by their own frequencies, and of the code lengths that tell these."""
    counts = np.bincount(samples, minlength=256)
    counts = counts[counts > 0]
    return float(len(samples) * np.log2(len(samples)) - (counts * np.log2(counts)).sum()) + 5 * len(counts)


def choose(samples: np.ndarray) -> tuple[tuple[str, ...], int]:
    """The transforms of a grey picture (height by width) that are estimated to take the fewest bits, and the predictor's mode.

    A palette for up to 16 values; else green alone, or after prediction by the pixel to the left or above.
    """
    flat = samples.ravel()
    if np.count_nonzero(np.bincount(flat, minlength=256)) <= 16:
        return ("palette",), 0
    # The first row is predicted from the left, the first column from above.
    left = samples.copy()
    left[:, 1:] -= samples[:, :-1]
    left[1:, 0] -= samples[:-1, 0]
    above = left.copy()
    above[1:] = samples[1:] - samples[:-1]
    options = [(_entropy(flat), ("subtract_green",), 0), (_entropy(left.ravel()) + 100, ("predictor", "subtract_green"), 1)]
    if len(samples) > 1:
        options.append((_entropy(above.ravel()) + 100, ("predictor", "subtract_green"), 2))
    return min(options)[1:]


def store(payload: bytes) -> bytes:
    """The payload as grey pictures: samples in green, and red and blue equal to it by the green transform.

    Each picture has the transforms of ``choose``; a palette holds several samples to a pixel.
    """
    out = []
    for start in range(0, len(payload), WIDTH * HEIGHT):
        samples = np.frombuffer(payload, np.uint8)[start : start + WIDTH * HEIGHT].reshape(-1, WIDTH)
        transforms, mode = choose(samples)
        out.append(encode(samples.astype(np.uint32) * np.uint32(0x010101) | np.uint32(0xFF000000), transforms, mode=mode))
    return b"".join(out)


def load(stored: bytes) -> bytes:
    """The samples of the pictures that follow each other in the stored form."""
    out, at = [], 0
    while at < len(stored):
        size = 8 + struct.unpack("<I", stored[at + 4 : at + 8])[0]
        out.append((decode(stored[at : at + size]) >> 8 & 255).astype(np.uint8).tobytes())
        at += size
    return b"".join(out)


def payload_of(text: str | None, unit: int = WIDTH) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + b"\xff" * (-len(data) % unit or (0 if data else unit))


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the 64-bit mean hash of an 8 by 8 reduction."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256).astype(np.float64)
    mean = float(counts @ _VALUES) / len(x)
    dev = float(np.sqrt(max(0.0, float(counts @ _SQUARES) / len(x) - mean**2)))
    p = counts[counts > 0] / len(x)
    cells = x[: len(x) // 64 * 64].reshape(64, -1).sum(axis=1)
    bits = np.packbits(cells * 64 > cells.sum()).tobytes().hex()
    return f"{mean:.4f};{dev:.4f};{float(-(p * np.log2(p)).sum()):.4f};{bits}"


_VALUES = np.arange(256, dtype=np.float64)
_SQUARES = _VALUES**2


#: What ``media`` can return, by name, from (unpadded bytes, stored form, payload read back).
OUTPUTS = {
    "media": (T.BinaryType(), pa.binary(), lambda n, m, p: m),
    "payload": (T.BinaryType(), pa.binary(), lambda n, m, p: p),
    "n_bytes": (T.LongType(), pa.int64(), lambda n, m, p: n),
    "payload_bytes": (T.LongType(), pa.int64(), lambda n, m, p: len(p)),
    "payload_sha256": (T.StringType(), pa.string(), lambda n, m, p: hashlib.sha256(p).hexdigest()),
    "tail_crc32": (T.LongType(), pa.int64(), lambda n, m, p: zlib.crc32(p[-32:])),
    "media_bytes": (T.LongType(), pa.int64(), lambda n, m, p: len(m)),
    "media_sha256": (T.StringType(), pa.string(), lambda n, m, p: hashlib.sha256(m).hexdigest()),
    "feature": (T.StringType(), pa.string(), lambda n, m, p: feature(p)),
}


def media(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("n_bytes", "media", "payload")) -> DataFrame:
    """Stores every whole text as pictures and reads them back; ``keep`` and the named outputs.  No shuffle."""
    small_batches(df.sparkSession)
    kept = [c for c in keep if c not in outputs]
    src = df.select(*kept, df[text_col].alias("__text"))
    schema = T.StructType([*src.select(*kept).schema.fields, *(T.StructField(n, OUTPUTS[n][0], True) for n in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in outputs]
            for text in batch.column(batch.num_columns - 1).to_pylist():
                n, payload = payload_of(text)
                stored = store(payload)
                back = load(stored)
                for column, name in zip(columns, outputs):
                    column.append(OUTPUTS[name][2](n, stored, back))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, OUTPUTS[n][1]) for c, n in zip(columns, outputs))], names=[*kept, *outputs])

    return src.mapInArrow(run, schema)
