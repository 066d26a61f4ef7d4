"""Media columns in lossless WebP: texts as bytes in pixel arrays, and a decoder for any lossless WebP file.

The decoder reads prefix codes (simple and normal, with meta codes), back-references with the neighbourhood distance map, and
the colour cache, and inverts the predictor, cross-colour, subtract-green and palette transforms.  Many files with one group of
prefix codes and no cache are decoded in step, one pixel of each at a time, by table look-ups over arrays; all others
pixel by pixel.  The encoder writes files of at most TILE bytes of payload, 16 pixels wide: literals in fixed prefix codes, made for
text by a rule, and a back-reference for the zeros at the end.  A longer text is several files, one after the other.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bytes_of, only, text_slices

TILE = 1 << 14
WIDTH = 16

#: Fixed values of the format: the order of code lengths, and the neighbours that the first 120 distance codes mean.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEIGHBOURS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_HASH = 0x1E35A7BD


class Bits:
    """Bits of a file, the least significant of each byte first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def peek(self, n: int) -> int:
        return (int.from_bytes(self.data[self.at >> 3: (self.at + n + 7) >> 3], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        if self.at > len(self.data) * 8:
            raise ValueError("the image ends too early")
        return v


class Code:
    """A prefix code as a table from the next `depth` bits to symbol and length."""

    def __init__(self, lengths):
        lengths = np.asarray(lengths, np.int64)
        used = np.flatnonzero(lengths)
        if len(used) <= 1:
            self.depth, self.table = 0, np.array([(int(used[0]) if len(used) else 0) << 4], np.int64)
            return
        if int((1 << (15 - lengths[used])).sum()) != 1 << 15:
            raise ValueError("not a complete prefix code")
        self.depth = int(lengths.max())
        self.table = np.zeros(1 << self.depth, np.int64)
        for s, c in canonical(lengths).items():
            n = int(lengths[s])
            self.table[c:: 1 << n] = s << 4 | n

    def read(self, bits: Bits) -> int:
        v = int(self.table[bits.peek(self.depth)])
        bits.at += v & 15
        return v >> 4


def canonical(lengths) -> dict[int, int]:
    """Symbol -> its code with the bits in the order in which they are written."""
    out, code = {}, 0
    for n in range(1, 16):
        code <<= 1
        for s in np.flatnonzero(np.asarray(lengths) == n).tolist():
            out[s] = int(f"{code:0{n}b}"[::-1], 2)
            code += 1
    return out


def read_code(bits: Bits, alphabet: int) -> Code:
    lengths = [0] * alphabet
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    first = [0] * 19
    for i in range(4 + bits.read(4)):
        first[LENGTH_ORDER[i]] = bits.read(3)
    coder = Code(first)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, last = 0, 8
    while at < alphabet and left > 0:
        left -= 1
        s = coder.read(bits)
        if s < 16:
            lengths[at] = s
            at += 1
            last = s or last
        else:
            n = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
            if at + n > alphabet:
                raise ValueError("too many code lengths")
            lengths[at: at + n] = [last if s == 16 else 0] * n
            at += n
    return Code(lengths)


def read_group(bits: Bits, cache_bits: int) -> list[Code]:
    """The five codes of a group: green with lengths and cache, red, blue, alpha, distance."""
    return [read_code(bits, n) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]


def value(bits: Bits, code: int) -> int:
    """The length or distance that a prefix code and its extra bits stand for."""
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    dx, dy = NEIGHBOURS[code - 1]
    return max(1, dx + dy * width)


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB values, pixel by pixel."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("too large a colour cache")
    meta, meta_bits, groups = None, 0, 1
    if main and bits.read(1):
        meta_bits = bits.read(3) + 2
        mw = (width + (1 << meta_bits) - 1) >> meta_bits
        meta = (read_pixels(bits, mw, (height + (1 << meta_bits) - 1) >> meta_bits, False) >> 8) & 0xFFFF
        meta, groups = meta.reshape(-1, mw), int(meta.max()) + 1
    codes = [read_group(bits, cache_bits) for _ in range(groups)]
    cache = [0] * (1 << cache_bits) if cache_bits else None
    out = [0] * (width * height)
    at = 0
    while at < len(out):
        g = codes[int(meta[(at // width) >> meta_bits, (at % width) >> meta_bits])] if meta is not None else codes[0]
        s = g[0].read(bits)
        if 256 <= s < 280:
            n = value(bits, s - 256)
            d = distance(value(bits, g[4].read(bits)), width)
            if d > at or at + n > len(out):
                raise ValueError("a reference out of the image")
            for _ in range(n):
                out[at] = out[at - d]
                if cache:
                    cache[(CACHE_HASH * out[at] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[at]
                at += 1
            continue
        if s < 256:
            red, blue, alpha = g[1].read(bits), g[2].read(bits), g[3].read(bits)
            p = alpha << 24 | red << 16 | s << 8 | blue
        else:
            p = cache[s - 280]
        out[at] = p
        if cache:
            cache[(CACHE_HASH * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        at += 1
    return np.array(out, np.uint32)


# --- transforms ----------------------------------------------------------------------------------------------------


def channels(argb: np.ndarray) -> np.ndarray:
    """(..., 4) samples: alpha, red, green, blue."""
    return np.ascontiguousarray(argb.astype(">u4")).view(np.uint8).reshape(*argb.shape, 4)


def joined(samples: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(samples.astype(np.uint8)).view(">u4").reshape(samples.shape[:-1]).astype(np.uint32)


def _half(a, b):
    return (a + b) >> 1


def _select(left, top, corner):
    p = left + top - corner
    return left if np.abs(p - left).sum() < np.abs(p - top).sum() else top


def _toward_zero(x):
    return np.where(x < 0, -((-x) >> 1), x >> 1)


#: Predictions from left, top, top right and top left, by mode.
PREDICT = {
    0: lambda l, t, r, c: np.array([255, 0, 0, 0]),
    1: lambda l, t, r, c: l,
    2: lambda l, t, r, c: t,
    3: lambda l, t, r, c: r,
    4: lambda l, t, r, c: c,
    5: lambda l, t, r, c: _half(_half(l, r), t),
    6: lambda l, t, r, c: _half(l, c),
    7: lambda l, t, r, c: _half(l, t),
    8: lambda l, t, r, c: _half(c, t),
    9: lambda l, t, r, c: _half(t, r),
    10: lambda l, t, r, c: _half(_half(l, c), _half(t, r)),
    11: lambda l, t, r, c: _select(l, t, c),
    12: lambda l, t, r, c: np.clip(l + t - c, 0, 255),
    13: lambda l, t, r, c: np.clip(_half(l, t) + _toward_zero(_half(l, t) - c), 0, 255),
}


def undo_predictor(argb: np.ndarray, modes: np.ndarray, size_bits: int) -> np.ndarray:
    h, w = argb.shape
    x = channels(argb).astype(np.int64).reshape(h * w, 4)
    for i in range(h * w):
        row, col = divmod(i, w)
        if i == 0:
            p = PREDICT[0](None, None, None, None)
        elif row == 0:
            p = x[i - 1]
        elif col == 0:
            p = x[i - w]
        else:
            mode = int(modes[row >> size_bits, col >> size_bits])
            p = PREDICT[mode if mode < 14 else 0](x[i - 1], x[i - w], x[i - w + 1], x[i - w - 1])
        x[i] = (x[i] + p) & 255
    return joined(x.reshape(h, w, 4))


def undo_cross_colour(argb: np.ndarray, factors: np.ndarray, size_bits: int) -> np.ndarray:
    h, w = argb.shape
    f = channels(factors)[np.arange(h)[:, None] >> size_bits, np.arange(w)[None, :] >> size_bits].view(np.int8).astype(np.int64)
    x = channels(argb).astype(np.int64)
    signed = lambda v: ((v & 255) ^ 128) - 128
    green = signed(x[..., 2])
    red = (x[..., 1] + (f[..., 3] * green >> 5)) & 255
    blue = (x[..., 3] + (f[..., 2] * green >> 5) + (f[..., 1] * signed(red) >> 5)) & 255
    return joined(np.stack([x[..., 0], red, x[..., 2], blue], -1))


def undo_subtract_green(argb: np.ndarray) -> np.ndarray:
    x = channels(argb).astype(np.int64)
    return joined(np.stack([x[..., 0], (x[..., 1] + x[..., 2]) & 255, x[..., 2], (x[..., 3] + x[..., 2]) & 255], -1))


def undo_palette(argb: np.ndarray, palette: np.ndarray, width: int, width_bits: int) -> np.ndarray:
    index = ((argb >> 8) & 255).astype(np.int64)
    if width_bits:
        each, per = 8 >> width_bits, 1 << width_bits
        index = ((index[:, :, None] >> (np.arange(per) * each)) & ((1 << each) - 1)).reshape(len(index), -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index]


def read_header(data: bytes, start: int = 0) -> tuple[int, int, int, int]:
    """(width, height, first bit after the header, end of the file) of the file that starts at `start`."""
    if data[start: start + 4] != b"RIFF" or data[start + 8: start + 16] != b"WEBPVP8L" or data[start + 20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    end = start + 8 + struct.unpack_from("<I", data, start + 4)[0]
    head = struct.unpack_from("<I", data, start + 21)[0]
    if head >> 29:
        raise ValueError("unknown version")
    return (head & 0x3FFF) + 1, (head >> 14 & 0x3FFF) + 1, (start + 25) * 8, end


def decode(data: bytes, start: int = 0) -> np.ndarray:
    """The (height, width) ARGB values of any lossless WebP file."""
    width, height, at, end = read_header(data, start)
    bits = Bits(data[:end], at)
    undo, w = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (0, 1):
            size_bits = bits.read(3) + 2
            bw, bh = (w + (1 << size_bits) - 1) >> size_bits, (height + (1 << size_bits) - 1) >> size_bits
            table = read_pixels(bits, bw, bh, False).reshape(bh, bw)
            undo.append((lambda x, t=(table >> 8) & 15, s=size_bits: undo_predictor(x, t, s)) if kind == 0 else (lambda x, t=table, s=size_bits: undo_cross_colour(x, t, s)))
        elif kind == 2:
            undo.append(undo_subtract_green)
        else:
            n = bits.read(8) + 1
            palette = joined(np.cumsum(channels(read_pixels(bits, n, 1, False)).astype(np.int64), axis=0) & 255)
            width_bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append(lambda x, p=palette, full=w, b=width_bits: undo_palette(x, p, full, b))
            w = (w + (1 << width_bits) - 1) >> width_bits
    out = read_pixels(bits, w, height, True).reshape(height, w)
    for f in reversed(undo):
        out = f(out)
    return out


# --- many files in step --------------------------------------------------------------------------------------------

_GROUPS: dict[int, list[tuple[int, int, list[Code]]]] = {}


def _plain_group(data: bytes, at: int) -> tuple[int, list[Code]] | None:
    """(first bit of the pixels, codes) if a file has no transform, cache or meta codes; codes seen before are known by their bits."""
    bits = Bits(data, at)
    if bits.peek(3):
        return None
    sign = bits.peek(96)
    for n, raw, codes in _GROUPS.get(sign, ()):
        if bits.peek(n) == raw:
            return at + n, codes
    bits.read(3)
    codes = read_group(bits, 0)
    n = bits.at - at
    bits.at = at
    if len(_GROUPS) > 256:
        _GROUPS.clear()
    _GROUPS.setdefault(sign, []).append((n, bits.peek(n), codes))
    return at + n, codes


SLACK = 16


def decode_many(data: bytes, starts: list[int]) -> list[np.ndarray]:
    """The ARGB values of many lossless WebP files in `data`, flat, in row order."""
    out: list[np.ndarray | None] = [None] * len(starts)
    lanes: dict[int, list[tuple[int, int, int, int, int]]] = {}
    codes_of = {}
    for k, s in enumerate(starts):
        width, height, at, end = read_header(data, s)
        found = _plain_group(data, at)
        if found is None or sum(c.depth for c in found[1][:4]) > 57:
            out[k] = decode(data, s).ravel()
        else:
            codes_of[id(found[1])] = found[1]
            lanes.setdefault(id(found[1]), []).append((width * height, found[0], width, end, k))
    if lanes:
        raw = np.frombuffer(data + bytes(SLACK * 8 + 8), np.uint8)
        word = np.zeros(len(raw) - 7, np.uint64)
        for i in range(8):
            word |= raw[i: len(raw) - 7 + i].astype(np.uint64) << np.uint64(8 * i)
    for which, some in lanes.items():
        some.sort(reverse=True)
        for k, pixels in zip([x[4] for x in some], _in_step(data, word, codes_of[which], some), strict=True):
            out[k] = pixels
    return out


def _in_step(data: bytes, word: np.ndarray, codes: list[Code], lanes: list[tuple[int, int, int, int, int]]) -> list[np.ndarray]:
    size = np.array([x[0] for x in lanes])
    base = np.append(0, np.cumsum(size + SLACK))
    out = np.zeros(base[-1], np.uint32)
    where, pos, end = base[:-1].copy(), np.array([x[1] for x in lanes]), base[:-1] + size
    lane = np.arange(len(lanes))
    (tg, mg), (tr, mr), (tb, mb), (ta, ma) = [(c.table.astype(np.uint64), np.uint64((1 << c.depth) - 1)) for c in codes[:4]]
    four, fifteen = np.uint64(4), np.uint64(15)
    top = len(word) - 1
    while len(lane):
        for _ in range(SLACK):
            v = word[np.minimum(pos >> 3, top)] >> (pos & 7).astype(np.uint64)
            e = tg[v & mg]
            n = e & fifteen
            used = n
            v >>= n
            g = e >> four
            odd = g >= 256
            if odd.any():
                odd = np.flatnonzero(odd & (where < end))
            else:
                odd = ()
            e = tr[v & mr]
            n = e & fifteen
            used = used + n
            v >>= n
            p = (e >> four) << np.uint64(16) | g << np.uint64(8)
            e = tb[v & mb]
            n = e & fifteen
            used += n
            v >>= n
            p |= e >> four
            e = ta[v & ma]
            used += e & fifteen
            p |= (e >> four) << np.uint64(24)
            keep = [(i, int(pos[i]), int(where[i])) for i in odd]
            out[where] = p
            pos = pos + used.astype(np.int64)
            where = where + 1
            for i, at, w in keep:  # a back-reference: copy within the lane
                bits = Bits(data, at)
                s = codes[0].read(bits)
                n = value(bits, s - 256)
                d = distance(value(bits, codes[4].read(bits)), lanes[lane[i]][2])
                first = base[lane[i]]
                if d > w - first or w + n > end[i]:
                    raise ValueError("a reference out of the image")
                for j in range(w, w + n):
                    out[j] = out[j - d]
                pos[i], where[i] = bits.at, w + n
            # a lane that is done runs on into its own slack, at most SLACK pixels of it
            where = np.minimum(where, end + SLACK - 1)
        live = where < end
        if not live.all():
            lane, pos, where, end = lane[live], pos[live], where[live], end[live]
    return [out[b: b + n] for b, n in zip(base[:-1], size, strict=True)]


# --- encoder -------------------------------------------------------------------------------------------------------


def text_lengths(alphabet: int, most: int = 14) -> np.ndarray:
    """Code lengths made for text by a rule: Huffman lengths of a fixed prior, flattened until none is above `most`."""
    weight = np.full(alphabet, 2.0)
    weight[32:127] = 20
    weight[0x80:0xC0] = 20
    weight[0xC3] = 40
    for rank, c in enumerate(" etanoirshdlucmpgbfvwykxjqz"):
        weight[ord(c)] = 4000 / (rank + 1) ** 0.8
    weight[[0, 10, 44, 46]] = (200, 60, 60, 150)
    weight[256:272] = 40
    while True:
        heap = [(w, i, (i,)) for i, w in enumerate(weight.tolist())]
        heapq.heapify(heap)
        length = np.zeros(alphabet, np.int64)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            length[list(a[2] + b[2])] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if length.max() <= most:
            return length
        weight = weight + 1


class Writer:
    """Bits, the least significant of each byte first."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, v: int, n: int) -> None:
        self.value |= v << self.n
        self.n += n

    def lengths(self, lengths) -> None:
        """A normal prefix code; runs of a length are said by code 16, which takes one bit."""
        first = [5] * 16 + [1, 0, 0]
        self.put(0, 1)
        self.put(15, 4)
        for s in LENGTH_ORDER:
            self.put(first[s], 3)
        self.put(0, 1)
        code = canonical(first)
        at, last = 0, 0
        while at < len(lengths):
            n = int(lengths[at])
            run = 1
            while at + run < len(lengths) and lengths[at + run] == n and run < 6:
                run += 1
            if n == last and n and run >= 3:
                self.put(code[16], 1)
                self.put(run - 3, 2)
                at += run
            else:
                self.put(code[n], 5)
                at += 1
            last = n or last

    def only(self, symbol: int) -> None:
        """A simple code of one symbol, which then takes no bits."""
        self.put(0b101, 3)
        self.put(symbol, 8)


def _fixed():
    w = Writer()
    w.put(0, 3)  # no transform, no cache, no meta codes
    green, rest = text_lengths(280), text_lengths(256)
    w.lengths(green)
    for _ in range(3):
        w.lengths(rest)
    w.only(1)  # distances: the pixel to the left
    codes = []
    for lengths in (green, rest):
        c = canonical(lengths)
        codes.append((np.array([c[i] for i in range(len(lengths))], np.uint64), lengths))
    return w, codes


HEAD, (GREEN, REST) = _fixed()
LEAD = 25  # bytes before the bits


def _run_code(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value and number of bits that say a run of n pixels, for n from 0 (nothing) to 15."""
    v, k = np.zeros(16, np.uint64), np.zeros(16, np.int64)
    for i in range(1, 16):
        if i <= 4:
            s, extra, more = i - 1, 0, 0
        else:
            extra = 1 if i <= 8 else 2
            s = next(c for c in range(4, 24) if (c - 2) >> 1 == extra and ((2 + (c & 1)) << extra) < i <= ((2 + (c & 1)) << extra) + (1 << extra))
            more = i - 1 - ((2 + (s & 1)) << extra)
        n0 = int(GREEN[1][256 + s])
        v[i], k[i] = int(GREEN[0][256 + s]) | more << n0, n0 + extra
    return v[n], k[n]


def encode_many(data: np.ndarray, off: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The files of texts laid end to end, as bytes, and each text's padded size."""
    n = np.diff(off)
    padded = np.maximum(64, (n + 63) // 64 * 64)
    start = np.append(0, np.cumsum(padded))
    payload = np.zeros(start[-1], np.uint8)
    payload[np.arange(len(data)) + np.repeat(start[:-1] - off[:-1], n)] = data
    # tiles
    per = -(-padded // TILE)
    text = np.repeat(np.arange(len(n)), per)
    k = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    first = start[text] + k * TILE
    size = np.minimum(TILE, start[text + 1] - first)
    pixel = payload.view("<u4")
    last = pixel[(first + size)[:, None] // 4 - 1 - np.arange(15)[None, :]]
    zeros = np.cumprod(last == 0, axis=1).sum(1)
    run = np.maximum(0, zeros - 1)  # pixels said by the reference; the pixel before them is a zero one
    literal = size // 4 - run
    # bits of each pixel: up to 56, in the order green, red, blue, alpha
    four = payload.reshape(-1, 4)
    nb = GREEN[1][four[:, 0]]
    bits = GREEN[0][four[:, 0]].copy()
    for c in (1, 2, 3):
        bits |= REST[0][four[:, c]] << nb.astype(np.uint64)
        nb = nb + REST[1][four[:, c]]
    tile = np.repeat(np.arange(len(first)), size // 4)
    inner = np.arange(len(four)) - np.repeat(first // 4, size // 4)
    said = inner < literal[tile]
    nb = np.where(said, nb, 0)
    total = np.add.reduceat(nb, first // 4)
    rv, rk = _run_code(run)
    chunk = (HEAD.n + total + rk + 7) // 8 + 5
    whole = LEAD - 5 + chunk + (chunk & 1)
    at = np.append(0, np.cumsum(whole))
    out = np.zeros(at[-1] + 16, np.float64)
    before = np.cumsum(nb) - nb
    pos = before - before[first // 4][tile] + (at[:-1][tile] + LEAD) * 8 + HEAD.n
    pos, bits = np.append(pos[said], (at[:-1] + LEAD) * 8 + HEAD.n + total), np.append(bits[said], rv)
    bits <<= (pos & 7).astype(np.uint64)
    byte = pos >> 3
    for i in range(8):
        out += np.bincount(byte + i, weights=((bits >> np.uint64(8 * i)) & np.uint64(255)).astype(np.float64), minlength=len(out))[: len(out)]
    out = out.astype(np.uint8)
    head = np.frombuffer(HEAD.value.to_bytes((HEAD.n + 7) // 8, "little"), np.uint8)
    out[(at[:-1] + LEAD)[:, None] + np.arange(len(head))] |= head
    put = lambda where, v: out.__setitem__((at[:-1] + where)[:, None] + np.arange(4), v.astype("<u4")[:, None].view(np.uint8))
    fixed = np.frombuffer(b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f", np.uint8)
    out[at[:-1][:, None] + np.arange(21)] = fixed
    put(4, whole - 8)
    put(16, chunk)
    put(21, (WIDTH - 1) | (size // 64 - 1) << 14 | 1 << 28)
    raw = out[: at[-1]].tobytes()
    ends = np.append(0, np.cumsum(per))
    return [raw[at[a]: at[b]] for a, b in zip(ends[:-1], ends[1:], strict=True)], padded


def files_in(media: bytes) -> list[int]:
    """Where the files in a media value start."""
    out, at = [], 0
    while at < len(media):
        out.append(at)
        at = read_header(media, at)[3]
    return out


def payload_of(pixels: np.ndarray) -> bytes:
    """The payload bytes of pixels: green, red, blue, alpha of each."""
    return np.ascontiguousarray(channels(pixels)[:, [2, 1, 3, 0]]).tobytes()


# --- operators -----------------------------------------------------------------------------------------------------


def encode(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `carry` of docs with n_bytes and media, the text (null: empty) as lossless WebP files.

    Equal texts get equal media.  Columns beyond `carry` are not read; one of the names of the results gives way to it.
    """
    carry = tuple(c for c in carry if c not in ("n_bytes", "media"))
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches):
        for t in text_slices(batches):
            data, off = bytes_of(t["text"])
            media, _ = encode_many(data, off)
            yield pa.RecordBatch.from_arrays([t[c].combine_chunks() for c in carry] + [pa.array(np.diff(off).astype(np.int64)), pa.array(media, pa.binary())], names=[*carry, "n_bytes", "media"])

    return only(docs, *dict.fromkeys([*carry, "text"])).mapInArrow(run, schema)


def _decoded(stored: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """Width, height and ARGB values (flat, in row order) of every file of each media value."""
    data = b"".join(stored)
    starts, owner, at = [], [], 0
    for i, m in enumerate(stored):
        own = files_in(m)
        starts += [at + s for s in own]
        owner += [i] * len(own)
        at += len(m)
    out: list[list[tuple[int, int, np.ndarray]]] = [[] for _ in stored]
    for i, s, argb in zip(owner, starts, decode_many(data, starts), strict=True):
        out[i].append((*read_header(data, s)[:2], argb))
    return out


def pixels(media: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `carry` with images: width, height and ARGB values (in row order) of every lossless WebP file of media.

    Null or empty media: no images.  A column of `carry` that is called images gives way to the result.
    """
    carry = tuple(c for c in carry if c != "images")
    image = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("argb", T.ArrayType(T.LongType()))])
    schema = T.StructType([media.schema[c] for c in carry] + [T.StructField("images", T.ArrayType(image))])
    kind = pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32()), ("argb", pa.list_(pa.int64()))]))

    def run(batches):
        for t in text_slices(batches, text="media", most=1 << 18):
            images = [[{"width": w, "height": h, "argb": argb.ravel().astype(np.int64)} for w, h, argb in own] for own in _decoded([m or b"" for m in t["media"].to_pylist()])]
            yield pa.RecordBatch.from_arrays([t[c].combine_chunks() for c in carry] + [pa.array(images, kind)], names=[*carry, "images"])

    return only(media, *dict.fromkeys([*carry, "media"])).mapInArrow(run, schema)


READ = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def read_back(media: DataFrame, carry: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """The columns `carry` with what the stored files hold: payload size and hash, CRC-32 of its last 64 bytes, size and hash of the
    files, and a feature string (files, rows of pixels, mean and largest sample, distinct samples).  Null media: no payload.
    """
    carry = tuple(c for c in carry if c not in READ)
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    schema = T.StructType([media.schema[c] for c in carry] + [T.StructField(n, T.LongType() if k == pa.int64() else T.StringType()) for n, k in zip(READ, kinds, strict=True)])

    def run(batches):
        for t in text_slices(batches, text="media", most=1 << 21):
            stored = [m or b"" for m in t["media"].to_pylist()]
            parts = [[payload_of(argb) for _, _, argb in own] for own in _decoded(stored)]
            rows = {n: [] for n in READ}
            for m, p in zip(stored, parts, strict=True):
                payload = b"".join(p)
                a = np.frombuffer(payload, np.uint8)
                mean = f"{a.mean():.4f}" if len(a) else "0"
                seen = int((np.bincount(a, minlength=256) > 0).sum())
                values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(),
                          f"files={len(p)};rows={len(payload) // 64};mean={mean};max={int(a.max(initial=0))};distinct={seen}")
                for n, v in zip(READ, values, strict=True):
                    rows[n].append(v)
            yield pa.RecordBatch.from_arrays([t[c].combine_chunks() for c in carry] + [pa.array(rows[n], k) for n, k in zip(READ, kinds, strict=True)], names=[*carry, *READ])

    return only(media, *dict.fromkeys([*carry, "media"])).mapInArrow(run, schema)
