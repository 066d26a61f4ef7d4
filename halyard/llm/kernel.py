"""Array kernels over the bytes of many texts at once: word hashes, rolling hashes, distinct values, digests.

The hashes only find what may be equal.  Whatever is removed or linked has been compared by `digests` of its bytes: 128 bits of
BLAKE2, for which no two unlike inputs with one digest are known.  Sums of powers (`sums`, `spans`, `rolling`) are weaker:
modulo 2**64 unlike runs with one hash can be made for any base, and then cost time, not truth.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply and xor-shift rounds)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def _odd_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base))
    if n:
        out[0] = U(1)
        np.multiply.accumulate(out, out=out)
    return out


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_CODES = {s: mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F + 2 * s)) for s in (0, 1)}
_CACHE: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_CACHE.get("p", ())) < max(n, 1):
        n2 = max(n, 1 << 16)
        _CACHE["p"], _CACHE["i"] = _odd_powers(BASE, n2), _odd_powers(INVERSE, n2)
    return _CACHE["p"][:n], _CACHE["i"][:n]


def sums(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of codes[j] * BASE**j modulo 2**64, with a leading 0."""
    p, _ = _powers(len(codes))
    out = np.zeros(len(codes) + 1, U)
    np.cumsum(codes * p, out=out[1:])
    return out


def spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of codes[start:end], equal for equal runs wherever they stand."""
    _, inv = _powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(U) * U(0x8EBC6AF09C88C6E3))


def rolling(prefix: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` codes, from their prefix sums; not to be compared with those of `spans`."""
    _, inv = _powers(len(prefix))
    x = (prefix[size:] - prefix[:-size]) * inv[: len(prefix) - size]
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    return x


def byte_codes(data: np.ndarray, seed: int = 0) -> np.ndarray:
    return _CODES[seed][data]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LONG = 512


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]: eight bytes at a time through the finaliser, of words beyond LONG bytes a BLAKE2 digest."""
    n = end - start
    h = mix(n.astype(U) * U(0x8EBC6AF09C88C6E3) + U(1))
    wide = np.zeros(len(data) + 8, np.uint8)
    wide[: len(data)] = data
    eight = np.lib.stride_tricks.sliding_window_view(wide, 8)
    rows, at = np.flatnonzero(n <= LONG), 0
    while len(rows):
        x = np.ascontiguousarray(eight[start[rows] + at]).view("<u8").ravel()
        left = n[rows] - at
        short = np.flatnonzero(left < 8)
        x[short] &= (U(1) << (left[short].astype(U) * U(8))) - U(1)
        h[rows] = mix(h[rows] * U(0x9E3779B97F4A7C15) + x)
        rows, at = rows[left > 8], at + 8
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i]: end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def word_starts(data: np.ndarray) -> np.ndarray:
    """Where the words of one text start."""
    begins = ~_SPACE[data]
    begins[1:] &= _SPACE[data[:-1]]
    return np.flatnonzero(begins)


def words(data: np.ndarray, off: np.ndarray, lower: bool = False, hashes: bool = True):
    """Words `[^\\x20\\x09-\\x0D]+` of texts laid end to end.

    Returns (start, end, hash, first): byte spans, 64-bit hashes, and for each text the index of its
    first word, with the count of all words appended.  No word crosses a text's end.
    """
    n = len(data)
    inside = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    begins = inside.copy()
    if n:
        begins[1:] &= ~inside[:-1] | cut[1:n]
    ends = inside.copy()
    if n:
        ends[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, off)
    h = word_hashes(_LOWER[data] if lower else data, start, end) if hashes else None
    return start, end, h, first


def digests(raw: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit digests of raw[lo:hi], as two columns."""
    blake = hashlib.blake2b
    out = np.frombuffer(b"".join([blake(raw[a:b], digest_size=16).digest() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]), "<i8")
    return out[0::2], out[1::2]


class Joined:
    """The words of texts laid end to end, joined by one space within each text, to take digests of runs of words."""

    def __init__(self, data: np.ndarray, off: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False):
        space = _SPACE[data]
        keep = ~space
        if len(data):
            keep[1:] |= ~space[:-1]  # the first space after a word
            head = off[:-1][off[:-1] < len(data)]
            keep[head] = ~space[head]
        self.raw = np.where(space, np.uint8(0x20), _LOWER[data] if lower else data)[keep].tobytes()
        before = np.cumsum(keep, dtype=np.int64)
        self.start, self.end = before[start] - 1, before[end - 1]

    def digests(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the words lo to hi - 1, for each pair of bounds; empty runs hash as nothing."""
        some = hi > lo
        a, b = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        a[some], b[some] = self.start[lo[some]], self.end[hi[some] - 1]
        return digests(self.raw, a, b)


def segment_of(first: np.ndarray) -> np.ndarray:
    """For items dealt to texts by `first`, the text of each."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(first: np.ndarray, size: int) -> np.ndarray:
    """Starts of all runs of `size` items that stay within their text."""
    n = np.diff(first)
    m = np.maximum(n - size + 1, 0)
    total = int(m.sum())
    out = np.arange(total) - np.repeat(np.cumsum(m) - m, m)
    return out + np.repeat(first[:-1], m)


def distinct_by(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (group, value), sorted by group and value."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    return g[keep], v[keep]
