"""Substring dedup by suffix arrays of shards, built by induced sorting.

1. Every window of `size` bytes has one anchor, the place of its least k-gram hash, so equal windows have equal anchors at the
   same place.  Windows with the same anchor make a run.  Anchors that occur once in the corpus repeat nothing.
2. Runs that are alike are one string with its first place; every later one goes as a whole.
3. Anchors with several unlike strings send them to a shard, all strings of an anchor to the same one.  Each shard concatenates its
   strings and sorts the suffixes: they are classified, their leftmost-smaller substrings sorted and named, the names
   sorted recursively, and the rest induced, bucket by bucket.  The permuted common prefixes (up to `size`) then cut
   the array into classes of equal windows, of which all but the first are removed.
4. An anchor with more than MOST_STRINGS unlike strings (a common line in ever other surroundings) is split: its windows are
   strings by themselves, dealt by their content and not by the anchor, combined before they are shuffled.
Anchors are found by 64-bit hashes; runs and single windows are equal if the BLAKE2 digests (128 bits) of their bytes are,
strings in shards are compared by their bytes.  Texts of any length are read in pieces.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import binary_rows, bitmap, bounds, in_bitmap, stash, text_slices, whole_groups
from .repeats import RUNS, Heads, batch, cut_out, keyed, merged, pieces, removed_mask, settled

GRAM = 32
PLACE_BITS = 24  # of a place within a slice; the same for all slices, as equal windows must have equal anchors everywhere
MOST_STRINGS = 256

# --- suffix arrays -------------------------------------------------------------------------------------------------


def classify(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (the empty suffix is the least)."""
    n = len(s)
    less = np.zeros(n, bool)
    if n < 2:
        return less
    step = np.sign(np.diff(s.astype(np.int64)))
    # equal neighbours have the type of the next unequal pair; the last suffix is larger than the empty one
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    found = nearest < n - 1
    less[:-1][found] = step[nearest[found]] > 0
    return less


def _deal(pending: list[list[np.ndarray]], s: np.ndarray, at: np.ndarray, skip: int) -> np.ndarray:
    """Append places to the buckets of their characters, in order; those of bucket `skip` are returned."""
    if not len(at):
        return at
    c = s[at]
    o = np.argsort(c, kind="stable")
    at, c = at[o], c[o]
    cut = np.append(np.flatnonzero(np.append(True, c[1:] != c[:-1])), len(c))
    same = at[:0]
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if c[a] == skip:
            same = at[a:b]
        else:
            pending[c[a]].append(at[a:b])
    return same


def induce(s: np.ndarray, less: np.ndarray, smaller: np.ndarray, alphabet: int) -> np.ndarray:
    """The order of all suffixes, induced from that of the leftmost-smaller ones, in time linear in their number."""
    n = len(s)
    c = s[smaller]
    o = np.argsort(c, kind="stable")
    seeds = np.split(smaller[o], np.searchsorted(c[o], np.arange(1, alphabet)))
    larger: list[list[np.ndarray]] = [[] for _ in range(alphabet)]
    larger[s[n - 1]].append(np.array([n - 1]))
    done_larger: list[np.ndarray] = []
    for b in range(alphabet):
        mine = []
        new = np.concatenate(larger[b]) if larger[b] else smaller[:0]
        while len(new):
            mine.append(new)
            before = new[new > 0] - 1
            new = _deal(larger, s, before[~less[before]], b)
        done_larger.append(np.concatenate(mine) if mine else smaller[:0])
        before = seeds[b][seeds[b] > 0] - 1
        _deal(larger, s, before[~less[before]], -1)
    least: list[list[np.ndarray]] = [[] for _ in range(alphabet)]
    out: list[np.ndarray] = []
    for b in range(alphabet - 1, -1, -1):
        mine = []
        new = np.concatenate(least[b]) if least[b] else smaller[:0]
        while len(new):
            mine.append(new)
            before = new[new > 0] - 1
            new = _deal(least, s, before[less[before]], b)
        down = done_larger[b][::-1]
        out += [*mine, down]
        before = down[down > 0] - 1
        _deal(least, s, before[less[before]], -1)
    return np.concatenate(out)[::-1]


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string over many names, by doubling; only ties are sorted again."""
    n = len(names)
    rank, k = names.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        if new[order[-1]] == n - 1 or k >= n:
            return order
        rank, k = new, 2 * k


def suffix_array(s: np.ndarray, alphabet: int) -> np.ndarray:
    """The order of all suffixes of s, whose values are below `alphabet`."""
    n = len(s)
    if n <= 2:
        return np.array([0] if n == 1 else [] if n == 0 else [1, 0] if s[1] <= s[0] else [0, 1], np.int64)
    less = classify(s)
    first = np.flatnonzero(less[1:] & ~less[:-1]) + 1
    if not len(first):
        return induce(s, less, first, alphabet)
    order = induce(s, less, first, alphabet)
    is_first = np.zeros(n, bool)
    is_first[first] = True
    order = order[is_first[order]]
    # names: equal leftmost-smaller substrings (each to the start of the next one) get equal names
    end = np.minimum(np.append(first[1:], n - 1) + 1, n)
    stop = np.zeros(n, np.int64)
    stop[first] = end
    last = stop[order] == n
    long = stop[order] - order
    unlike = np.append(True, (long[1:] != long[:-1]) | last[1:] | last[:-1])
    pair, k = np.flatnonzero(~unlike), 0
    while len(pair):  # compared value by value with the one before in the order, while alike
        same = s[order[pair] + k] == s[order[pair - 1] + k]
        unlike[pair[~same]] = True
        k += 1
        pair = pair[same]
        pair = pair[long[pair] > k]
    name = np.zeros(n, np.int64)
    name[order] = np.cumsum(unlike) - 1
    names = name[first]
    if unlike.all():
        sorted_first = order
    else:
        count = int(names.max()) + 1
        sub = suffix_array(names, count) if count <= 512 else _by_doubling(names)
        sorted_first = first[sub]
    return induce(s, less, sorted_first, alphabet)


def common_prefixes(s: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Permuted: for each place, how many values (up to `most`) its suffix shares with the one before it in the order."""
    n = len(s)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    wide = np.zeros(n + most + 8, s.dtype)
    wide[:n] = s
    packed = np.zeros(n + most, np.uint64)  # four values each
    for i in range(4):
        packed |= wide[i: i + n + most].astype(np.uint64) << np.uint64(16 * i)
    at = np.flatnonzero(before >= 0)
    limit = np.minimum(n - at, n - before[at])
    for k in range(0, most, 4):
        same = packed[at + k] == packed[before[at] + k]
        part = at[~same]
        if len(part):
            for i in range(4):
                go = (wide[part + k + i] == wide[before[part] + k + i])
                out[part[go]] += 1
                part = part[go]
        at = at[same]
        out[at] += 4
        if not len(at):
            break
    del limit
    return np.minimum(out, np.minimum(most, n - np.maximum(np.arange(n), before)))


# --- anchors and runs ----------------------------------------------------------------------------------------------


def _runs_of(data: np.ndarray, off: np.ndarray, size: int, gram: int):
    """(text, anchor hash, first window, how many) of the runs of texts laid end to end, of less than 2**PLACE_BITS bytes."""
    n = len(data)
    if n < size:
        e = np.zeros(0, np.int64)
        return e, e.astype(np.uint64), e, e
    if n >> PLACE_BITS:
        raise ValueError("a slice is too long for its places")
    h = K.rolling(K.sums(K.byte_codes(data)), gram)
    bits = np.uint64(PLACE_BITS)
    low = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)  # the hash, then the place: of equal ones the leftmost is the least
    width, span = size - gram + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: n - size + 1], low[width - span: width - span + n - size + 1])
    at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    inside = np.zeros(len(at) + 1, np.int8)  # windows within one text
    m = np.maximum(np.diff(off) - size + 1, 0)
    np.add.at(inside, off[:-1][m > 0], 1)
    np.add.at(inside, (off[:-1] + m)[m > 0], -1)
    within = np.cumsum(inside[:-1], dtype=np.int8) > 0
    new = within.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~within[:-1]
    new[off[:-1][m > 0]] = True
    lo = np.flatnonzero(new)
    text = np.searchsorted(off, lo, "right") - 1
    last = off[text] + m[text]
    many = np.minimum(np.append(lo[1:], n), last) - lo
    return text, h[at[lo]], lo, many


def _slices(batches, size: int):
    """Of each piece of text: (doc, mark, base), bytes, offsets."""
    for t in text_slices(batches, most=1 << 19):
        for doc, mark, base, data, off in pieces(t, size, words=False):
            yield (doc, mark, base), data, off


def _anchors(size: int, gram: int):
    def run(batches):
        for _, data, off in _slices(batches, size):
            _, a, _, _ = _runs_of(data, off, size, gram)
            v, c = np.unique(a, return_counts=True)
            yield batch(["a", "c"], [v.view(np.int64), np.minimum(c, 2).astype(np.int32)])
    return run


def _runs(size: int, gram: int, bits):
    def run(batches):
        for own, data, off in _slices(batches, size):
            text, a, lo, n = _runs_of(data, off, size, gram)
            ok = in_bitmap(bits.value, a)
            text, a, lo, n = text[ok], a[ok], lo[ok], n[ok]
            yield settled(*own, off, size, text, a, K.digests(data.tobytes(), lo, lo + n - 1 + size), lo, n, True)
    return run


def _name(a: np.ndarray, r: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """A hash of one run at one place."""
    h = K.mix(a.view(np.uint64) ^ K.mix(r.view(np.uint64)))
    return K.mix(K.mix(h + doc.view(np.uint64)) + lo.astype(np.uint64))


def _names(unlike):
    """Names of the runs whose anchor has unlike ones."""

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(in_bitmap(unlike.value, b["a"].to_numpy())))
            if b.num_rows:
                yield batch(["h"], [_name(*(b[c].to_numpy() for c in ("a", "r", "doc_id", "lo"))).view(np.int64)])
    return run


def _strings(size: int, gram: int, unlike, hot, firsts):
    """The first of like runs as strings, of anchors with unlike ones that are not hot."""

    def run(batches):
        for (docs, marks, base), data, off in _slices(batches, size):
            text, a, lo, n = _runs_of(data, off, size, gram)
            ok = in_bitmap(unlike.value, a) & ~in_bitmap(hot.value, a)
            text, a, lo, n = text[ok], a[ok], lo[ok], n[ok]
            doc, place, raw = docs[text], lo - off[text] + base[text], data.tobytes()
            ok = in_bitmap(firsts.value, _name(a, K.digests(raw, lo, lo + n - 1 + size)[0], doc, place))
            cut = [raw[x: y] for x, y in zip(lo[ok].tolist(), (lo[ok] + n[ok] - 1 + size).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a[ok].view(np.int64)), pa.array(doc[ok]), pa.array(marks[text[ok]]), pa.array(place[ok].astype(np.int64)), pa.array(n[ok].astype(np.int64)), pa.array(cut, pa.binary())],
                                             names=["a", "doc_id", "t", "lo", "n", "s"])
    return run


def _windows(size: int, gram: int, hot):
    """The windows of hot anchors, each by itself."""

    def run(batches):
        for own, data, off in _slices(batches, size):
            text, a, lo, n = _runs_of(data, off, size, gram)
            ok = in_bitmap(hot.value, a)
            text, a, lo, n = text[ok], a[ok], lo[ok], n[ok]
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]
            yield settled(*own, off, size, text[row], a[row], K.digests(data.tobytes(), at, at + size), at, np.ones(len(at), np.int64), True)
    return run


def _shards(size: int, most: int = 1 << 20):
    """Of whole groups of strings: the intervals of windows that an equal one precedes by document and place."""

    def solve(t):
        data, off = binary_rows(t["s"], np.uint8)
        doc, mark, lo, n = (t[c].to_numpy() for c in ("doc_id", "t", "lo", "n"))
        m = np.diff(off)
        s = np.zeros(len(data) + len(m), np.uint16)  # a 0 after each string
        s[np.arange(len(data)) + np.repeat(np.arange(len(m)), m)] = data.astype(np.uint16) + 1
        begin = off[:-1] + np.arange(len(m))
        order = suffix_array(s, 257)
        equal = common_prefixes(s, order, size)[order] >= size
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        of = np.full(len(s), -1)
        of[begin[row] + place] = np.arange(len(row))
        group = np.cumsum(~equal)
        w = of[order]
        group, w = group[w >= 0], w[w >= 0]
        # by document and place; versions of a document that hold a window at one place share its rank
        rank = np.empty(len(row), np.int64)
        by = np.lexsort((lo[row] + place, doc[row]))
        g = bounds(doc[row][by], (lo[row] + place)[by])
        rank[by] = np.repeat(np.arange(len(g) - 1), np.diff(g))
        o = np.lexsort((rank[w], group))
        group, w = group[o], w[o]
        g = bounds(group)
        w = np.sort(w[rank[w] > np.repeat(rank[w[g[:-1]]], np.diff(g))])
        g, x, y = merged(row[w], lo[row[w]] + place[w], lo[row[w]] + place[w] + size)
        return batch(["doc_id", "t", "lo", "hi"], [doc[g], mark[g], x.astype(np.int64), y.astype(np.int64)])

    def run(batches):
        for t in whole_groups(batches, ["a"], rows=2_000):
            g = bounds(t["a"].to_numpy())
            m = np.cumsum(pc.binary_length(t["s"].combine_chunks()).to_numpy())
            at = 0
            for k in range(1, len(g)):
                if k == len(g) - 1 or m[g[k + 1] - 1] - (m[at - 1] if at else 0) > most:
                    yield solve(t.slice(at, g[k] - at).combine_chunks())
                    at = int(g[k])
    return run


def repeated_bytes(docs: DataFrame, size: int = 100, gram: int = GRAM) -> DataFrame:
    """(doc_id, t, lo, hi): byte intervals that windows cover which also start earlier."""
    spark = docs.sparkSession
    texts = keyed(docs).where("doc_id is not null")
    often = texts.mapInArrow(_anchors(size, gram), "a bigint, c int").groupBy("a").agg(F.sum("c").alias("c")).where("c > 1")
    bits = spark.sparkContext.broadcast(bitmap(often, "a"))
    runs = stash(texts.mapInArrow(_runs(size, gram, bits), RUNS), "byte-runs")
    kinds = runs.where("kind = 0").select("a", "r", "q").distinct().groupBy("a").agg(F.count("*").alias("m")).where("m > 1")
    kinds = stash(kinds, "byte-anchors")
    unlike, hot = (spark.sparkContext.broadcast(bitmap(x, "a")) for x in (kinds, kinds.where(F.col("m") > MOST_STRINGS)))
    heads = Heads(runs, True, "byte-heads")
    firsts = spark.sparkContext.broadcast(bitmap(heads.first(_names(unlike), "h bigint"), "h"))
    strings = texts.mapInArrow(_strings(size, gram, unlike, hot, firsts), "a bigint, doc_id bigint, t bigint, lo bigint, n bigint, s binary")
    shards = strings.repartition("a").sortWithinPartitions("a").mapInArrow(_shards(size), "doc_id bigint, t bigint, lo bigint, hi bigint")
    single = stash(texts.mapInArrow(_windows(size, gram, hot), RUNS), "byte-windows")
    split = Heads(single, True, "byte-window-heads").later(size)
    return heads.later(size).unionByName(shards).unionByName(split)


def _cut(batches):
    for t in text_slices(batches):
        rows = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for text, cuts in zip(t["text"].to_pylist(), t["cuts"].to_pylist(), strict=True):
            raw = text.encode()
            gone, spans, kept = 0, 0, raw
            if cuts:
                a = removed_mask(len(raw), cuts)
                gone, spans = int(a.sum()), int(np.count_nonzero(np.diff(np.append(False, a).astype(np.int8)) == 1))
                kept = np.frombuffer(raw, np.uint8)[~a].tobytes()
            for k, v in zip(rows, (len(raw), gone, spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                rows[k].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks()] + [pa.array(rows[k], x) for k, x in zip(rows, kinds, strict=True)], names=["doc_id", *rows])


def remove_repeats(docs: DataFrame, size: int = 100, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of docs(doc_id, text, ...); `kept` holds the bytes left.

    A byte goes if a window of `size` bytes over it also starts earlier: in a smaller document or at a smaller place of
    the same one; windows are judged on the input and never cross documents.  Null text is empty.  Rows with null
    doc_id are compared with nothing.  Rows with one doc_id are versions of one document: of equal windows those at the smallest
    place stay, in each version.  Further columns are not read.
    """
    return cut_out(docs, repeated_bytes(docs, size, gram), _cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
