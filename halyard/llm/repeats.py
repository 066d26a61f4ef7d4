"""What the two repeat removers share: runs of windows, removed intervals, and cutting them out of documents.

A window is a fixed number of items (words or bytes).  Windows that hold the same anchor at their first (or least) place are
consecutive: they form a run, known by its anchor and a digest of all its items (r, q).  Equal windows have equal anchors, so
an anchor whose runs all are alike needs no look at single windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import bitmap, bounds, bytes_of, in_bitmap, only, stash

PIECE = 1 << 20
RUNS = "kind int, a bigint, r bigint, q bigint, doc_id bigint, t bigint, lo bigint, n bigint"


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, t, text): t tells apart the texts of rows with one doc_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return only(docs, "doc_id", "text").select("doc_id", F.xxhash64(text).alias("t"), text.alias("text"))


def pieces(t, size: int, words: bool, most: int | None = None):
    """(doc, mark, base, data, off) of a slice: documents, marks, items before, bytes and offsets of its texts.

    A text much longer than `most` bytes comes in pieces, so that memory doesn't follow its length: each has the bytes of
    `size` - 1 further items of the next one, so that every window of `size` items starts in just one piece.
    """
    most = most or PIECE
    doc, mark = t["doc_id"].combine_chunks().to_numpy(), t["t"].combine_chunks().to_numpy()
    data, off = bytes_of(t["text"])
    if len(doc) != 1 or len(data) <= 2 * most:
        yield doc, mark, np.zeros(len(doc), np.int64), data, off
        return
    if words:
        begin = K.word_starts(data)
        cut = np.unique(np.searchsorted(begin, np.arange(0, len(data), most)))
        byte = np.append(begin, len(data))
        for a, b in zip(cut, np.append(cut[1:], len(begin)), strict=True):
            part = data[byte[a]: byte[min(b + size - 1, len(begin))]]
            yield doc, mark, np.array([a], np.int64), part, np.array([0, len(part)])
    else:
        for a in range(0, len(data), most):
            part = data[a: a + most + size - 1]
            yield doc, mark, np.array([a], np.int64), part, np.array([0, len(part)])


def merged(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals [lo, hi) of each group, joined where they overlap or touch."""
    if not len(lo):
        return group, lo, hi
    o = np.lexsort((lo, group))
    group, lo, hi = group[o], lo[o], hi[o]
    shift = np.int64(max(hi.max() - min(lo.min(), 0) + 2, 2))
    base = np.cumsum(np.append(0, group[1:] != group[:-1])).astype(np.int64) * shift
    reach = np.maximum.accumulate(hi + base)
    new = np.append(True, (lo + base)[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(lo)) - 1
    return group[first], lo[first], (reach - base)[last]


def removed_mask(n: int, cuts) -> np.ndarray:
    """Which of n items lie in one of the intervals."""
    edge = np.zeros(n + 1, np.int64)
    for c in cuts or ():
        edge[min(max(c["lo"], 0), n)] += 1
        edge[min(c["hi"], n)] -= 1
    return np.cumsum(edge)[:n] > 0


def cut_out(docs: DataFrame, intervals: DataFrame, cut, schema: str) -> DataFrame:
    """`cut` over every row of docs: batches of (doc_id, text, cuts), cuts null where nothing is removed.

    Texts that a filter of fixed size knows to be left alone are cut where they are read; only the others are shuffled
    to meet their intervals (doc_id, t, lo, hi), even if these could be broadcast: both functions would then be in one stage.
    """
    cuts = stash(intervals.groupBy("doc_id", "t").agg(F.collect_list(F.struct("lo", "hi")).alias("cuts")), "cuts")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(cuts.select(F.xxhash64("doc_id", "t").alias("h")), "h"))
    texts = keyed(docs).withColumn("h", F.xxhash64("doc_id", "t"))
    none = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def outside(batches):
        for b in batches:
            b = b.filter(pa.array(~in_bitmap(bits.value, b["h"].to_numpy())))
            yield from cut([pa.RecordBatch.from_arrays([b["doc_id"], b["text"], pa.nulls(b.num_rows, none)], names=["doc_id", "text", "cuts"])] if b.num_rows else [])

    def inside(batches):
        for b in batches:
            yield b.filter(pa.array(in_bitmap(bits.value, b["h"].to_numpy()))).select(["doc_id", "t", "text"])

    met = texts.mapInArrow(inside, "doc_id bigint, t bigint, text string").join(cuts.hint("merge"), ["doc_id", "t"], "left").select("doc_id", "text", "cuts")
    return texts.mapInArrow(outside, schema).unionByName(met.mapInArrow(cut, schema))


def settled(doc, mark, base, first: np.ndarray, size: int, text, a, same, lo, n, by_place: bool) -> pa.RecordBatch:
    """Rows of the runs of a slice (kind 0), and of the intervals of those that an earlier one in the slice is like (kind 1).

    doc, mark and base: of each text of the slice its document, its mark and how many items of the document stand before it;
    same: the two columns of the runs' digests.  Earlier is a smaller document or, `by_place`, a smaller place in the same one.
    """
    r, q = same
    d, place = doc[text], lo - first[text] + base[text]
    o = np.lexsort((place, d, q, r, a))
    g = bounds(a[o], r[o], q[o])
    head = np.repeat(o[g[:-1]], np.diff(g))
    later = np.zeros(len(o), bool)
    later[o] = (d[o] > d[head]) | ((d[o] == d[head]) & (place[o] > place[head]) if by_place else False)
    i, j = o[~later[o]], np.flatnonzero(later)
    k, x, y = merged(text[j], place[j], place[j] + n[j] - 1 + size)
    # like runs of one text share their fate, so those that overlap are one row, however often a text repeats itself
    end = place[i] + n[i] - 1 + size
    new = np.append(True, (text[i][1:] != text[i][:-1]) | (a[i][1:] != a[i][:-1]) | (r[i][1:] != r[i][:-1]) | (q[i][1:] != q[i][:-1]) | (place[i][1:] > end[:-1]))[: len(i)]
    b = np.flatnonzero(new)
    i, n_open = i[b], end[np.append(b[1:], len(end))[: len(b)] - 1] - place[i[b]] - size + 1
    where = np.append(text[i], k)
    own = K.mix(doc[k].view(np.uint64) + np.uint64(1))  # settled rows go anywhere
    return batch(["kind", "a", "r", "q", "doc_id", "t", "lo", "n"], [
        np.append(np.zeros(len(i), np.int32), np.ones(len(k), np.int32)), np.append(a[i], own).view(np.int64), np.append(r[i], x), np.append(q[i], y),
        doc[where], mark[where], np.append(place[i], x).astype(np.int64), np.append(n_open, y - x).astype(np.int64)])


LIKE = ["a", "r", "q"]


def _open(runs: DataFrame, by_place: bool) -> DataFrame:
    """The open runs with `here`, a number that orders them by document and, `by_place`, place; numbers can be hash-aggregated."""
    here = F.expr("cast(doc_id as decimal(19,0)) * 1099511627776BD + cast(lo as decimal(13,0))") if by_place else F.col("doc_id")
    return runs.where("kind = 0").withColumn("here", here)


def _picked(bits, inside: bool):
    def run(batches):
        for b in batches:
            b = b.filter(pa.array(in_bitmap(bits.value, b["r"].to_numpy()) == inside))
            if b.num_rows:
                yield b
    return run


class Heads:
    """The runs that occur more than once, each of their rows beside the first of them.

    The first is a minimum that every task combines before the shuffle, so that a run which all documents share meets in no
    one task; it is written before it is joined, as the exchange of an aggregate could not be split.  Runs that occur once
    are told apart by a filter and not shuffled to it.
    """

    def __init__(self, runs: DataFrame, by_place: bool, name: str):
        spark = runs.sparkSession
        both = _open(runs, by_place).groupBy(*LIKE).agg(F.min("here").alias("head"), F.max("here").alias("tail"))
        least = stash(both.where("head < tail").drop("tail"), name)
        self.runs, self.bits = runs, spark.sparkContext.broadcast(bitmap(least, "r"))
        several = runs.where("kind = 0").mapInArrow(_picked(self.bits, True), runs.schema)
        self.several = stash(_open(several, by_place).join(least, LIKE, "left"), f"{name}-rows")

    def later(self, size: int) -> DataFrame:
        """Intervals of the runs that are like an earlier one, and those that are settled already."""
        new = self.several.where("here > head").select("doc_id", "t", "lo", (F.col("lo") + F.col("n") + size - 1).alias("hi"))
        return new.unionByName(self.runs.where("kind = 1").select("doc_id", "t", "lo", (F.col("lo") + F.col("n")).alias("hi")))

    def first(self, run, schema: str) -> DataFrame:
        """`run` over batches of (a, r, doc_id, lo) of the first of the runs that are alike.

        Rows are picked by the same Python workers: a second function above the first one in a stage would double the workers of every
        executor, which live on after their tasks.
        """
        names, picked = ["a", "r", "doc_id", "lo"], _picked(self.bits, False)
        alone = self.runs.where("kind = 0").select(*names).mapInArrow(lambda batches: run(picked(batches)), schema)
        return alone.unionByName(self.several.where("head is null or here = head").select(*names).mapInArrow(run, schema))


def batch(names: list[str], columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
