"""Substring dedup by fixed-block anchors.

1. The index: every non-overlapping block of `block` words of every document, by hash.
2. The probe: every rolling window of `block` words that the index may hold; blocks that occur in two documents are anchors.
   A window of 2 * block words or more that occurs in two documents holds a whole block of the first, hence an anchor, at the same place in both.
3. Extension: windows of `size` words form runs by the first anchor in them.  A run that occurs alike in a smaller document is
   repeated as a whole.  Where an anchor's runs differ, the repeat ends, and its windows are compared one by one.
The words that repeated windows cover are the maximal exact repeats.  Blocks are found by 64-bit hashes; runs and windows
are equal if the BLAKE2 digests (128 bits) of their words, joined by a space, are.  Texts of any length are read in pieces.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import bitmap, in_bitmap, stash, text_slices
from .repeats import RUNS, Heads, batch, cut_out, keyed, pieces, removed_mask, settled

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _hashed(batches, size: int):
    """Of each piece of text: (doc, mark, base), (bytes, offsets, word starts, word ends), first words, and sums of word hashes."""
    for t in text_slices(batches):
        for doc, mark, base, data, off in pieces(t, size, words=True):
            start, end, h, first = K.words(data, off)
            yield (doc, mark, base), (data, off, start, end), first, K.sums(h)


def _index(size: int, block: int):
    def run(batches):
        for _, _, first, s in _hashed(batches, size):
            at = np.concatenate([np.arange(a, b - block + 1, block) for a, b in zip(first[:-1], first[1:], strict=True)] or [first[:0]]).astype(np.int64)
            yield batch(["h"], [np.unique(K.spans(s, at, at + block)).view(np.int64)])
    return run


def _probe(size: int, block: int, bits):
    def run(batches):
        for (docs, _, _), _, first, s in _hashed(batches, size):
            at = K.windows(first, block)
            h = K.spans(s, at, at + block)
            hit = in_bitmap(bits.value, h)
            at, h = at[hit], h[hit].view(np.int64)
            doc = docs[np.searchsorted(first, at, "right") - 1]
            o = np.lexsort((doc, h))
            h, doc = h[o], doc[o]
            new = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
            b = np.flatnonzero(new)
            yield batch(["h", "least", "most"], [h[b], doc[b].astype(np.int64), doc[np.append(b[1:], len(h)) - 1].astype(np.int64) if len(b) else np.zeros(0, np.int64)])
    return run


def _anchored(first: np.ndarray, s: np.ndarray, size: int, block: int, bits):
    """Runs of windows: (text, first anchor, first window, how many), by place."""
    at = K.windows(first, block)
    h = K.spans(s, at, at + block)
    hit = in_bitmap(bits, h)
    p, a = at[hit], h[hit]
    text = np.searchsorted(first, p, "right") - 1
    before = np.full(len(p), -1)
    if len(p) > 1:
        before[1:] = np.where(text[1:] == text[:-1], p[:-1], -1)
    lo = np.maximum(np.maximum(before + 1, p - (size - block)), first[text])
    hi = np.minimum(p, first[text + 1] - size)
    ok = lo <= hi
    return text[ok], a[ok], lo[ok], (hi - lo + 1)[ok]


def _runs(size: int, block: int, bits):
    def run(batches):
        for own, where, first, s in _hashed(batches, size):
            text, a, lo, n = _anchored(first, s, size, block, bits.value)
            if len(text):
                yield settled(*own, first, size, text, a, K.Joined(*where).digests(lo, lo + n - 1 + size), lo, n, False)
    return run


def _windows(size: int, block: int, bits, unlike):
    def run(batches):
        for own, where, first, s in _hashed(batches, size):
            text, a, lo, n = _anchored(first, s, size, block, bits.value)
            ok = in_bitmap(unlike.value, a)
            text, a, lo, n = text[ok], a[ok], lo[ok], n[ok]
            if len(text):
                row = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]
                yield settled(*own, first, size, text[row], a[row], K.Joined(*where).digests(at, at + size), at, np.ones(len(at), np.int64), False)
    return run


def _cut(batches):
    for t in text_slices(batches):
        rows = {"doc_id": t["doc_id"].to_pylist(), "n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
        for text, cuts in zip(t["text"].to_pylist(), t["cuts"].to_pylist(), strict=True):
            words = _WORD.findall(text)
            rows["n_words"].append(len(words))
            if cuts:
                gone = removed_mask(len(words), cuts).tolist()
                words = [w for w, g in zip(words, gone, strict=True) if not g]
            kept = " ".join(words)
            rows["n_removed"].append(rows["n_words"][-1] - len(words))
            rows["kept_sha256"].append(hashlib.sha256(kept.encode()).hexdigest())
            rows["kept"].append(kept)
        yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), pa.array(rows["n_words"], pa.int64()), pa.array(rows["n_removed"], pa.int64()), pa.array(rows["kept_sha256"], pa.string()), pa.array(rows["kept"], pa.string())], names=list(rows))


def repeated_words(docs: DataFrame, size: int = 50, block: int = 25) -> DataFrame:
    """(doc_id, t, lo, hi): word intervals of documents that windows cover which also start in a smaller document."""
    if size < 2 * block - 1:
        raise ValueError("a window must hold a whole block")
    spark = docs.sparkSession
    texts = keyed(docs).where("doc_id is not null")
    index = texts.mapInArrow(_index(size, block), "h bigint")
    bits = spark.sparkContext.broadcast(bitmap(index, "h"))
    probes = texts.mapInArrow(_probe(size, block, bits), "h bigint, least bigint, most bigint")
    shared = probes.groupBy("h").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least < most")
    anchors = spark.sparkContext.broadcast(bitmap(shared, "h"))
    runs = stash(texts.mapInArrow(_runs(size, block, anchors), RUNS), "word-runs")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("r", "q", "doc_id") for f in (F.min, F.max)]
    unlike = runs.where("kind = 0").groupBy("a").agg(*ends).where("(min_r <> max_r or min_q <> max_q) and min_doc_id < max_doc_id")
    edges = spark.sparkContext.broadcast(bitmap(unlike, "a"))
    single = stash(texts.mapInArrow(_windows(size, block, anchors, edges), RUNS), "word-windows")
    return Heads(runs, False, "word-heads").later(size).unionByName(Heads(single, False, "word-window-heads").later(size))


def remove_repeats(docs: DataFrame, size: int = 50, block: int = 25) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for every row of docs(doc_id, text, ...): `kept` is what is left, joined by one space.

    A word goes if a window over it also starts in a document with a smaller doc_id; windows are judged on the input.
    Null and empty texts have no words.  Rows with null doc_id are compared with nothing.  Rows with one doc_id are one
    document: they don't remove from each other.  Further columns are not read.
    """
    return cut_out(docs, repeated_words(docs, size, block), _cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
