"""Near-duplicate documents by bottom-k sketches of one hash function.

1. A document's set holds the 64-bit hashes of its distinct word shingles; documents with the same words in the same order (by a
   BLAKE2 digest of them) form a class.
2. The k least hashes of a class are its sketch.  Two adjacent values of a sketch make the key of an inverted list.
   If a union of sets keeps k values, each is shared with probability J; two neighbours are both shared somewhere with a
   probability of more than 1 - 1e-8 for J >= 0.8 and k = 32, and always for sets of at most k values.  (Lists of
   single values would join half the corpus by common phrases; lists of two neighbours hardly do.)
3. Within a list, the sketch of a pair's union, the k least values of both, estimates its similarity by the share of values that
   both sketches hold; a pair passes with an estimate of at least threshold - SLACK.
   Both steps together miss a link of J >= 0.8 at a threshold of 0.8 with a probability below 4e-9, one of J >= 0.85 at 0.85
   below 1.2e-9.  Long lists are cut into blocks and each pair of blocks is a cell of its own; no pair is written, only forests.
4. Components of the estimated links are verified on full sets of shingles, each by the BLAKE2 digest (128 bits) of its words: first
   every member with the smallest one of its component, then those that this leaves with all others, block by block.
   The components of the verified links are the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import binary_rows, bitmap, bounds, bytes_of, components, in_bitmap, only, stash, text_slices, whole_groups

SKETCH = 32
SLACK = 0.46
LIST_BLOCK = 1024
SET_BLOCK = 512
COLUMNS = 4096


def shingles(texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, and their offsets.

    A-Z are lower-cased.  With fewer words than `size`, the whole sequence is the one shingle; without words, none.
    """
    data, off = bytes_of(texts)
    _, _, h, first = K.words(data, off, lower=True)
    n = np.diff(first)
    at = K.windows(first, size)
    v = np.zeros(len(at), K.U)
    for i in range(size):
        v = K.mix(v * K.U(0x9E3779B97F4A7C15) + h[at + i])
    group = np.repeat(np.arange(len(n)), np.maximum(n - size + 1, 0))
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        few = []
        for i in short:
            x = np.full(1, n[i], K.U)
            for w in h[first[i]: first[i + 1]]:
                x = K.mix(x * K.U(0x9E3779B97F4A7C15) + w)
            few.append(x[0])
        group, v = np.append(group, short), np.append(v, np.array(few, K.U))
    g, v = K.distinct_by(group, v)
    return v, np.searchsorted(g, np.arange(len(n) + 1))


def _pack(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer((off * 8).astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def _sketches(size: int):
    def run(batches):
        for t in text_slices(batches, most=1 << 20):
            data, off = bytes_of(t["text"])
            start, end, _, first = K.words(data, off, hashes=False)
            f1, f2 = K.Joined(data, off, start, end, lower=True).digests(first[:-1], first[1:])
            v, off = shingles(t["text"], size)
            n = np.diff(off)
            take = np.minimum(n, SKETCH)
            pos = np.repeat(off[:-1] - (np.cumsum(take) - take), take) + np.arange(take.sum())
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks(), pa.array(n.astype(np.int64)), pa.array(f1), pa.array(f2), _pack(v[pos], np.append(0, np.cumsum(take)))],
                                             names=["doc_id", "n_shingles", "f1", "f2", "sketch"])
    return run


def _keys(batches):
    for b in batches:
        v, off = binary_rows(b["sketch"], np.uint64)
        n = np.diff(off)
        left = np.ones(len(v), bool)
        left[off[1:][n > 0] - 1] = False
        left = np.flatnonzero(left)
        row = np.repeat(np.arange(len(n)), n)
        alone = off[:-1][n == 1]
        key = np.append(K.mix(v[left] * K.U(31) + v[left + 1]) if len(left) else np.zeros(0, K.U), v[alone])
        at = np.append(row[left], row[alone])
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b["rep"].take(pa.array(at))], names=["key", "rep"])


def overlaps(ta, ra, na, tb, rb, nb) -> np.ndarray:
    """How many tokens each row of a shares with each row of b; (token, row) pairs are distinct."""
    out = np.zeros((na, nb), np.float32)
    common = np.intersect1d(ta, tb)
    ia, ib = np.searchsorted(common, ta), np.searchsorted(common, tb)
    if not len(common):
        return out
    ka = common[np.minimum(ia, len(common) - 1)] == ta
    kb = common[np.minimum(ib, len(common) - 1)] == tb
    ia, ra, ib, rb = ia[ka], ra[ka], ib[kb], rb[kb]
    for at in range(0, len(common), COLUMNS):
        a = np.zeros((na, min(COLUMNS, len(common) - at)), np.float32)
        b = np.zeros((nb, a.shape[1]), np.float32)
        sa, sb = (ia >= at) & (ia < at + COLUMNS), (ib >= at) & (ib < at + COLUMNS)
        a[ra[sa], ia[sa] - at] = 1
        b[rb[sb], ib[sb] - at] = 1
        out += a @ b.T
    return out


def forest(a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of a matrix over ids a (rows) and b (columns)."""
    ids, inv = np.unique(np.append(a, b), return_inverse=True)
    ra, rb = inv[: len(a)], inv[len(a):]
    label = np.arange(len(ids))
    i, j = np.nonzero(linked)
    x, y = ra[i], rb[j]
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            up = new[new]
            if (up == new).all():
                break
            new = up
        new = new[label]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def _pairs_of(start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.triu_indices(size, 1)
    return (start[:, None] + i).ravel(), (start[:, None] + j).ravel()


def padded(v: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sketches as rows of SKETCH values; a shorter one is filled with the greatest values, unlike any other row's."""
    n = len(off) - 1
    out = ~(np.arange(n, dtype=np.uint64)[:, None] * np.uint64(SKETCH) + np.arange(SKETCH, dtype=np.uint64))
    m = np.diff(off)
    out[np.repeat(np.arange(n), m), np.arange(len(v)) - np.repeat(off[:-1], m)] = v
    return out


def union_estimates(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The similarity of each pair of padded sketches by the sketch of its union; na, nb: how many values each sketch really has."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    again = both[:, 1:] == both[:, :-1]
    rank = 1 + np.cumsum(~again, axis=1)  # of the values in the union
    kept = np.minimum(SKETCH, na + nb - again.sum(1))
    return (again & (rank <= kept[:, None])).sum(1) / np.maximum(kept, 1)


def _block_links(pad_a, na, pad_b, nb, shared, least: float, one: bool):
    """Pairs (rows of a, rows of b) that connect all rows which chains of estimated links connect.

    shared: values common to the whole sketches, never less than those in the union's sketch.  A row is compared with those alone
    that it isn't connected with yet, so a block of alike documents takes few comparisons.
    """
    label = np.arange(len(na)) if one else np.arange(len(na) + len(nb))
    skip = 0 if one else len(na)
    xs, ys = [], []
    for i in range(len(na)):
        j = np.flatnonzero((shared[i] >= least * np.minimum(SKETCH, np.maximum(na[i], nb))) & (label[skip:] != label[i]))
        if len(j):
            j = j[union_estimates(np.repeat(pad_a[i: i + 1], len(j), 0), pad_b[j], na[i], nb[j]) >= least]
            _, at = np.unique(label[skip + j], return_index=True)
            xs.append(np.full(len(at), i))
            ys.append(j[at])
            label[np.isin(label, label[skip + j])] = label[i]
    return np.concatenate(xs or [np.zeros(0, np.int64)]), np.concatenate(ys or [np.zeros(0, np.int64)])


def _estimated(least: float):
    """Forests of the pairs in each list whose sketches overlap enough."""

    def run(batches):
        for t in whole_groups(batches, ["key", "bi", "bj"]):
            v, off = binary_rows(t["sketch"], np.uint64)
            rep, side, bi, bj = (t[c].to_numpy() for c in ("rep", "side", "bi", "bj"))
            g = bounds(t["key"].to_numpy(), bi, bj)
            m = np.diff(off)
            pad = padded(v, off)
            size = np.diff(g)
            one = bi[g[:-1]] == bj[g[:-1]]
            us, vs = [], []
            for s in np.unique(size[one & (size <= 48)]):
                if s < 2:
                    continue
                first, second = _pairs_of(g[:-1][one & (size == s)], int(s))
                for at in range(0, len(first), 50_000):
                    i, j = first[at: at + 50_000], second[at: at + 50_000]
                    hit = union_estimates(pad[i], pad[j], m[i], m[j]) >= least
                    us.append(rep[i[hit]])
                    vs.append(rep[j[hit]])
            row = np.repeat(np.arange(len(m)), m)
            for k in np.flatnonzero(~one | (size > 48)):
                lo, hi = g[k], g[k + 1]
                mine = [np.arange(lo, hi)] * 2 if one[k] else [lo + np.flatnonzero(side[lo:hi] == x) for x in (0, 1)]
                tok, r = v[off[lo]: off[hi]], row[off[lo]: off[hi]] - lo
                sides = []
                for rows in mine:
                    where = np.full(hi - lo, -1)
                    where[rows - lo] = np.arange(len(rows))
                    sides.append((tok[where[r] >= 0], where[r][where[r] >= 0], len(rows)))
                a, b = mine
                x, y = _block_links(pad[a], m[a], pad[b], m[b], overlaps(*sides[0], *sides[1]), least, bool(one[k]))
                us.append(rep[a[x]])
                vs.append(rep[b[y]])
            if us:
                u, w = np.concatenate(us), np.concatenate(vs)
                both = np.unique(np.stack([np.maximum(u, w), np.minimum(u, w)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])
    return run


def exact_shingles(texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as digests of their words (two numbers each), and their offsets."""
    data, off = bytes_of(texts)
    start, end, _, first = K.words(data, off, hashes=False)
    n = np.diff(first)
    at = K.windows(first, size)
    short = np.flatnonzero((n > 0) & (n < size))
    group = np.append(np.repeat(np.arange(len(n)), np.maximum(n - size + 1, 0)), short)
    x, y = K.Joined(data, off, start, end, lower=True).digests(np.append(at, first[short]), np.append(at + size, first[short + 1]))
    o = np.lexsort((y, x, group))
    group, x, y = group[o], x[o], y[o]
    keep = bounds(group, x, y)[:-1]
    return np.stack([x[keep], y[keep]], 1), np.searchsorted(group[keep], np.arange(len(n) + 1))


def _numbered(pairs: np.ndarray) -> np.ndarray:
    """A number for each row of two values, the same for equal rows."""
    o = np.lexsort((pairs[:, 1], pairs[:, 0]))
    g = bounds(pairs[o, 0], pairs[o, 1])
    out = np.empty(len(o), np.int64)
    out[o] = np.repeat(np.arange(len(g) - 1), np.diff(g))
    return out


def _verified(percent: int):
    """Forests of the exact links within each cell of a component: all pairs where bi = bj, else those of side 0 with side 1."""

    def run(batches):
        for t in whole_groups(batches, ["component_id", "bi", "bj"], rows=2_000):
            v, off = binary_rows(t["shingles"], np.int64)
            v, off = _numbered(v.reshape(-1, 2)), off // 2
            doc, side = t["doc_id"].to_numpy(), t["side"].to_numpy()
            bi, bj = t["bi"].to_numpy(), t["bj"].to_numpy()
            g = bounds(t["component_id"].to_numpy(), bi, bj)
            n = np.diff(off)
            us, vs = [], []
            for lo, hi in zip(g[:-1], g[1:], strict=True):
                if bi[lo] == bj[lo]:
                    rows_a = rows_b = np.arange(lo, hi)
                else:
                    rows_a, rows_b = lo + np.flatnonzero(side[lo:hi] == 0), lo + np.flatnonzero(side[lo:hi] == 1)
                pick = lambda rows: (np.concatenate([v[off[i]: off[i + 1]] for i in rows] or [v[:0]]), np.repeat(np.arange(len(rows)), n[rows]), len(rows))
                shared = overlaps(*pick(rows_a), *pick(rows_b)).astype(np.int64)
                union = n[rows_a][:, None] + n[rows_b][None, :] - shared
                x, y = forest(doc[rows_a], doc[rows_b], (100 * shared >= percent * union) & (shared > 0))
                us.append(x)
                vs.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us), pa.int64()), pa.array(np.concatenate(vs), pa.int64())], names=["a", "b"])
    return run


def _sets(size: int, bits):
    def run(batches):
        for t in text_slices(batches, most=1 << 20):
            t = t.filter(pa.array(in_bitmap(bits.value, t["_h"].to_numpy())))
            if t.num_rows:
                v, off = exact_shingles(t["text"], size)
                yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks(), _pack(v, off * 2)], names=["doc_id", "shingles"])
    return run


def cells(rows: DataFrame, key: str, member: str, block: int) -> DataFrame:
    """Every row of a group of `key` with a cell (bi, bj) and its side, for each pair of blocks of at most about `block` rows."""
    count = rows.groupBy(key).agg(F.count("*").alias("_m")).where("_m > 1")
    rows = rows.join(count, key).withColumn("_nb", F.ceil(F.col("_m") / block).cast("int"))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(member), F.col("_nb")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("_nb") - 1), lambda o: F.struct(
        F.least(F.col("_b"), o).alias("bi"), F.greatest(F.col("_b"), o).alias("bj"), (F.col("_b") > o).cast("int").alias("side")))
    return rows.withColumn("_c", F.explode(pair)).select(*[c for c in rows.columns if not c.startswith("_")], "_c.bi", "_c.bj", "_c.side")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text, ...).

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the smallest
    doc_id that links reach.  Null and empty texts and texts without words have no shingles and are linked with
    nothing.  Rows with null doc_id are linked with nothing, have a null component_id and are kept.  Rows with one
    doc_id are one document, linked by any of its texts.  Further columns are not read.
    """
    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text")
    every = stash(docs.mapInArrow(_sketches(size), "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, sketch binary"), "sketches")
    able = every.where("n_shingles > 0 and doc_id is not null")
    classes = able.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
    classes = stash(classes, "classes")
    keyed = classes.select("rep", "sketch").mapInArrow(_keys, "key bigint, rep bigint")
    least = percent / 100 - SLACK
    listed = cells(keyed, "key", "rep", LIST_BLOCK).join(classes.select("rep", "n_shingles", "sketch"), "rep")
    listed = listed.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    estimated = listed.mapInArrow(_estimated(least), "a bigint, b bigint")
    near = stash(components(estimated, "estimated"), "near")
    member = near.select(F.col("id").alias("doc_id"), "component_id")

    def verified(placed: DataFrame, name: str) -> DataFrame:
        """The links in cells (doc_id, component_id, bi, bj, side), which meet the full sets of their documents there."""
        bits = spark.sparkContext.broadcast(bitmap(placed.select(F.xxhash64("doc_id").alias("h")).distinct(), "h"))
        sets = docs.where("doc_id is not null").withColumn("_h", F.xxhash64("doc_id")).mapInArrow(_sets(size, bits), "doc_id bigint, shingles binary")
        met = placed.join(sets, "doc_id").repartition("component_id", "bi", "bj").sortWithinPartitions("component_id", "bi", "bj")
        return stash(met.mapInArrow(_verified(percent), "a bigint, b bigint"), name)

    # a component of one block is one cell; in a larger one every member meets the smallest, which goes to all blocks
    count = member.groupBy("component_id").agg(F.ceil(F.count("*") / SET_BLOCK).cast("int").alias("nb"))
    member = stash(member.join(count, "component_id"), "members")
    number = F.pmod(F.xxhash64("doc_id"), F.col("nb")).cast("int")
    least_one = F.col("doc_id") == F.col("component_id")
    mine = F.when((F.col("nb") > 1) & least_one, F.sequence(F.lit(0), F.col("nb") - 1)).otherwise(F.array(number))
    first = member.withColumn("bi", F.explode(mine)).withColumn("bj", F.when(F.col("nb") > 1, F.lit(-1)).otherwise(F.lit(0)))
    exact = verified(first.select("doc_id", "component_id", "bi", "bj", F.when(least_one, 0).otherwise(1).alias("side")), "exact")
    # those that don't link to the smallest meet all others of the component, so that no link is lost
    left = stash(member.where((F.col("nb") > 1) & ~least_one).join(exact.select(F.col("a").alias("doc_id")), "doc_id", "left_anti"), "unsettled")
    if left.head(1):
        rest = left.groupBy("component_id").agg(F.ceil(F.count("*") / SET_BLOCK).cast("int").alias("nr"))
        row = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("nr")).cast("int")
        some = left.join(rest, "component_id").withColumn("bi", -1 - row).withColumn("bj", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        every_one = member.join(rest, "component_id").withColumn("bj", number).withColumn("bi", F.explode(F.sequence(-F.col("nr"), F.lit(-1))))
        names = ["doc_id", "component_id", "bi", "bj"]
        both = some.select(*names, F.lit(0).alias("side")).unionByName(every_one.select(*names, F.lit(1).alias("side")))
        exact = exact.unionByName(verified(stash(both, "cells"), "exact-rest"))
    same = able.join(classes.drop("sketch"), ["n_shingles", "f1", "f2"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    linked = components(exact.unionByName(same), "links")
    out = every.select("doc_id", "n_shingles").join(linked.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
