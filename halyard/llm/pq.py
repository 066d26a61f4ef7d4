"""Near-duplicate vectors by product quantisation: coarse inverted lists with residual codes, exact cosine rerank.

Vectors are compared within one label only.  Copies of a vector are one entry with a count.  The index stores an entry in the list
of its nearest coarse centroid as the codes of its residual, a byte for each subspace, with the length of what
the codes miss; no vector is stored there.  A query probes every list that can hold a vector within reach: with threshold t, unit vectors that
link are at most r = sqrt(2 - 2t) apart, and a vector whose nearest centroid is c lies beyond the bisector between c and the
query's own centroid, whose distance is known.  In a list, a table of distances from the query's residual to all codewords
gives the distance to every entry by look-ups; entries farther than r and the length that their codes miss are out.  Only for
the survivors are the vectors fetched, and compared by cosine in double precision.  Both bounds are exact, so no link is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_rows, bounds, components, only, stash, whole_groups
from .minhash import forest

SUBSPACES = 8
CODEWORDS = 64
BLOCK = 1024  # queries of a cell
CODE_BLOCK = 8192  # entries of a cell
STEP = 2048  # entries that are looked up together
SAMPLE = 16_384
SLACK = 1e-6


def _entries(batches):
    """Unit vectors in double precision, a digest of the vector, and whether it can link at all."""
    for b in batches:
        col = b["embedding"].combine_chunks() if isinstance(b["embedding"], pa.ChunkedArray) else b["embedding"]
        n = len(col)
        dim = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.list_flatten(col)
        at = np.append(0, np.cumsum(dim))  # null rows have no values in the flat array
        whole = np.append(0, np.cumsum(flat.is_null().to_numpy(zero_copy_only=False)))
        value = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
        unit, digest, size = [None] * n, [None] * n, np.zeros(n, np.int32)
        for d in np.unique(dim[dim > 0]).tolist():
            rows = np.flatnonzero((dim == d) & (whole[at[1:]] == whole[at[:-1]]))
            x = value[at[rows][:, None] + np.arange(d)]
            norm = np.sqrt(np.where(np.isfinite(x), x * x, np.inf).sum(1))
            rows, x, norm = (v[np.isfinite(norm) & (norm > 0)] for v in (rows, x, norm))
            u = x / norm[:, None]
            size[rows] = d
            for i, r in enumerate(rows.tolist()):
                unit[r], digest[r] = u[i].tobytes(), hashlib.blake2b(x[i].tobytes(), digest_size=16).digest()
        yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"].cast(pa.int64()), pa.array(size), pa.array(digest, pa.binary()), pa.array(unit, pa.binary())],
                                         names=["vec_id", "label", "dim", "digest", "unit"])


def _means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        d = (c * c).sum(1)[None, :] - 2 * x @ c.T
        at = d.argmin(1)
        n = np.bincount(at, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, at, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return c


def train(entries: DataFrame, dim: int, lists: int | None = None, sample: int = SAMPLE, seed: int = 11) -> dict:
    """Centroids and codebooks of one dimension, fitted on at most `sample` entries (those with the least hash)."""
    mine = entries.where(F.col("dim") == dim)
    n = mine.count()
    h = F.pmod(F.xxhash64("digest"), F.lit(1 << 30))
    share = min(1.0, 1.5 * sample / max(1, n))
    got = mine.where(h < int(share * (1 << 30)) + 1).select("unit", h.alias("h"), "rep").orderBy("h", "rep").limit(sample).select("unit").toArrow()
    x = binary_rows(got["unit"], np.float64)[0].reshape(-1, dim)
    lists = lists or max(4, min(1024, int(np.sqrt(n))))
    coarse = _means(x, lists, 8, seed)
    at = ((coarse * coarse).sum(1)[None, :] - 2 * x @ coarse.T).argmin(1)
    res = x - coarse[at]
    parts = [p for p in np.array_split(np.arange(dim), SUBSPACES) if len(p)]
    return {"dim": dim, "coarse": coarse, "parts": parts, "books": [_means(res[:, p], CODEWORDS, 6, seed + 1 + i) for i, p in enumerate(parts)]}


def _near(c: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x from all rows of c."""
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T, 0)


INDEX = "label bigint, dim int, list int, side int, rep bigint, code binary, miss double"


def _placed(models, radius: float):
    """For each entry one row for its own list (side 1), with its codes, and one for every list it probes (side 0)."""

    def run(batches):
        apart: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                m, pick = models.value[dim], np.flatnonzero(dims == dim)
                c = m["coarse"]
                if dim not in apart:
                    apart[dim] = np.sqrt(_near(c, c))
                x = binary_rows(b["unit"].take(pa.array(pick)), np.float64)[0].reshape(-1, dim)
                d2 = _near(c, x)
                own = d2.argmin(1)
                near = d2 - d2[np.arange(len(x)), own][:, None] <= 2 * radius * apart[dim][own] + SLACK
                near[np.arange(len(x)), own] = True
                res, codes, miss = x - c[own], np.zeros((len(x), len(m["parts"])), np.uint8), np.zeros(len(x))
                for k, (p, book) in enumerate(zip(m["parts"], m["books"], strict=True)):
                    codes[:, k] = _near(book, res[:, p]).argmin(1)
                    miss += ((res[:, p] - book[codes[:, k]]) ** 2).sum(1)
                q, lists = np.nonzero(near)
                for side, row, li in ((0, q, lists), (1, np.arange(len(x)), own)):
                    for at in range(0, len(row), 20_000):
                        r = row[at: at + 20_000]
                        of = pa.array(pick[r])
                        yield pa.RecordBatch.from_arrays(
                            [b["label"].take(of), b["dim"].take(of), pa.array(li[at: at + 20_000].astype(np.int32)), pa.array(np.full(len(r), side, np.int32)), b["rep"].take(of),
                             pa.array([codes[i].tobytes() for i in r.tolist()] if side else [None] * len(r), pa.binary()), pa.array(miss[r] if side else np.zeros(len(r)))],
                            names=["label", "dim", "list", "side", "rep", "code", "miss"])
    return run


CELL = ["label", "dim", "list", "bq", "bh"]


def _looked_up(models, threshold: float):
    """Of each cell the queries and entries that are in reach of each other by codes: (cell..., side, rep)."""
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def run(batches):
        for t in whole_groups(batches, CELL, rows=8_000):
            key = [t[c].to_numpy() for c in CELL]
            rep, side, miss = t["rep"].to_numpy(), t["side"].to_numpy(), t["miss"].to_numpy()
            vec, v_off = binary_rows(t["unit"], np.float32)
            code, c_off = binary_rows(t["code"], np.uint8)
            g = bounds(*key)
            kept = []
            for lo, hi in zip(g[:-1], g[1:], strict=True):
                q, h = lo + np.flatnonzero(side[lo:hi] == 0), lo + np.flatnonzero(side[lo:hi] == 1)
                if not len(q) or not len(h):
                    continue
                dim = int(key[1][lo])
                m = models.value[dim]
                x = vec[v_off[lo]: v_off[hi]].reshape(-1, dim).astype(np.float64) - m["coarse"][key[2][lo]]
                codes = code[c_off[lo]: c_off[hi]].reshape(len(h), -1)
                tables = [_near(book, x[:, p]) for p, book in zip(m["parts"], m["books"], strict=True)]
                reach = (radius + np.sqrt(miss[h]) + SLACK) ** 2 + SLACK
                met = np.zeros(len(q), bool)
                for at in range(0, len(h), STEP):
                    part = slice(at, at + STEP)
                    far = np.zeros((len(q), len(h[part])))
                    for k, table in enumerate(tables):
                        far += table[:, codes[part, k]]
                    able = (far <= reach[part]) & (rep[q][:, None] != rep[h[part]][None, :])
                    met |= able.any(1)
                    kept.append(h[part][able.any(0)])
                kept.append(q[met])
            if kept:
                at = np.concatenate(kept)
                yield pa.RecordBatch.from_arrays([*(pa.array(k[at]) for k in key), pa.array(side[at]), pa.array(rep[at])], names=[*CELL, "side", "rep"])
    return run


def _reranked(threshold: float):
    """Of each cell's survivors: (0, query, its links' count) and (1, a, b) for a forest of the links."""

    def run(batches):
        for t in whole_groups(batches, CELL, rows=8_000):
            rep, many, side, dims = (t[c].to_numpy() for c in ("rep", "many", "side", "dim"))
            vec, off = binary_rows(t["unit"], np.float64)
            g = bounds(*(t[c].to_numpy() for c in CELL))
            kind, us, vs = [], [], []
            for lo, hi in zip(g[:-1], g[1:], strict=True):
                q, h = np.flatnonzero(side[lo:hi] == 0), np.flatnonzero(side[lo:hi] == 1)
                x = vec[off[lo]: off[hi]].reshape(-1, int(dims[lo]))
                n = np.zeros(len(q), np.int64)
                for at in range(0, len(h), STEP):
                    e = h[at: at + STEP]
                    linked = (x[q] @ x[e].T >= threshold) & (rep[lo + q][:, None] != rep[lo + e][None, :])
                    n += linked @ many[lo + e]
                    a, b = forest(rep[lo + q], rep[lo + e], linked)
                    kind.append(np.ones(len(a), np.int32))
                    us.append(a)
                    vs.append(b)
                kind.append(np.zeros(np.count_nonzero(n), np.int32))
                us.append(rep[lo + q][n > 0])
                vs.append(n[n > 0])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kind)), pa.array(np.concatenate(us).astype(np.int64)), pa.array(np.concatenate(vs).astype(np.int64))], names=["kind", "a", "b"])
    return run


def _single(batches):
    for b in batches:
        v, off = binary_rows(b["unit"], np.float64)
        raw = v.astype(np.float32).tobytes()
        yield pa.RecordBatch.from_arrays([b["label"], b["dim"], b["rep"], pa.array([raw[4 * x: 4 * y] for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())], names=["label", "dim", "rep", "unit"])


def near_vectors(vectors: DataFrame, threshold: float = 0.98, lists: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding, label, ...).

    Two rows link if their labels are equal and not null and their cosine is at least `threshold`.  Vectors that are null,
    empty, zero or hold null or non-finite components, and rows with null label, link with nothing, as do vectors of unlike length.
    Rows with null vec_id link with nothing, have a null component_id and are kept.  Rows that repeat a vec_id count as others.
    Further columns are not read.
    """
    spark = vectors.sparkSession
    every = stash(only(vectors, "vec_id", "label", "embedding").mapInArrow(_entries, "vec_id bigint, label bigint, dim int, digest binary, unit binary"), "vectors")
    able = every.where("unit is not null and label is not null and vec_id is not null")
    entries = stash(able.groupBy("label", "dim", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many"), F.first("unit").alias("unit")), "entries")
    dims = [r[0] for r in entries.select("dim").distinct().orderBy("dim").collect()]
    models = {d: train(entries, d, lists, sample) for d in dims}
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    shipped = spark.sparkContext.broadcast(models)  # at most 1024 centroids and 8 * 64 codewords of each length
    index = stash(entries.select("label", "dim", "rep", "unit").mapInArrow(_placed(shipped, radius), INDEX), "vector-index")
    key = ["label", "dim", "list"]
    size = index.groupBy(*key).agg(F.ceil(F.sum(1 - F.col("side")) / BLOCK).cast("int").alias("nq"), F.ceil(F.sum("side") / CODE_BLOCK).cast("int").alias("nh")).where("nq > 0 and nh > 0")
    rows = index.join(size, key)
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("nh")).otherwise(F.col("nq")) - 1))
    mine = F.pmod(F.xxhash64("rep"), F.when(F.col("side") == 0, F.col("nq")).otherwise(F.col("nh"))).cast("int")
    rows = rows.withColumn("_o", other).withColumn("_m", mine)
    rows = rows.select(*key, F.when(F.col("side") == 0, F.col("_m")).otherwise(F.col("_o")).alias("bq"),
                       F.when(F.col("side") == 0, F.col("_o")).otherwise(F.col("_m")).alias("bh"), "side", "rep", "code", "miss")
    # queries come with their vectors (in single precision, which the bounds allow for), entries with their codes alone
    halves = entries.select("label", "dim", "rep", "unit").mapInArrow(_single, "label bigint, dim int, rep bigint, unit binary")
    asked = rows.where("side = 0").join(halves, ["label", "dim", "rep"])
    cells = asked.unionByName(rows.where("side = 1").withColumn("unit", F.lit(None).cast("binary"))).repartition(*CELL).sortWithinPartitions(*CELL, "side")
    near = stash(cells.mapInArrow(_looked_up(shipped, threshold), "label bigint, dim int, list int, bq int, bh int, side int, rep bigint"), "survivors")
    met = near.join(entries.select("label", "dim", "rep", "many", "unit"), ["label", "dim", "rep"])
    found = stash(met.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(_reranked(threshold), "kind int, a bigint, b bigint"), "found")
    same = able.join(entries.drop("unit"), ["label", "dim", "digest"])
    linked = components(found.where("kind = 1").select("a", "b").unionByName(same.select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))), "vector-links")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("_far"))
    counted = same.join(counts, "rep", "left").select("vec_id", "label", "digest", (F.coalesce("_far", F.lit(0)) + F.col("many") - 1).alias("n_links"))
    idle = every.where("unit is null or label is null or vec_id is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"))
    out = counted.select("vec_id", "n_links").unionByName(idle)
    out = out.join(linked.withColumnRenamed("id", "vec_id"), "vec_id", "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
