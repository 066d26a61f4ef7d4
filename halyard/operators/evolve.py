"""Nested index states: inserts and lazy deletions as prefixes of fixed orders, and how far a state has moved.

A state is the base with the first so many of the insertion pool, or without the first so many of a deletion order.  Deleted vectors
are still scanned, so they stay in the index and leave only the truth.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import squared_distance
from . import ivf, knn


@dataclass(frozen=True)
class State:
    """A trajectory (none, id, ood or del) and its size in percent of the base."""

    kind: str = "S0"
    percent: int = 0

    @property
    def name(self) -> str:
        return "S0" if self.kind == "S0" else f"{self.kind}_{self.percent}"


def parse(name: str) -> State:
    return State() if name == "S0" else State(name.split("_")[0], int(name.split("_")[1]))


def hash_order(vectors: DataFrame, salt: str) -> DataFrame:
    """(vec_id, pos): a seeded order by hash, ties by id; the rank needs one narrow row for each vector."""
    key = F.md5(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")))
    return vectors.select("vec_id", (F.row_number().over(Window.orderBy(key, "vec_id"))).cast("bigint").alias("pos"))


def regional_order(pool: DataFrame, counts: list[int], salt: str = "id", anchor_salt: str = "anchor") -> DataFrame:
    """(vec_id, pos): nested balls around a seeded anchor; within each increment the vectors keep their order of `hash_order`."""
    anchor = pool.orderBy(F.md5(F.concat(F.lit(f"{anchor_salt}:"), F.col("vec_id").cast("string"))), "vec_id").limit(1).select(F.col("embedding").alias("_a"))
    near = pool.crossJoin(F.broadcast(anchor)).select("vec_id", squared_distance(F.col("embedding"), F.col("_a")).alias("d"))
    near = near.withColumn("near", F.row_number().over(Window.orderBy("d", "vec_id")))
    ring = F.lit(len(counts))
    for i, c in reversed(list(enumerate(counts))):
        ring = F.when(F.col("near") <= c, i).otherwise(ring)
    own = hash_order(pool, salt).withColumnRenamed("pos", "own")
    return near.join(own, "vec_id").where(F.col("near") <= counts[-1]).select("vec_id", F.row_number().over(Window.orderBy(ring, "own")).cast("bigint").alias("pos"))


def insertion_pool(pool: DataFrame, queries: DataFrame, key: str = "embedding", ident: str = "vec_id", exclude: DataFrame | None = None) -> DataFrame:
    """The pool without copies of queries, without later copies of its own rows, and without excluded ids."""
    fresh = pool.join(queries.select(key).distinct(), key, "left_anti")
    first = fresh.groupBy(key).agg(F.min(ident).alias(ident))
    kept = fresh.join(first.select(ident), ident, "left_semi")
    return kept if exclude is None else kept.join(exclude.select(ident).distinct(), ident, "left_anti")


def prefix(n0: int, percent: int) -> int:
    return n0 * percent // 100


def among_first(vectors: DataFrame, salt: str, counts: list[int]) -> dict[int, Column]:
    """For every count the condition that a row is among the first so many of `hash_order`, by the key of the last of these: no join is needed."""
    rows = {r["pos"]: r["vec_id"] for r in hash_order(vectors, salt).where((F.col("pos") <= max(counts)) & F.col("pos").isin(*counts)).collect()}
    key = F.md5(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")))
    out = {}
    for c in counts:
        if c in rows:
            last = hashlib.md5(f"{salt}:{rows[c]}".encode()).hexdigest()
            out[c] = (key < last) | ((key == last) & (F.col("vec_id") <= rows[c]))
        else:  # none of them, or all of them
            out[c] = F.lit(c > 0)
    return out


def live(base: DataFrame, pool: DataFrame, state: State, n0: int, order: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(scanned, live): what a search passes and what it may return."""
    cols = ["vec_id", "embedding"]
    c = prefix(n0, state.percent)
    if state.kind == "S0":
        return base.select(cols), base.select(cols)
    if state.kind == "del":
        return base.select(cols), base.select(cols).where(~among_first(base, "del", [c])[c])
    if order is None:
        new = pool.select(cols).where(among_first(pool, "id", [c])[c])
    else:
        new = pool.select(cols).join(order.where(F.col("pos") <= c).select("vec_id"), "vec_id", "left_semi")
    both = base.select(cols).unionByName(new)
    return both, both


def flagged(base: DataFrame, pool: DataFrame, states: list[str], n0: int) -> DataFrame:
    """(vec_id, embedding, scanned, live): every vector that some state scans; bit i of the last two is the state at i, as in `live`."""
    at = {s: parse(s) for s in states}
    counts = lambda kind: [prefix(n0, x.percent) for x in at.values() if x.kind == kind]
    gone = among_first(base, "del", counts("del")) if counts("del") else {}
    new = among_first(pool, "id", counts("id")) if counts("id") else {}
    bits = lambda conditions: sum((F.when(c, F.lit(1 << i)).otherwise(0).cast("bigint") for i, c in enumerate(conditions)), F.lit(0).cast("bigint"))
    own = bits([~gone[prefix(n0, x.percent)] if x.kind == "del" else F.lit(True) for x in at.values()])
    added = bits([new[prefix(n0, x.percent)] if x.kind == "id" else F.lit(False) for x in at.values()])
    return (base.select("vec_id", "embedding", F.lit((1 << len(at)) - 1).cast("bigint").alias("scanned"), own.alias("live"))
            .unionByName(pool.select("vec_id", "embedding", added.alias("scanned"), added.alias("live")).where("live <> 0")))


def state_truths(base: DataFrame, pool: DataFrame, queries: DataFrame, states: list[str], k: int, n0: int) -> DataFrame:
    """(state, query_id, rk, vec_id, sqdist): the exact neighbours in every state, from one pass over all vectors."""
    return knn.exact_knn_by_group(flagged(base, pool, states, n0), queries, k, states)


def state_curves(base: DataFrame, pool: DataFrame, queries: DataFrame, states: list[str], cells: int, truth: DataFrame, n0: int) -> DataFrame:
    """(state, query_id, ef, hits, dc) of every state; the anchors are those of the base, as the index was built, and each vector is assigned once."""
    every, centres = flagged(base, pool, states, n0), ivf.anchors(base, cells).toArrow()
    scans = F.explode(F.filter(F.array(*[F.when(F.col("scanned").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, F.lit(s)) for i, s in enumerate(states)]), lambda x: x.isNotNull()))
    cell = ivf.assign(every, centres, "scanned").select(scans.alias("state"), "vec_id", "cell")
    order = ivf.probe_order(queries, centres, cells).select(F.explode(F.array(*[F.lit(s) for s in states])).alias("state"), "query_id", "cell", "ef")
    return ivf.curve(order, cell, truth, cells, ("state",))


def state_curve(base: DataFrame, pool: DataFrame, queries: DataFrame, state: State, cells: int, k: int, n0: int) -> tuple[DataFrame, DataFrame]:
    """(truth, curve) of one state; the anchors are those of the base, as the index was built."""
    scanned, alive = live(base, pool, state, n0)
    centres = ivf.anchors(base, cells).toArrow()
    truth = knn.exact_knn(alive, queries, k)
    return truth, ivf.curve(ivf.probe_order(queries, centres, cells), ivf.assign(scanned, centres), truth, cells)


def overlap(truth: DataFrame, truth0: DataFrame, k: int) -> DataFrame:
    """(query_id, overlap, decay): how many of the first state's neighbours are still neighbours."""
    kept = truth0.join(truth.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("overlap"))
    return truth0.select("query_id").distinct().join(kept, "query_id", "left").fillna(0, ["overlap"]).withColumn("decay", 1 - F.col("overlap") / F.lit(float(k)))


def density_drift(truth: DataFrame, truth0: DataFrame, k: int) -> DataFrame:
    """(query_id, drift): relative change of the k-th distance."""
    d = lambda t, n: t.where(F.col("rk") == k).select("query_id", F.sqrt("sqdist").alias(n))
    return d(truth, "_d").join(d(truth0, "_d0"), "query_id").select("query_id", ((F.col("_d") - F.col("_d0")) / F.col("_d0")).alias("drift"))


def distribution_drift(moved: DataFrame, base: DataFrame) -> DataFrame:
    """One row: distance of the means over the base's spread (root of its summed variances)."""
    stats = lambda df, m: df.select(F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double")).groupBy("dim").agg(F.avg("x").alias(m), F.var_samp("x").alias(f"{m}_v"))
    both = stats(moved, "a").join(stats(base, "b"), "dim")
    return both.agg((F.sqrt(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")))) / F.sqrt(F.sum("b_v"))).alias("drift"))


def effort_ratio(labels: DataFrame, labels0: DataFrame) -> DataFrame:
    """(query_id, log2_ratio): change of the oracle's effort where both are known."""
    both = labels.select("query_id", "oracle_ef").join(labels0.select("query_id", F.col("oracle_ef").alias("_e0")), "query_id")
    return both.select("query_id", F.log2(F.col("oracle_ef") / F.col("_e0")).alias("log2_ratio"))
