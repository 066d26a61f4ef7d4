"""Panels of policies over index states: cost and contract drift, with intervals and verdicts, and the checks that come first."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats

PANEL = "policy string, seed int, state string, query_id bigint, cost bigint, hits bigint"


class PanelError(ValueError):
    """A panel that is not complete; nothing is dropped to make it so."""


def violations(panel: DataFrame, k: int, expected: DataFrame) -> DataFrame:
    """(rule, n): how often each rule is broken.  `expected` holds the cells (policy, seed, state) that must be there."""
    key = ["policy", "seed", "state"]
    full = panel.select("query_id").distinct()
    cells = panel.select(*key).distinct()
    count = lambda df, rule: df.agg(F.lit(rule).alias("rule"), F.count("*").alias("n"))
    parts = [
        count(panel.groupBy(*key, "query_id").count().where("count > 1"), "repeated"),
        count(panel.where(F.col("cost").isNull() | F.col("hits").isNull()), "null"),
        count(panel.where((F.col("hits") < 0) | (F.col("hits") > k)), "hits_range"),
        count(panel.where("cost <= 0"), "cost_positive"),
        count(expected.join(cells, key, "left_anti"), "missing_cell"),
        count(cells.join(expected, key, "left_anti"), "extra_cell"),
        count(cells.crossJoin(full).join(panel.select(*key, "query_id"), [*key, "query_id"], "left_anti"), "missing_query"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validate(panel: DataFrame, k: int, expected: DataFrame) -> DataFrame:
    broken = {r["rule"]: r["n"] for r in violations(panel, k, expected).collect() if r["n"]}
    if broken:
        raise PanelError(str(broken))
    return panel


def state_means(panel: DataFrame) -> DataFrame:
    return panel.groupBy("policy", "seed", "state").agg((F.sum("cost") / F.count("*")).alias("cost"), (F.sum("hits") / F.count("*")).alias("hits"), F.count("*").alias("n"))


def cost_drift(panel: DataFrame, reference: str, first: str = "S0") -> DataFrame:
    """(policy, seed, state, drift): the cost ratio to the reference policy, relative to that of the first state."""
    m = state_means(panel).select("policy", "seed", "state", "cost")
    ref = m.where(F.col("policy") == reference).select("seed", "state", F.col("cost").alias("ref"))
    ratio = m.where(F.col("policy") != reference).join(ref, ["seed", "state"]).withColumn("ratio", F.col("cost") / F.col("ref"))
    ratio0 = ratio.where(F.col("state") == first).select("policy", "seed", F.col("ratio").alias("ratio0"))
    return ratio.join(ratio0, ["policy", "seed"]).select("policy", "seed", "state", (F.col("ratio") / F.col("ratio0") - 1).alias("drift"))


def contract_transitions(panel: DataFrame, k: int, first: str = "S0") -> DataFrame:
    """(policy, seed, state, stable_pass, newly_failing, stable_fail, improved, newly_failing_rate)."""
    ok = panel.withColumn("ok", F.col("hits") >= k)
    ok0 = ok.where(F.col("state") == first).select("policy", "seed", "query_id", F.col("ok").alias("ok0"))
    counts = ok.join(ok0, ["policy", "seed", "query_id"]).groupBy("policy", "seed", "state").agg(*stats.transitions(F.col("ok0"), F.col("ok")))
    return counts.withColumn("newly_failing_rate", F.try_divide(F.col("newly_failing"), F.col("newly_failing") + F.col("stable_pass")))


def analyse(panel: DataFrame, reference: str, k: int, replicates: int = stats.REPLICATES, first: str = "S0", index: np.ndarray | None = None) -> DataFrame:
    """(policy, state, cost_drift, cost_lo, cost_hi, cost_verdict, contract_drift, contract_lo, contract_hi, contract_verdict).

    Queries are resampled once for everything, by `index` (replicates of positions in the order of ids) where it is given; drifts are pooled over seeds within each replicate.  The panel's width on the
    driver is one number for each query, policy, seed and state, as one resample matrix is shared.
    """
    rows = panel.select("policy", "seed", "state", "query_id", "cost", "hits").orderBy("policy", "seed", "state", "query_id").toPandas()
    ids = sorted(rows.query_id.unique())
    w = stats.weights(stats.resamples(len(ids), replicates) if index is None else index)
    seeds, states = sorted(rows.seed.unique()), [s for s in rows.state.drop_duplicates() if s != first]
    series = {key: g.sort_values("query_id") for key, g in rows.groupby(["policy", "seed", "state"])}
    cost = lambda p, s, t: series[p, s, t].cost.to_numpy(float)
    ok = lambda p, s, t: series[p, s, t].hits.to_numpy() >= k
    one = np.ones((1, len(ids)))
    out = []
    for p in sorted(set(rows.policy) - {reference}):
        for t in states:
            def drift(weight):
                return np.mean([stats.anchored_drift(weight @ cost(p, s, t), weight @ cost(reference, s, t), weight @ cost(p, s, first), weight @ cost(reference, s, first)) for s in seeds], axis=0)

            def failing(weight):
                parts = []
                for s in seeds:
                    cohort = ok(p, s, first) & ok(reference, s, first)
                    new = lambda x: weight @ (cohort & ~ok(x, s, t)).astype(float)  # noqa: B023, E731
                    parts.append((new(p) - new(reference)) / np.maximum(weight @ cohort.astype(float), 1e-300))
                return np.mean(parts, axis=0)

            c, e = stats.interval(drift(w)), stats.interval(failing(w))
            out.append((p, t, float(drift(one)[0]), *c, float(failing(one)[0]), *e))
    df = panel.sparkSession.createDataFrame(out, "policy string, state string, cost_drift double, cost_lo double, cost_hi double, contract_drift double, contract_lo double, contract_hi double")
    return df.withColumn("cost_verdict", stats.cost_verdict(F.col("cost_lo"), F.col("cost_hi"))).withColumn("contract_verdict", stats.contract_verdict(F.col("contract_lo"), F.col("contract_hi")))


def calibration(rows: DataFrame) -> DataFrame:
    """One row over (stopped, predicted, real): how far predictions of early-stopped searches are off, and whether these are few."""
    err, s = F.col("predicted") - F.col("real"), F.col("stopped")
    return rows.agg(F.count(F.when(s, 1)).alias("n_stopped"), (F.count(F.when(s, 1)) / F.count("*")).alias("stopped_fraction"), F.avg(F.when(s, err)).alias("bias"),
                    F.avg(F.when(s, F.abs(err))).alias("mace"), (F.count(F.when(s, 1)) < stats.SMALL).alias("small_n"))
