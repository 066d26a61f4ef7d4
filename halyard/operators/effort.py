"""Effort curves to labels, tiers and policies.

A curve is long: (query_id, ef, hits, dc), hits out of k true neighbours.  Counts are integers, so that means are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLACK = 1e-9


def geometric_grid(least: int, most: int, ratio: float) -> list[int]:
    """Strictly growing integers: the next is the rounded multiple, at least one more, at most `most`."""
    if least < 1 or most < least or ratio <= 1:
        raise ValueError("geometric_grid: need 1 <= least <= most and ratio > 1")
    out = [least]
    while out[-1] < most:
        out.append(min(most, max(out[-1] + 1, math.floor(out[-1] * ratio + 0.5))))
    return out


def grid_table(spark: SparkSession, least: int, most: int, ratio: float) -> DataFrame:
    return spark.createDataFrame([(i, e) for i, e in enumerate(geometric_grid(least, most, ratio))], "i bigint, ef bigint")


def need(k: int, target: float) -> int:
    """The hits that reach a recall target."""
    return math.ceil(target * k - k * SLACK)


def oracle_labels(curve: DataFrame, k: int, target: float = 1.0) -> DataFrame:
    """(query_id, reached, oracle_ef, first_ef, oracle_dc): the effort from which the target holds ever after, and the first to reach it.

    A query that misses the target at the largest effort is censored: reached is false and the labels are null but for first_ef.
    """
    ok = (F.col("hits") >= need(k, target)).cast("int")
    ever = Window.partitionBy("query_id").orderBy("ef").rowsBetween(0, Window.unboundedFollowing)
    marked = curve.select("query_id", "ef", "dc", ok.alias("ok"), F.min(ok).over(ever).alias("stays"))
    out = marked.groupBy("query_id").agg(F.min(F.when(F.col("stays") == 1, F.col("ef"))).alias("oracle_ef"), F.min(F.when(F.col("ok") == 1, F.col("ef"))).alias("first_ef"),
                                         F.min(F.when(F.col("stays") == 1, F.struct("ef", "dc"))).alias("_at"))
    return out.select("query_id", F.col("oracle_ef").isNotNull().alias("reached"), "oracle_ef", "first_ef", F.col("_at.dc").alias("oracle_dc"))


def sensitivity(curve: DataFrame, k: int, targets: tuple[float, ...]) -> DataFrame:
    """(target, reached, mean_ef, distinct_ef) of the labels for several targets."""
    parts = [oracle_labels(curve, k, t).agg(F.lit(t).alias("target"), F.count("oracle_ef").alias("reached"), F.avg("oracle_ef").alias("mean_ef"), F.countDistinct("oracle_ef").alias("distinct_ef")) for t in targets]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fixed_curve(curve: DataFrame, k: int, target: float = 1.0, *by: str) -> DataFrame:
    """(by..., ef, mean_recall, mean_dc, failure_rate) of using one effort for all queries."""
    return curve.groupBy(*by, "ef").agg((F.sum("hits") / (F.count("*") * F.lit(float(k)))).alias("mean_recall"), (F.sum("dc") / F.count("*")).alias("mean_dc"),
                                   (F.count(F.when(F.col("hits") < need(k, target), 1)) / F.count("*")).alias("failure_rate"))


def sweep_summary(curve: DataFrame, k: int) -> DataFrame:
    """(ef, mean_recall, p05_recall, below_90, mean_dc) by effort."""
    recall = F.col("hits") / F.lit(float(k))
    return curve.groupBy("ef").agg((F.sum("hits") / (F.count("*") * F.lit(float(k)))).alias("mean_recall"), F.percentile(recall, F.lit(0.05)).alias("p05_recall"),
                                   (F.count(F.when(recall < 0.9, 1)) / F.count("*")).alias("below_90"), (F.sum("dc") / F.count("*")).alias("mean_dc"))


def ef_distribution(labels: DataFrame) -> DataFrame:
    """One row: how many are labelled or censored, quantiles of the label, distinct ones, the share at the smallest and of the commonest."""
    done = labels.where("reached")
    counts = done.groupBy("oracle_ef").count()
    top = counts.agg(F.max("count").alias("mode_count"), F.min(F.struct("oracle_ef", "count")).alias("_floor"), F.count("*").alias("distinct_ef"))
    q = done.agg(F.count("*").alias("n"), *[F.percentile("oracle_ef", F.lit(p)).alias(f"p{int(p * 100)}") for p in (0.1, 0.5, 0.9, 0.99)], F.max("oracle_ef").alias("max_ef"))
    lost = labels.agg(F.count(F.when(~F.col("reached"), 1)).alias("censored"))
    return q.crossJoin(top).crossJoin(lost).select("n", "censored", "p10", "p50", "p90", "p99", "max_ef", "distinct_ef", (F.col("_floor.count") / F.col("n")).alias("floor_share"), (F.col("mode_count") / F.col("n")).alias("mode_share"))


def grid_quantile(labels: DataFrame, grid: DataFrame, *shares: float) -> DataFrame:
    """(share, ef): the smallest grid effort at which that share of the labelled queries has its label."""
    counts = labels.where("reached").groupBy(F.col("oracle_ef").alias("ef")).count()
    upto = Window.orderBy("ef").rowsBetween(Window.unboundedPreceding, 0)
    cdf = grid.select("ef").join(counts, "ef", "left").fillna(0, ["count"]).withColumn("_c", F.sum("count").over(upto))
    cdf = cdf.crossJoin(counts.agg(F.sum("count").alias("_n"))).withColumn("cdf", F.col("_c") / F.col("_n"))
    return cdf.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).where(F.col("cdf") >= F.col("share") - 1e-12).groupBy("share").agg(F.min("ef").alias("ef"))


def tiers(labels: DataFrame, low: int, mid: int, high: int) -> DataFrame:
    """(query_id, tier, exceeds, censored): the tier whose effort suffices; beyond the highest and censored ones are high, too."""
    ef = F.col("oracle_ef")
    return labels.select("query_id", F.when(ef <= low, "low").when(ef <= mid, "mid").otherwise("high").alias("tier"),
                         F.coalesce(ef > high, F.lit(True)).alias("exceeds"), (~F.col("reached")).alias("censored"))


# --- policies ------------------------------------------------------------------------------------------------------


def lookup(curve: DataFrame, policy: DataFrame, *by: str) -> DataFrame:
    """The curve's hits and dc at each query's assigned effort; an effort that the curve lacks is an error."""
    at = policy.join(curve.select(*by, "query_id", "ef", "hits", "dc"), [*by, "query_id", "ef"], "left")
    missing = F.raise_error(F.concat(F.lit("no curve point for query "), F.col("query_id").cast("string"), F.lit(" at effort "), F.col("ef").cast("string")))
    return at.withColumn("hits", F.when(F.col("hits").isNull(), missing.cast("bigint")).otherwise(F.col("hits")))


def fixed_policy(curve: DataFrame, ef: int) -> DataFrame:
    return lookup(curve, curve.select("query_id").distinct().withColumn("ef", F.lit(ef).cast("bigint")))


def tier_route(curve: DataFrame, predicted: DataFrame, efs: dict[str, int], probe: Column, k: int, target: float = 1.0) -> DataFrame:
    """Rows of a routed policy: search cost at the tier's effort and the cost of the probe that chose the tier."""
    ef = F.coalesce(*[F.when(F.col("tier") == t, F.lit(e).cast("bigint")) for t, e in efs.items()])
    found = lookup(curve, predicted.withColumn("ef", ef).withColumn("probe_dc", probe))
    return found.withColumn("total_dc", F.col("dc") + F.col("probe_dc")).withColumn("failure", F.col("hits") < need(k, target))


def cheapest_fixed(fixed: DataFrame, recall: float) -> DataFrame:
    return fixed.where(F.col("mean_recall") >= recall - SLACK).agg(F.min("ef").alias("ef"))


def search_cap(fixed: DataFrame, recall: float = 0.99) -> int | None:
    """The smallest effort whose mean recall is at least this: the cap of the adaptive policy."""
    return cheapest_fixed(fixed, recall).first()["ef"]


def interpolated_cost(fixed: DataFrame, recalls: DataFrame) -> DataFrame:
    """(recall, cost): cost at a mean recall, linear between the efforts around it; infinite if no effort reaches it."""
    order = Window.orderBy("ef")
    steps = fixed.withColumn("_r", F.lag("mean_recall").over(order)).withColumn("_d", F.lag("mean_dc").over(order))
    hit = recalls.crossJoin(steps).where(F.col("mean_recall") >= F.col("recall") - SLACK)
    first = hit.groupBy("recall").agg(F.min(F.struct("ef", "mean_recall", "mean_dc", "_r", "_d")).alias("s"))
    w = F.when(F.col("s.mean_recall") == F.col("s._r"), 0.0).otherwise((F.col("recall") - F.col("s._r")) / (F.col("s.mean_recall") - F.col("s._r")))
    cost = F.when(F.col("s._r").isNull(), F.col("s.mean_dc")).otherwise(F.col("s._d") + w * (F.col("s.mean_dc") - F.col("s._d")))
    return recalls.join(first, "recall", "left").select("recall", F.when(F.col("s").isNull(), float("inf")).otherwise(cost).alias("cost"))


def two_effort_mix(fixed: DataFrame, target: float, *by: str) -> DataFrame:
    """(by..., ef_lo, ef_hi, w_hi): the two efforts around a mean recall and the share of the larger; no row if none reaches it."""
    order = Window.partitionBy(*by).orderBy("ef")
    steps = fixed.withColumn("_r", F.lag("mean_recall").over(order)).withColumn("_e", F.lag("ef").over(order)).where(F.col("mean_recall") >= target - 1e-12)
    first = steps.groupBy(*by).agg(F.min(F.struct("ef", "mean_recall", "_e", "_r")).alias("s"))
    pure = F.col("s._e").isNull() | (F.abs(F.col("s.mean_recall") - target) < 1e-15)
    w = (target - F.col("s._r")) / (F.col("s.mean_recall") - F.col("s._r"))
    return first.select(*by, F.when(pure, F.col("s.ef")).otherwise(F.col("s._e")).alias("ef_lo"), F.col("s.ef").alias("ef_hi"), F.when(pure, 1.0).otherwise(w).alias("w_hi")).where("ef_hi is not null")


def assign_mix(queries: DataFrame, mix: DataFrame, uniform: Column, *by: str) -> DataFrame:
    """(by..., query_id, ef): a query's hash decides which of the two efforts it gets."""
    drawn = queries.withColumn("_u", uniform)
    both = drawn.join(F.broadcast(mix), list(by)) if by else drawn.crossJoin(F.broadcast(mix))
    return both.select(*by, "query_id", F.when(F.col("_u") < F.col("w_hi"), F.col("ef_hi")).otherwise(F.col("ef_lo")).alias("ef"))


def regret(policy: DataFrame, labels: DataFrame, total: str = "total_dc", search: str = "dc") -> DataFrame:
    """Costs beyond the oracle's; null where the oracle's effort is unknown."""
    return policy.join(labels.select("query_id", "oracle_dc"), "query_id", "left").withColumn("regret_total", F.col(total) - F.col("oracle_dc")).withColumn("regret_search", F.col(search) - F.col("oracle_dc"))


def confusion(pairs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Counts of true (rows) by predicted tier, zero where there are none, in a fixed order."""
    full = pairs.sparkSession.createDataFrame([(n,) for n in names], "truth string")
    table = pairs.groupBy("truth").pivot("predicted", list(names)).count()
    return full.join(table, "truth", "left").fillna(0, list(names))


def error_prices(curve: DataFrame, pairs: DataFrame, efs: dict[str, int], k: int) -> DataFrame:
    """(truth, predicted, n, extra_dc, recall_lost): what a wrong tier costs, beside the right one."""
    table = F.create_map(*[x for t, e in efs.items() for x in (F.lit(t), F.lit(e).cast("bigint"))])
    c = curve.select("query_id", "ef", "hits", "dc")
    both = pairs.withColumn("ef", table[F.col("predicted")]).join(c, ["query_id", "ef"]).withColumnsRenamed({"hits": "ph", "dc": "pd", "ef": "pe"})
    both = both.withColumn("ef", table[F.col("truth")]).join(c, ["query_id", "ef"])
    return both.groupBy("truth", "predicted").agg(F.count("*").alias("n"), (F.sum(F.col("pd") - F.col("dc")) / F.count("*")).alias("extra_dc"), (F.sum(F.col("hits") - F.col("ph")) / (F.count("*") * F.lit(float(k)))).alias("recall_lost"))


# --- candidates ----------------------------------------------------------------------------------------------------


def candidates(curve: DataFrame, efs: list[int], k: int, target: float = 1.0) -> DataFrame:
    """(query_id, j, ef, success, cost): the curve at a ladder of efforts."""
    ladder = curve.sparkSession.createDataFrame([(j, e) for j, e in enumerate(efs)], "j bigint, ef bigint")
    return curve.join(F.broadcast(ladder), "ef").select("query_id", "j", "ef", (F.col("hits") >= need(k, target)).alias("success"), F.col("hits"), F.col("dc").alias("cost"))


def doubling_ladder(least: int, most: int) -> list[int]:
    out = [least]
    while out[-1] < most:
        out.append(min(most, out[-1] * 2))
    return out


def candidate_oracle(cands: DataFrame, m: int) -> DataFrame:
    """(query_id, y): the first candidate from which success holds ever after; m if the last one fails."""
    ok = F.col("success").cast("int")
    ever = Window.partitionBy("query_id").orderBy("j").rowsBetween(0, Window.unboundedFollowing)
    return cands.withColumn("_s", F.min(ok).over(ever)).groupBy("query_id").agg(F.coalesce(F.min(F.when(F.col("_s") == 1, F.col("j"))), F.lit(m).cast("bigint")).alias("y"))


def choose(probabilities: DataFrame, tau: float) -> DataFrame:
    """(query_id, choice, fallback): the cheapest candidate whose probability, or that of one before, is at least tau; else the last."""
    upto = Window.partitionBy("query_id").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    run = probabilities.withColumn("_p", F.max("p").over(upto))
    out = run.groupBy("query_id").agg(F.min(F.when(F.col("_p") >= tau - 1e-12, F.col("j"))).alias("_c"), F.max("j").alias("_last"))
    return out.select("query_id", F.coalesce("_c", "_last").alias("choice"), F.col("_c").isNull().alias("fallback"))


def calibrate_tau(probabilities: DataFrame, quality: DataFrame, target: float, steps: int = 1000) -> DataFrame:
    """One row (tau, quality): the smallest tau on an even grid at which the mean quality of the choices reaches the target; null if none does.

    A choice changes only where tau passes one of a query's running maxima, so each query gives one row for each stretch of taus.
    """
    order = Window.partitionBy("query_id").orderBy("j")
    run = probabilities.withColumn("_p", F.max("p").over(order.rowsBetween(Window.unboundedPreceding, 0))).join(quality, ["query_id", "j"])
    top = F.floor((F.col("_p") + 1e-12) * steps).cast("int")  # the last tau step that this candidate still meets
    prev = F.coalesce(F.max(top).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    last = F.lead("j").over(order).isNull()
    stretch = run.withColumn("_from", prev + 1).withColumn("_to", F.when(last, F.lit(steps)).otherwise(top)).where("_from <= _to")
    up = stretch.select(F.col("_from").alias("t"), F.col("q").cast("double").alias("d"), F.lit(0).alias("o"))
    down = stretch.select((F.col("_to") + 1).alias("t"), (-F.col("q")).cast("double").alias("d"), F.lit(0).alias("o"))
    taus = probabilities.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("t"), F.lit(0.0).alias("d"), F.lit(1).alias("o"))
    moves = up.unionByName(down).unionByName(taus).groupBy("t").agg(F.sum("d").alias("d"), F.max("o").alias("o"))
    n = probabilities.select("query_id").distinct().agg(F.count("*").alias("n"))
    run = moves.withColumn("s", F.sum("d").over(Window.orderBy("t"))).where("o = 1").crossJoin(n).withColumn("quality", F.col("s") / F.col("n"))
    return run.where(F.col("quality") >= target - 1e-9).agg(F.min(F.struct((F.col("t") / F.lit(float(steps))).alias("tau"), "quality")).alias("b")).select("b.tau", "b.quality")


def select_family(rows: list[dict], tolerance: float, order: list[str]) -> str | None:
    """Of the feasible rows within the tolerance of the cheapest, the first in order of simplicity."""
    able = [r for r in rows if r["feasible"]]
    if not able:
        return None
    least = min(r["cost"] for r in able)
    return min((r for r in able if r["cost"] <= least * (1 + tolerance) + 1e-12), key=lambda r: order.index(r["name"]))["name"]


def select_candidate(rows: list[dict], tolerance: float, order: list[str]) -> str:
    able = [r for r in rows if r["feasible"]]
    if not able:
        raise RuntimeError("no feasible candidate")
    best = max(r["score"] for r in able)
    return min((r["name"] for r in able if r["score"] >= best - tolerance), key=lambda n: order.index(n) if n in order else len(order))


# --- allocation ----------------------------------------------------------------------------------------------------


def contract_oracle(cands: DataFrame, share: float) -> DataFrame:
    """One row (feasible, mean_cost, success_rate, achievable_rate): the cheapest way to let a share of queries succeed.

    A query succeeds at the cost of its first lasting success or fails at its least cost; the queries for which success
    adds least, ties by id, succeed.  The order of the extra costs needs one row a query.
    """
    ok = F.col("success").cast("int")
    ever = Window.partitionBy("query_id").orderBy("j").rowsBetween(0, Window.unboundedFollowing)
    each = cands.withColumn("_s", F.min(ok).over(ever)).groupBy("query_id").agg(F.min("cost").alias("fail"), F.min(F.when(F.col("_s") == 1, F.struct("j", "cost"))).alias("_f"))
    each = each.select("query_id", "fail", F.col("_f.cost").alias("win"))
    n = each.agg(F.count("*").alias("n"), F.count("win").alias("able")).withColumn("need", F.ceil(F.lit(share) * F.col("n") - 1e-9))
    order = Window.orderBy((F.col("win") - F.col("fail")).asc_nulls_last(), "query_id")
    ranked = each.withColumn("_r", F.row_number().over(order)).crossJoin(F.broadcast(n))
    wins = F.col("_r") <= F.col("need")
    ok_all = F.col("able") >= F.col("need")
    out = ranked.groupBy("n", "able", "need").agg(F.sum(F.when(wins, F.col("win")).otherwise(F.col("fail"))).alias("_t"))
    return out.select(ok_all.alias("feasible"), F.when(ok_all, F.col("_t") / F.col("n")).alias("mean_cost"), F.when(ok_all, F.col("need") / F.col("n")).alias("success_rate"), (F.col("able") / F.col("n")).alias("achievable_rate"))


def contract_regret(choices: DataFrame, cands: DataFrame) -> DataFrame:
    """One row (success_rate, mean_cost, oracle_cost, contract_regret): what a policy of (query_id, choice) costs beyond the contract oracle at the success rate that it realises."""
    mine = choices.select("query_id", F.col("choice").alias("j")).join(cands, ["query_id", "j"])
    mine = mine.agg((F.count(F.when(F.col("success"), 1)) / F.count("*")).alias("success_rate"), (F.sum("cost") / F.count("*")).alias("mean_cost"))
    rate = mine.first()["success_rate"]
    best = contract_oracle(cands, rate or 0.0).select(F.col("mean_cost").alias("oracle_cost"))
    return mine.crossJoin(best).withColumn("contract_regret", F.col("mean_cost") - F.col("oracle_cost"))


def priced_choice(cands: DataFrame, price: float, k: int) -> DataFrame:
    """(query_id, j, hits, cost): the least of cost minus price times recall, ties to the first candidate."""
    key = F.struct((F.col("cost") - F.lit(price) * (F.col("hits") / F.lit(float(k)))).alias("v"), "j", "hits", "cost")
    return cands.groupBy("query_id").agg(F.min(key).alias("b")).select("query_id", "b.j", "b.hits", "b.cost")


def lagrangian(cands: DataFrame, k: int, target: float) -> dict | None:
    """The least price beyond which the priced choices reach a mean recall, with their recall and cost; None if none reaches it.

    As the price rises a query moves along the lower hull of its (hits, cost), so prices matter only where some query moves.
    The moves are summed by price, then by octaves' parts of 1/64, of which the one that crosses the target is read exactly:
    three aggregates, whatever the number of queries.
    """
    points = cands.groupBy("query_id", "hits").agg(F.min("cost").alias("cost"))
    n = cands.agg(F.count_distinct("query_id")).first()[0]
    hull = points.groupBy("query_id").agg(F.collect_list(F.struct("hits", "cost")).alias("ps")).select("ps", F.explode("ps").alias("b"))
    price = lambda lo, hi: (hi["cost"] - lo["cost"]) * F.lit(k) / (hi["hits"] - lo["hits"])
    below = F.transform(F.filter("ps", lambda a: a["hits"] < F.col("b.hits")), lambda a: price(a, F.col("b")))
    above = F.transform(F.filter("ps", lambda c: c["hits"] > F.col("b.hits")), lambda c: price(F.col("b"), c))
    hull = hull.select("b.hits", "b.cost", F.greatest(F.lit(0.0), F.array_max(below)).alias("enter"), F.array_min(above).alias("leave")).where("leave is null or enter < leave")
    on = F.struct(F.col("enter").alias("price"), F.col("hits").alias("h"), F.col("cost").alias("c"))
    off = F.struct(F.col("leave").alias("price"), (-F.col("hits")).alias("h"), (-F.col("cost")).alias("c"))
    moves = hull.select(F.explode(F.array(on, off)).alias("m")).select("m.*").where("price is not null").groupBy("price").agg(F.sum("h").alias("h"), F.sum("c").alias("c"))
    moves = moves.withColumn("part", F.floor(F.log2(F.col("price") + 1) * 64)).persist()
    hits = cost = 0
    out, reached = None, lambda h: h / (n * float(k)) >= target - SLACK
    for r in moves.groupBy("part").agg(F.sum("h").alias("h"), F.sum("c").alias("c")).orderBy("part").collect():
        if reached(hits + r["h"]):
            run = Window.orderBy("price").rowsBetween(Window.unboundedPreceding, 0)
            at = moves.where(F.col("part") == r["part"]).select("price", (F.sum("h").over(run) + hits).alias("h"), (F.sum("c").over(run) + cost).alias("c"))
            at = at.where(F.col("h") / F.lit(n * float(k)) >= F.lit(target - SLACK)).orderBy("price").first()
            out = {"price": at["price"], "recall": at["h"] / (n * float(k)), "cost": at["c"] / n}
            break
        hits, cost = hits + r["h"], cost + r["c"]
    moves.unpersist()
    return out


def policy_metrics(choices: DataFrame, cands: DataFrame, oracle: DataFrame, m: int, probe: Column | None = None) -> DataFrame:
    """One row of what a policy of (query_id, choice, fallback) achieves, and where it fails or overspends."""
    probe = F.lit(0) if probe is None else probe
    mine = choices.withColumnRenamed("choice", "j").join(cands, ["query_id", "j"]).join(oracle, "query_id")
    best = cands.select("query_id", F.col("j").alias("_y"), F.col("cost").alias("_best"))
    mine = mine.withColumn("_y", F.least("y", F.lit(m - 1))).join(best, ["query_id", "_y"]).withColumn("_p", probe)
    able, s = F.col("y") < m, F.col("success")
    mean = lambda c, w: F.coalesce(F.sum(F.when(w, c)) / F.count(F.when(w, 1)), F.lit(0.0))
    rate = lambda c: F.count(F.when(c, 1)) / F.count("*")
    return mine.agg(rate(s).alias("success_rate"), rate(~s).alias("failure_rate"), (F.sum(F.col("cost") + F.col("_p")) / F.count("*")).alias("mean_total_cost"), F.median(F.col("cost") + F.col("_p")).alias("median_total_cost"),
                    (F.sum("cost") / F.count("*")).alias("mean_search_cost"), rate(F.col("fallback")).alias("fallback_rate"), rate(~s & able).alias("avoidable_failure_rate"), rate(~s & ~able).alias("unavoidable_failure_rate"),
                    mean(F.col("cost") - F.col("_best"), s & able).alias("overspend_on_successes"), mean(F.col("_best") - F.col("cost"), ~s & able).alias("underspend_on_avoidable_failures"))
