"""Registered queries that describe: features, choices, leaves of a frozen tree, rank matrices, grids, wide curves, contract regret."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import effort, models, profile
from .contract import CANDS, CENTROID, CONTRACT, FEATURES, KNN, LADDER, PROBS, STRATA, TO_CURVE, TO_LABELS, TREE, VECTORS, base_curve, cands_of, features_of, probs_of, strata_of

QUERIES: dict = {}
SQL: dict[str, str] = {}
NAMES = ("knn_dist", "concentration", "lid", "centroid_dist")
ALL_FEATURES = FEATURES + CENTROID + ", ft as (select query_id, round(knn_dist, 6) as knn_dist, round(concentration, 6) as concentration, round(lid, 6) as lid, round(centroid_dist, 6) as centroid_dist from feat join cent using (query_id))"


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f
    return keep


def rounded_features(spark, d):
    return features_of(spark, d).select("query_id", *[F.round(c, 6).alias(c) for c in NAMES])


@query("with " + VECTORS + KNN + ALL_FEATURES + ", long as (" + " union all ".join(f"select '{c}' as c, {c} as v from ft" for c in NAMES) + """)
select c as "column", count(v) as n, round(avg(v), 9) as mean, round(stddev_samp(v), 9) as std, min(v) as least, round(quantile_cont(v, 0.25), 9) as q25, round(median(v), 9) as median, round(quantile_cont(v, 0.75), 9) as q75, max(v) as most from long group by 1""")
def feature_summary(spark, d):
    return profile.describe(rounded_features(spark, d), list(NAMES)).withColumns({c: F.round(c, 9) for c in ("mean", "std", "q25", "median", "q75")})


@query("with " + VECTORS + KNN + ALL_FEATURES + ", rk as (select " + ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0::double as {c}" for c in NAMES) + " from ft) "
       + " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 4) as rho from rk" for a in NAMES for b in NAMES))
def rank_matrix(spark, d):
    return profile.rank_matrix(rounded_features(spark, d), list(NAMES))


CHOICE = """,
ch as (select query_id, coalesce(min(case when cm >= 0.9::double - 1e-12 then j end), max(j)) as j from run group by 1)"""


@query(TO_CURVE + CANDS + PROBS + CHOICE + " select l.j as bin, count(ch.j) as n, count(ch.j) / (select count(*) from ch)::double as share from ladder l left join ch on ch.j = l.j group by 1")
def choice_shares(spark, d):
    return profile.bin_counts(effort.choose(probs_of(cands_of(spark, d)), 0.9), "choice", len(LADDER))


@query(TO_CURVE + CANDS + CONTRACT + PROBS + CHOICE + """,
me as (select count(*) filter (success) / count(*)::double as rate, sum(cost) / count(*)::double as mean_cost from ch join cand using (query_id, j))
select any_value(rate) as success_rate, any_value(mean_cost) as mean_cost, sum(case when r <= ceil(rate * n - 1e-9) then win else fail end) / any_value(n)::double as oracle_cost,
any_value(mean_cost) - sum(case when r <= ceil(rate * n - 1e-9) then win else fail end) / any_value(n)::double as contract_regret from rk, me""")
def contract_regret(spark, d):
    c = cands_of(spark, d)
    return effort.contract_regret(effort.choose(probs_of(c), 0.9), c)


@query(TO_LABELS + STRATA + FEATURES + """,
lf as (select s.tier, round(knn_dist, 6) as knn_dist, round(lid, 6) as lid, case when round(knn_dist, 6)::float::double <= 1.2::double then 0 when round(lid, 6)::float::double <= 40.0::double then 1 else 2 end as leaf from feat join strata s using (query_id))
select leaf, count(*) as n, count(*) filter (tier = 'low') / count(*)::double as share_low, count(*) filter (tier = 'mid') / count(*)::double as share_mid, count(*) filter (tier = 'high') / count(*)::double as share_high,
round(avg(lid), 9) as mean_lid, round(median(knn_dist), 9) as median_knn_dist, round(median(lid), 9) as median_lid from lf group by 1""")
def leaf_profile(spark, d):
    _, _, _, tier = strata_of(spark, d)
    rows = rounded_features(spark, d).join(tier.select("query_id", "tier"), "query_id").withColumn("leaf", models.leaf(TREE))
    out = profile.group_profile(rows, "leaf", "tier", ("low", "mid", "high"), ("knn_dist", "lid"), (F.round(F.avg("lid"), 9).alias("mean_lid"),))
    return out.withColumns({c: F.round(c, 9) for c in ("median_knn_dist", "median_lid")})


@query(TO_CURVE + " select query_id, list(ef order by ef) = range(1, 21) as same from curve group by 1")
def grid_complete(spark, d):
    return profile.follows_grid(base_curve(spark, d), "query_id", "ef", list(range(1, 21)))


@query(TO_CURVE + " select query_id, " + ", ".join(f"max(case when ef = {e} then hits end) as hits_{e}" for e in LADDER) + " from curve group by 1")
def curve_matrix(spark, d):
    return profile.wide(base_curve(spark, d), "query_id", "ef", list(LADDER), "hits")
