"""The registered queries over the star schema's tables, each with SQL that checks it.

Vectors are dealt by id: one in five is a query, one in five belongs to the insertion pool, the rest is the base.  Of
the queries one in five is for testing, the others for training.  The Spark side is DataFrame operators; the SQL side
is written for another engine, from the definitions.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rng, stats
from ..functions import vectors as vec
from ..operators import effort, evolve, ivf, knn, models, validity
from ..sources.tables import spooled

K, CELLS, EFFORT = 10, 20, 5
STATES = ("S0", "id_2", "id_8", "del_2", "del_8")


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def parts(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    r = F.col("vec_id") % 5
    return v.where(r.between(1, 3)), v.where(r == 0).select(F.col("vec_id").alias("query_id"), "embedding"), v.where(r == 4)


def is_test(query="query_id"):
    return (F.col(query) / 5).cast("bigint") % 5 == 0


def base_curve(spark, d):
    base, queries, _ = parts(spark, d)
    return evolve.state_curve(base, base.limit(0), queries, evolve.State(), CELLS, K, 0)[1]


# --- shared SQL ----------------------------------------------------------------------------------------------------


def dist(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, 65), lambda i: ({a}[i]::double - {b}[i]::double) * ({a}[i]::double - {b}[i]::double)))"


VECTORS = """
v as (select vec_id, embedding from embeddings),
base as (select * from v where vec_id % 5 between 1 and 3),
pool as (select * from v where vec_id % 5 = 4),
q as (select vec_id as query_id, embedding from v where vec_id % 5 = 0)"""
KNN = f""",
pairs as (select query_id, b.vec_id, {dist('q.embedding', 'b.embedding')} as sqdist from q, base b),
knn as (select * from (select *, row_number() over (partition by query_id order by sqdist, vec_id) as rk from pairs) where rk <= 10)"""
CELL = f""",
anchor as (select * from base order by vec_id limit 20),
near as (select b.vec_id, a.vec_id as cell, row_number() over (partition by b.vec_id order by {dist('b.embedding', 'a.embedding')}, a.vec_id) as r from base b, anchor a),
bc as (select vec_id, cell from near where r = 1),
qc as (select query_id, a.vec_id as cell, row_number() over (partition by query_id order by {dist('q.embedding', 'a.embedding')}, a.vec_id) as ef from q, anchor a)"""
CURVE = """,
steps as (
  select qc.query_id, qc.ef, coalesce(s.n, 0) as n, coalesce(h.hit, 0) as hit
  from qc left join (select cell, count(*) as n from bc group by 1) s on s.cell = qc.cell
  left join (select query_id, cell, count(*) as hit from knn join bc using (vec_id) group by 1, 2) h on h.query_id = qc.query_id and h.cell = qc.cell),
curve as (
  select query_id, ef, (sum(hit) over w)::bigint as hits, (20 + sum(n) over w)::bigint as dc
  from steps window w as (partition by query_id order by ef rows between unbounded preceding and current row))"""
LABELS = """,
stay as (
  select *, min(case when hits >= 10 then 1 else 0 end) over (partition by query_id order by ef rows between current row and unbounded following) as ok from curve),
labels as (
  select query_id, min(case when ok = 1 then ef end) is not null as reached, min(case when ok = 1 then ef end) as oracle_ef,
         min(case when hits >= 10 then ef end) as first_ef, min(case when ok = 1 then dc end) as oracle_dc from stay group by 1)"""
FIXED = """,
fixed as (
  select ef, sum(hits) / (count(*) * 10.0::double) as mean_recall, sum(dc) / count(*)::double as mean_dc,
         count(case when hits < 10 then 1 end) / count(*)::double as failure_rate from curve group by 1)"""
TO_CURVE = "with " + VECTORS + KNN + CELL + CURVE
TO_LABELS = TO_CURVE + LABELS
TO_FIXED = TO_CURVE + FIXED
TRAIN = "(query_id // 5) % 5 <> 0"
STATE = """,
n0 as (select count(*) as n0 from base),
inserted as (select vec_id, row_number() over (order by md5('id:' || vec_id), vec_id) as pos from pool),
gone as (select vec_id, row_number() over (order by md5('del:' || vec_id), vec_id) as pos from base),
states(state, kind, pct) as (values ('S0', 'S0', 0), ('id_2', 'id', 2), ('id_8', 'id', 8), ('del_2', 'del', 2), ('del_8', 'del', 8)),
scanned as (
  select state, vec_id from states, base
  union all select state, vec_id from states, n0, inserted where kind = 'id' and pos <= n0 * pct // 100),
live as (
  select state, vec_id from scanned
  except select state, vec_id from states, n0, gone where kind = 'del' and pos <= n0 * pct // 100),""" + f"""
pairs as (select query_id, b.vec_id, {dist('q.embedding', 'b.embedding')} as sqdist from q, (select * from base union all select * from pool) b),
knn_s as (select * from (select state, query_id, vec_id, sqdist, row_number() over (partition by state, query_id order by sqdist, vec_id) as rk from live join pairs using (vec_id)) where rk <= 10),
anchor as (select * from base order by vec_id limit 20),
near as (select b.vec_id, a.vec_id as cell, row_number() over (partition by b.vec_id order by {dist('b.embedding', 'a.embedding')}, a.vec_id) as r
         from (select * from base union all select * from pool) b, anchor a),
bc as (select vec_id, cell from near where r = 1),
qc as (select query_id, a.vec_id as cell, row_number() over (partition by query_id order by {dist('q.embedding', 'a.embedding')}, a.vec_id) as ef from q, anchor a),
steps_s as (
  select st.state, qc.query_id, qc.ef, coalesce(s.n, 0) as n, coalesce(h.hit, 0) as hit
  from states st cross join qc
  left join (select state, cell, count(*) as n from scanned join bc using (vec_id) group by 1, 2) s on s.state = st.state and s.cell = qc.cell
  left join (select state, query_id, cell, count(*) as hit from knn_s join bc using (vec_id) group by 1, 2, 3) h on h.state = st.state and h.query_id = qc.query_id and h.cell = qc.cell),
curve_s as (
  select state, query_id, ef, (sum(hit) over w)::bigint as hits, (20 + sum(n) over w)::bigint as dc
  from steps_s window w as (partition by state, query_id order by ef rows between unbounded preceding and current row))"""
U64 = "18446744073709551616::uhugeint"


def scrambled(x: str) -> tuple[str, str, str]:
    """splitmix64 of an unsigned expression in wide arithmetic, as three steps that each read the one before."""
    step = lambda z, s, c: f"(xor({z}, {z} // {2**s}::uhugeint) * {c}::uhugeint) % {U64}"
    return f"({x} + {0x9E3779B97F4A7C15}::uhugeint) % {U64}", step("z0", 30, 0xBF58476D1CE4E5B9), step("z1", 27, 0x94D049BB133111EB)


def _uniform_sql(rows: str) -> str:
    """CTEs that end in uni(query_id, u): the hash uniform of 'sift_query:row' with the fixed seed."""
    z0, z1, z2 = scrambled("xor(h, 20261006::uhugeint)")
    return f""",
hash0 as (select query_id, list_reduce(list_prepend(1469598103934665603::uhugeint, list_transform(string_split('sift_query:' || query_id, ''), lambda c: ascii(c)::uhugeint)),
          lambda h, c: (xor(h, c) * 1099511628211::uhugeint) % {U64}) as h from {rows}),
mix0 as (select query_id, {z0} as z0 from hash0), mix1 as (select query_id, {z1} as z1 from mix0), mix2 as (select query_id, {z2} as z2 from mix1),
uni as (select query_id, xor(z2, z2 // {2**31}::uhugeint)::double / 18446744073709551616.0::double as u from mix2)"""


MIX = """,
stepped as (select ef, mean_recall, lag(ef) over (order by ef) as pe, lag(mean_recall) over (order by ef) as pr from fixed_train),
hit as (select * from stepped where mean_recall >= 0.95::double - 1e-12 order by ef limit 1),
mix as (select case when pe is null or abs(mean_recall - 0.95::double) < 1e-15 then ef else pe end as ef_lo, ef as ef_hi,
        case when pe is null or abs(mean_recall - 0.95::double) < 1e-15 then 1.0::double else (0.95::double - pr) / (mean_recall - pr) end as w_hi from hit)"""
FIXED_TRAIN = f""",
fixed_train as (select ef, sum(hits) / (count(*) * 10.0::double) as mean_recall, sum(dc) / count(*)::double as mean_dc from curve where {TRAIN} group by 1)"""
TO_MIX = TO_CURVE + FIXED_TRAIN + MIX
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return keep


# --- neighbours and recall -----------------------------------------------------------------------------------------


@query("with " + VECTORS + KNN + " select query_id, rk, vec_id, sqdist from knn")
def exact_knn(spark, d):
    base, queries, _ = parts(spark, d)
    return knn.exact_knn(base, queries, K)


@query("with " + VECTORS.replace("between 1 and 3)", "between 1 and 3 and vec_id % 7 <> 0)") + KNN + " select query_id, rk, vec_id, sqdist from knn")
def exact_knn_masked(spark, d):
    base, queries, _ = parts(spark, d)
    return knn.exact_knn(base, queries, K, base.where("vec_id % 7 = 0").select("vec_id"))


def found_at(spark, d, ef):
    """What a search at one effort returns: the nearest of the scanned cells."""
    base, queries, _ = parts(spark, d)
    return ivf.search(base, queries, ivf.anchors(base, CELLS), CELLS, ef, K)


FOUND = """,
cand as (select qc.query_id, bc.vec_id, p.sqdist from qc join bc using (cell) join pairs p on p.query_id = qc.query_id and p.vec_id = bc.vec_id where ef <= 5),
found as (select * from (select *, row_number() over (partition by query_id order by sqdist, vec_id) as rk from cand) where rk <= 10)"""


@query("with " + VECTORS + KNN + CELL + FOUND + """
select q.query_id, (select count(*) from found f join knn k using (query_id, vec_id) where f.query_id = q.query_id) / 10.0::double as recall,
       (select count(*) from found f where f.query_id = q.query_id and f.sqdist::float <= (select sqdist::float * 1.000001::float from knn k where k.query_id = q.query_id and k.rk = 10)) / 10.0::double as tie_recall
from q""")
def search_recall(spark, d):
    base, queries, _ = parts(spark, d)
    truth = knn.as_lists(knn.exact_knn(base, queries, K)).withColumnsRenamed({"ids": "t", "dists": "td"})
    return knn.as_lists(found_at(spark, d, EFFORT)).join(truth, "query_id").select("query_id", vec.recall(F.col("ids"), F.col("t"), K).alias("recall"), vec.tie_recall(F.col("dists"), F.col("td"), K).alias("tie_recall"))


@query(f"""with a as (select vec_id, embedding from embeddings where vec_id % 5 = 0), b as (select vec_id, embedding from embeddings where vec_id % 5 = 4)
select a.vec_id, min({dist('a.embedding', 'b.embedding')}) as sqdist from a, b group by 1""")
def set_distance(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    return knn.set_distance(v.where("vec_id % 5 = 0"), v.where("vec_id % 5 = 4"))


# --- effort --------------------------------------------------------------------------------------------------------


@query("""with recursive g(i, ef) as (select 0::bigint, 10::bigint union all
select i + 1, least(4096, greatest(ef + 1, floor(ef * 1.05::double + 0.5)::bigint)) from g where ef < 4096) select i, ef from g""")
def ef_grid(spark, d):
    return effort.grid_table(spark, 10, 4096, 1.05)


@query(TO_CURVE + " select query_id, ef, hits, dc from curve")
def ivf_effort_curve(spark, d):
    return base_curve(spark, d).withColumn("ef", F.col("ef").cast("bigint"))


@query(TO_CURVE + """ select ef, sum(hits) / (count(*) * 10.0::double) as mean_recall, quantile_cont(hits / 10.0::double, 0.05) as p05_recall,
count(case when hits / 10.0::double < 0.9 then 1 end) / count(*)::double as below_90, sum(dc) / count(*)::double as mean_dc from curve group by 1""")
def sweep_summary(spark, d):
    return effort.sweep_summary(base_curve(spark, d), K)


@query(TO_FIXED + " select ef, mean_recall, mean_dc, failure_rate from fixed")
def fixed_curve(spark, d):
    return effort.fixed_curve(base_curve(spark, d), K)


@query(TO_LABELS + " select query_id, reached, oracle_ef, first_ef, oracle_dc from labels")
def oracle_labels(spark, d):
    return effort.oracle_labels(base_curve(spark, d), K)


@query(TO_LABELS + """, c as (select oracle_ef, count(*) as n from labels where reached group by 1)
select (select count(*) from labels where reached) as n, (select count(*) from labels where not reached) as censored,
quantile_cont(oracle_ef::double, 0.1) as p10, quantile_cont(oracle_ef::double, 0.5) as p50, quantile_cont(oracle_ef::double, 0.9) as p90, quantile_cont(oracle_ef::double, 0.99) as p99, max(oracle_ef) as max_ef,
count(distinct oracle_ef) as distinct_ef, (select arg_min(n, oracle_ef) from c) / count(*)::double as floor_share, (select max(n) from c) / count(*)::double as mode_share from labels where reached""")
def oracle_distribution(spark, d):
    return effort.ef_distribution(effort.oracle_labels(base_curve(spark, d), K))


@query(" union all ".join(f"select * from ({TO_CURVE}, s as (select *, min(case when hits >= {h} then 1 else 0 end) over (partition by query_id order by ef rows between current row and unbounded following) as ok from curve), "
                          f"l as (select query_id, min(case when ok = 1 then ef end) as e from s group by 1) select {h / 10}::double as target, count(e) as reached, avg(e) as mean_ef, count(distinct e) as distinct_ef from l)" for h in (8, 9, 10)))
def label_sensitivity(spark, d):
    return effort.sensitivity(base_curve(spark, d), K, (0.8, 0.9, 1.0))


THRESHOLDS = """,
cdf as (select ef, (select count(*) from labels where reached and oracle_ef <= g.ef) / (select count(*) from labels where reached)::double as cdf from (select distinct ef from curve) g),
thr as (select share, min(ef) as ef from (values (0.25::double), (0.75::double), (0.99::double)) s(share), cdf where cdf >= share - 1e-12 group by 1)"""


@query(TO_LABELS + THRESHOLDS + " select share, ef from thr")
def tier_thresholds(spark, d):
    c = base_curve(spark, d)
    return effort.grid_quantile(effort.oracle_labels(c, K), c.select("ef").distinct(), 0.25, 0.75, 0.99)


STRATA = THRESHOLDS + """,
lim as (select max(case when share = 0.25 then ef end) as lo, max(case when share = 0.75 then ef end) as mi, max(case when share = 0.99 then ef end) as hi from thr),
strata as (select query_id, case when oracle_ef <= lo then 'low' when oracle_ef <= mi then 'mid' else 'high' end as tier, coalesce(oracle_ef > hi, true) as exceeds, not reached as censored from labels, lim)"""


def strata_of(spark, d):
    c = base_curve(spark, d)
    labels = effort.oracle_labels(c, K)
    t = effort.grid_quantile(labels, c.select("ef").distinct(), 0.25, 0.75, 0.99)
    lim = {round(r["share"], 2): r["ef"] for r in t.collect()}
    return c, labels, lim, effort.tiers(labels, lim[0.25], lim[0.75], lim[0.99])


@query(TO_LABELS + STRATA + " select query_id, tier, exceeds, censored from strata")
def strata(spark, d):
    return strata_of(spark, d)[3]


# --- features ------------------------------------------------------------------------------------------------------

FEATURES = """,
lists as (select query_id, list(sqdist order by rk) as ds from knn group by 1),
feat as (select query_id, sqrt(ds[10]) as knn_dist, case when ds[10] = 0 then 1.0::double else sqrt(ds[1]) / sqrt(ds[10]) end as concentration,
  case when ds[1] = 0 then 0.0::double else -9.0::double / list_sum(list_transform(range(1, 10), lambda i: ln(sqrt(ds[i]) / sqrt(ds[10])))) end as lid from lists)"""
CENTROID = """,
mu as (select i, avg(embedding[i]::double) as m from base, range(1, 65) t(i) group by 1),
mul as (select list(m order by i) as mu from mu),
cent as (select query_id, sqrt(list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::double - mu[i]) * (embedding[i]::double - mu[i])))) as centroid_dist from q, mul)"""


def features_of(spark, d):
    base, queries, _ = parts(spark, d)
    near = knn.as_lists(knn.exact_knn(base, queries, K))
    centre = vec.centroid_columns(base)
    far = queries.crossJoin(F.broadcast(centre)).select("query_id", F.sqrt(vec.squared_distance(F.col("embedding"), F.col("centroid"))).alias("centroid_dist"))
    return near.join(far, "query_id").select("query_id", vec.knn_distance(F.col("dists"), K).alias("knn_dist"), vec.concentration(F.col("dists"), K).alias("concentration"),
                                             vec.local_dimension(F.col("dists"), K).alias("lid"), "centroid_dist")


@query("with " + VECTORS + KNN + FEATURES + CENTROID + " select query_id, round(knn_dist, 9) as knn_dist, round(concentration, 9) as concentration, round(lid, 6) as lid, round(centroid_dist, 9) as centroid_dist from feat join cent using (query_id)")
def query_features(spark, d):
    f = features_of(spark, d)
    return f.select("query_id", *[F.round(c, n).alias(c) for c, n in (("knn_dist", 9), ("concentration", 9), ("lid", 6), ("centroid_dist", 9))])


@query("with " + VECTORS + KNN + CELL + CURVE + LABELS + FEATURES + """,
j as (select knn_dist, coalesce(oracle_ef::double, 'infinity'::double) as e from feat join labels using (query_id)),
r as (select rank() over (order by knn_dist) + (count(*) over (partition by knn_dist) - 1) / 2.0::double as x, rank() over (order by e) + (count(*) over (partition by e) - 1) / 2.0::double as y from j)
select round(corr(x, y), 9) as rho from r""")
def feature_effort_spearman(spark, d):
    labels = effort.oracle_labels(base_curve(spark, d), K).select("query_id", F.coalesce(F.col("oracle_ef").cast("double"), F.lit(float("inf"))).alias("e"))
    return stats.spearman(features_of(spark, d).join(labels, "query_id"), "knn_dist", "e").select(F.round("rho", 9).alias("rho"))


def ks_statistic(df, value, side):
    """The largest distance of two empirical distribution functions (side is a boolean column), ties taken together."""
    at = df.groupBy(value).agg(F.count(F.when(side, 1)).alias("a"), F.count(F.when(~side, 1)).alias("b"))
    run = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    n = df.agg(F.count(F.when(side, 1)).alias("na"), F.count(F.when(~side, 1)).alias("nb"))
    both = at.select(F.sum("a").over(run).alias("ca"), F.sum("b").over(run).alias("cb")).crossJoin(F.broadcast(n))
    return both.agg(F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))).alias("d"), F.max("na").alias("n_test"), F.max("nb").alias("n_train"))


@query("with " + VECTORS + KNN + FEATURES + f""",
s as (select knn_dist, not ({TRAIN}) as t from feat), n as (select count(*) filter (t) as na, count(*) filter (not t) as nb from s),
c as (select (select count(*) from s b where b.t and b.knn_dist <= a.knn_dist) / na::double as fa, (select count(*) from s b where not b.t and b.knn_dist <= a.knn_dist) / nb::double as fb from s a, n)
select round(max(abs(fa - fb)), 9) as d, (select na from n) as n_test, (select nb from n) as n_train from c""")
def ks_shift(spark, d):
    return ks_statistic(features_of(spark, d), "knn_dist", is_test()).withColumn("d", F.round("d", 9))


# --- policies ------------------------------------------------------------------------------------------------------


@query(TO_CURVE + " select query_id, ef, hits, dc from curve where ef = 12")
def fixed_policy(spark, d):
    return effort.fixed_policy(base_curve(spark, d), 12)


@query(TO_FIXED + " select recall, (select min(ef) from fixed where mean_recall >= recall - 1e-9) as ef from (values (0.5::double), (0.8::double), (0.95::double), (1.0::double)) t(recall)")
def matched_fixed(spark, d):
    fixed = effort.fixed_curve(base_curve(spark, d), K)
    want = spark.createDataFrame([(r,) for r in (0.5, 0.8, 0.95, 1.0)], "recall double")
    return want.join(fixed, F.col("mean_recall") >= F.col("recall") - effort.SLACK, "left").groupBy("recall").agg(F.min("ef").alias("ef"))


INTERP = """,
st as (select *, lag(mean_recall) over (order by ef) as pr, lag(mean_dc) over (order by ef) as pd from fixed),
want(recall) as (values (0.5::double), (0.8::double), (0.95::double), (1.1::double)),
fst as (select recall, min(ef) as ef from want, st where mean_recall >= recall - 1e-9 group by 1)"""


@query(TO_FIXED + INTERP + """ select w.recall, round(case when f.ef is null then 'infinity'::double when pr is null then mean_dc when mean_recall = pr then pd else pd + (w.recall - pr) / (mean_recall - pr) * (mean_dc - pd) end, 9) as cost
from want w left join fst f using (recall) left join st on st.ef = f.ef""")
def interp_cost(spark, d):
    want = spark.createDataFrame([(r,) for r in (0.5, 0.8, 0.95, 1.1)], "recall double")
    return effort.interpolated_cost(effort.fixed_curve(base_curve(spark, d), K), want).withColumn("cost", F.round("cost", 9))


@query(TO_CURVE + LABELS + FIXED + """,
o as (select sum(c.hits) / (count(*) * 10.0::double) as recall, sum(c.dc) / count(*)::double as cost from labels l join curve c on c.query_id = l.query_id and c.ef = l.oracle_ef)
select recall as oracle_recall, cost as oracle_cost, (select min(ef) from fixed, o where mean_recall >= recall - 1e-9) as fixed_ef, (select max(mean_recall) from fixed, o where mean_dc <= cost) as best_fixed_recall from o""")
def matched_recall(spark, d):
    c = base_curve(spark, d)
    fixed = effort.fixed_curve(c, K)
    at = effort.lookup(c, effort.oracle_labels(c, K).where("reached").select("query_id", F.col("oracle_ef").alias("ef")))
    o = at.agg((F.sum("hits") / (F.count("*") * F.lit(float(K)))).alias("oracle_recall"), (F.sum("dc") / F.count("*")).alias("oracle_cost"))
    return fixed.crossJoin(F.broadcast(o)).groupBy("oracle_recall", "oracle_cost").agg(F.min(F.when(F.col("mean_recall") >= F.col("oracle_recall") - effort.SLACK, F.col("ef"))).alias("fixed_ef"),
                                                                                     F.max(F.when(F.col("mean_dc") <= F.col("oracle_cost"), F.col("mean_recall"))).alias("best_fixed_recall"))


def train_mix(spark, d):
    c = base_curve(spark, d)
    return c, effort.two_effort_mix(effort.fixed_curve(c.where(~is_test()), K), 0.95)


@query(TO_MIX + " select ef_lo, ef_hi, round(w_hi, 12) as w_hi from mix")
def two_ef_mix(spark, d):
    return train_mix(spark, d)[1].withColumn("w_hi", F.round("w_hi", 12))


@query(TO_MIX + _uniform_sql("q") + " select query_id, round(u, 12) as u, case when u < w_hi then ef_hi else ef_lo end as ef from uni, mix")
def mix_assignment(spark, d):
    _, queries, _ = parts(spark, d)
    u = rng.uniform(F.col("query_id"), "sift_query", 20261006)
    drawn = queries.select("query_id").withColumn("u", u)
    return effort.assign_mix(drawn, train_mix(spark, d)[1], F.col("u")).join(drawn, "query_id").select("query_id", F.round("u", 12).alias("u"), "ef")


# a router that looks at the label of the nearest neighbour's parity: a fixed rule, so that routing can be checked by itself
PREDICTED = """,
pred as (select query_id, case query_id // 5 % 3 when 0 then 'low' when 1 then 'mid' else 'high' end as tier from q),
routed as (select p.query_id, p.tier, c.ef, c.hits, c.dc, 20::bigint as probe_dc, c.dc + 20 as total_dc, c.hits < 10 as failure from pred p join curve c on c.query_id = p.query_id and c.ef = case tier when 'low' then 6 when 'mid' then 12 else 20 end)"""
TIER_EFS = {"low": 6, "mid": 12, "high": 20}


def predicted(queries):
    part = (F.col("query_id") / 5).cast("bigint") % 3
    return queries.select("query_id", F.when(part == 0, "low").when(part == 1, "mid").otherwise("high").alias("tier"))


def routed_of(spark, d):
    _, queries, _ = parts(spark, d)
    c = base_curve(spark, d)
    return c, effort.tier_route(c, predicted(queries), TIER_EFS, F.lit(CELLS).cast("bigint"), K)


@query(TO_CURVE + PREDICTED + " select query_id, tier, ef, hits, dc, probe_dc, total_dc, failure from routed")
def tier_route(spark, d):
    return routed_of(spark, d)[1]


@query(TO_LABELS + PREDICTED + " select query_id, total_dc - oracle_dc as regret_total, dc - oracle_dc as regret_search from routed left join labels using (query_id)")
def regret(spark, d):
    c, routed = routed_of(spark, d)
    return effort.regret(routed, effort.oracle_labels(c, K)).select("query_id", "regret_total", "regret_search")


PAIRS = STRATA + PREDICTED + ", pt as (select query_id, s.tier as truth, p.tier as predicted from strata s join pred p using (query_id))"


@query(TO_LABELS + PAIRS + """ select t.truth, count(*) filter (predicted = 'low') as low, count(*) filter (predicted = 'mid') as mid, count(*) filter (predicted = 'high') as high
from (values ('low'), ('mid'), ('high')) t(truth) left join pt using (truth) group by 1""")
def confusion(spark, d):
    _, _, _, tier = strata_of(spark, d)
    _, queries, _ = parts(spark, d)
    return effort.confusion(tier.select("query_id", F.col("tier").alias("truth")).join(predicted(queries).withColumnRenamed("tier", "predicted"), "query_id"), ("low", "mid", "high"))


@query(TO_LABELS + PAIRS + """ select truth, predicted, count(*) as n, sum(p.dc - t.dc) / count(*)::double as extra_dc, sum(t.hits - p.hits) / (count(*) * 10.0::double) as recall_lost
from pt join curve p on p.query_id = pt.query_id and p.ef = case predicted when 'low' then 6 when 'mid' then 12 else 20 end
join curve t on t.query_id = pt.query_id and t.ef = case truth when 'low' then 6 when 'mid' then 12 else 20 end group by 1, 2""")
def error_prices(spark, d):
    c, _, _, tier = strata_of(spark, d)
    _, queries, _ = parts(spark, d)
    both = tier.select("query_id", F.col("tier").alias("truth")).join(predicted(queries).withColumnRenamed("tier", "predicted"), "query_id")
    return effort.error_prices(c, both, TIER_EFS, K)


# --- candidates and allocation -------------------------------------------------------------------------------------

LADDER = (1, 2, 4, 8, 16, 20)
CANDS = ", ladder(j, ef) as (values " + ", ".join(f"({j}::bigint, {e}::bigint)" for j, e in enumerate(LADDER)) + """),
cand as (select query_id, j, ef, hits >= 10 as success, hits, dc as cost from curve join ladder using (ef)),
cs as (select *, min(success::int) over (partition by query_id order by j rows between current row and unbounded following) as s from cand),
co as (select query_id, coalesce(min(case when s = 1 then j end), 6) as y from cs group by 1)"""


def cands_of(spark, d):
    return effort.candidates(base_curve(spark, d), list(LADDER), K)


@query(TO_CURVE + CANDS + " select query_id, y from co")
def candidate_oracle(spark, d):
    return effort.candidate_oracle(cands_of(spark, d), len(LADDER))


CONTRACT = """,
each as (select query_id, min(cost) as fail, min(case when s = 1 then cost end) as win from cs group by 1),
rk as (select *, row_number() over (order by win - fail nulls last, query_id) as r, count(*) over () as n, count(win) over () as able from each)"""


@query(TO_CURVE + CANDS + CONTRACT + """ select any_value(able) >= ceil(0.9::double * any_value(n) - 1e-9) as feasible,
sum(case when r <= ceil(0.9::double * n - 1e-9) then win else fail end) / any_value(n)::double as mean_cost, ceil(0.9::double * any_value(n) - 1e-9) / any_value(n)::double as success_rate, any_value(able) / any_value(n)::double as achievable_rate from rk""")
def contract_oracle(spark, d):
    return effort.contract_oracle(cands_of(spark, d), 0.9)


# probabilities by a fixed formula of the candidate's own hits, so that the rules on them can be checked by themselves
PROBS = ", prob as (select query_id, j, hits / 10.0::double * (0.9::double + (query_id % 7) / 70.0::double) as p, success from cand), run as (select *, max(p) over (partition by query_id order by j rows between unbounded preceding and current row) as cm from prob)"


def probs_of(cands):
    return cands.select("query_id", "j", (F.col("hits") / F.lit(10.0) * (F.lit(0.9) + F.col("query_id") % 7 / F.lit(70.0))).alias("p"))


@query(TO_CURVE + CANDS + PROBS + " select query_id, coalesce(min(case when cm >= 0.9::double - 1e-12 then j end), max(j)) as choice, min(case when cm >= 0.9::double - 1e-12 then j end) is null as fallback from run group by 1")
def cummax_choice(spark, d):
    return effort.choose(probs_of(cands_of(spark, d)), 0.9)


@query(TO_CURVE + CANDS + PROBS + """,
taus as (select t, t / 1000.0::double as tau from range(0, 1001) r(t)),
ch as (select t, query_id, coalesce(min(case when cm >= tau - 1e-12 then j end), 5) as j from taus, run group by 1, 2),
qual as (select t, count(*) filter (success) / count(*)::double as quality from ch join cand using (query_id, j) group by 1)
select t / 1000.0::double as tau, quality from qual where quality >= 0.8::double - 1e-9 order by t limit 1""")
def calibrate_tau(spark, d):
    c = cands_of(spark, d)
    return effort.calibrate_tau(probs_of(c), c.select("query_id", "j", F.col("success").cast("double").alias("q")), 0.8).where("tau is not null")


@query(TO_CURVE + CANDS + " select query_id, j, hits, cost from (select *, row_number() over (partition by query_id order by cost - 300.0::double * (hits / 10.0::double), j) as r from cand) where r = 1")
def priced_choice(spark, d):
    return effort.priced_choice(cands_of(spark, d), 300.0, K)


# every price at which some query is indifferent between two candidates, as a fraction, so that each choice is made in integers
@query(TO_CURVE + CANDS + """,
pr as (select distinct num // gcd(num, den) as num, den // gcd(num, den) as den from (select b.cost - a.cost as num, b.hits - a.hits as den from cand a join cand b on b.query_id = a.query_id and b.hits > a.hits and b.cost > a.cost) union select 0, 1),
ch as (select num, den, query_id, arg_max(struct_pack(hits := hits, cost := cost), struct_pack(v := num * hits - cost * den, h := hits, c := -cost)) as b from pr, cand group by 1, 2, 3),
priced as (select num * 10 / den::double as price, sum(b.hits) / (count(*) * 10.0::double) as recall, sum(b.cost) / count(*)::double as cost from ch group by num, den)
select target, round(price, 9) as price, recall, cost from (select target, price, recall, cost, row_number() over (partition by target order by price) as r from (values (0.8::double), (0.95::double)) t(target), priced where recall >= target - 1e-9) where r = 1""")
def lagrange_allocation(spark, d):
    c = cands_of(spark, d).persist()
    got = [(t, effort.lagrangian(c, K, t)) for t in (0.8, 0.95)]
    c.unpersist()
    return spark.createDataFrame([(t, r["price"], r["recall"], r["cost"]) for t, r in got if r], "target double, price double, recall double, cost double").withColumn("price", F.round("price", 9))


@query(TO_CURVE + CANDS + PROBS + """,
ch as (select query_id, coalesce(min(case when cm >= 0.9::double - 1e-12 then j end), max(j)) as j, min(case when cm >= 0.9::double - 1e-12 then j end) is null as fallback from run group by 1),
m as (select ch.*, c.success, c.cost, co.y, b.cost as best from ch join cand c using (query_id, j) join co using (query_id) join cand b on b.query_id = ch.query_id and b.j = least(co.y, 5))
select count(*) filter (success) / count(*)::double as success_rate, count(*) filter (not success) / count(*)::double as failure_rate, sum(cost) / count(*)::double as mean_total_cost, median(cost)::double as median_total_cost,
sum(cost) / count(*)::double as mean_search_cost, count(*) filter (fallback) / count(*)::double as fallback_rate, count(*) filter (not success and y < 6) / count(*)::double as avoidable_failure_rate,
count(*) filter (not success and y >= 6) / count(*)::double as unavoidable_failure_rate, coalesce((sum(cost - best) filter (success and y < 6)) / (count(*) filter (success and y < 6))::double, 0) as overspend_on_successes,
coalesce((sum(best - cost) filter (not success and y < 6)) / (count(*) filter (not success and y < 6))::double, 0) as underspend_on_avoidable_failures from m""")
def policy_metrics(spark, d):
    c = cands_of(spark, d)
    return effort.policy_metrics(effort.choose(probs_of(c), 0.9), c, effort.candidate_oracle(c, len(LADDER)), len(LADDER))


# --- evolution -----------------------------------------------------------------------------------------------------


@query("""with doc as (select doc_id, text from documents where text not in (select text from benchmark where text is not null))
select doc_id from (select doc_id, row_number() over (partition by text order by doc_id) as r from doc) where r = 1""")
def dedup_population(spark, d):
    docs, bench = read(spark, d, "documents").select("doc_id", "text").where("text is not null"), read(spark, d, "benchmark").select("text")
    return evolve.insertion_pool(docs, bench, "text", "doc_id").select("doc_id")


@query("with " + VECTORS + """, n0 as (select count(*) as n0 from base),
ins as (select 'id' as kind, vec_id, row_number() over (order by md5('id:' || vec_id), vec_id) as pos from pool union all
        select 'del', vec_id, row_number() over (order by md5('del:' || vec_id), vec_id) from base)
select kind || '_' || pct as state, pos, vec_id from ins, n0, (values (1), (2), (4), (8)) p(pct) where pos <= n0 * pct // 100""")
def nested_states(spark, d):
    base, _, pool = parts(spark, d)
    n0 = base.count()
    orders = evolve.hash_order(pool, "id").withColumn("kind", F.lit("id")).unionByName(evolve.hash_order(base, "del").withColumn("kind", F.lit("del")))
    sizes = spark.createDataFrame([(p, evolve.prefix(n0, p)) for p in (1, 2, 4, 8)], "pct int, c bigint")
    return orders.join(F.broadcast(sizes), F.col("pos") <= F.col("c")).select(F.concat_ws("_", "kind", "pct").alias("state"), "pos", "vec_id")


@query("with " + VECTORS + f""", n0 as (select count(*) as n0 from base),
a as (select embedding as ae from pool order by md5('anchor:' || vec_id), vec_id limit 1),
nr as (select vec_id, row_number() over (order by {dist('embedding', 'ae')}, vec_id) as near, row_number() over (order by md5('id:' || vec_id), vec_id) as own from pool, a),
rings as (select *, case when near <= n0 * 1 // 100 then 0 when near <= n0 * 2 // 100 then 1 when near <= n0 * 4 // 100 then 2 else 3 end as ring from nr, n0 where near <= n0 * 8 // 100)
select vec_id, row_number() over (order by ring, own) as pos from rings""")
def regional_order(spark, d):
    base, _, pool = parts(spark, d)
    n0 = base.count()
    return evolve.regional_order(pool, [evolve.prefix(n0, p) for p in (1, 2, 4, 8)])


def by_state(spark, d, which: int):
    """Of every state its exact neighbours (which = 0) or its effort curve (1)."""
    return states_of(spark, d, which)[which]


def states_of(spark, d, last: int = 1):
    """(neighbours, curves), each by state; without curves if `last` is 0."""
    return [{s: every.where(F.col("state") == s).drop("state") for s in STATES} for every in all_states(spark, d, last)]


def all_states(spark, d, last: int = 1):
    """(neighbours, curves) with their state: one table of all states each, written once; without curves if `last` is 0."""
    base, queries, pool = parts(spark, d)
    n0 = base.count()
    truth = spooled(evolve.state_truths(base, pool, queries, list(STATES), K, n0), "truths")
    return [truth, spooled(evolve.state_curves(base, pool, queries, list(STATES), CELLS, truth, n0), "curves")] if last else [truth]


def stacked(frames):
    """One table of all states, each named in a column."""
    out = None
    for s, f in frames.items():
        f = f.select(F.lit(s).alias("state"), "*")
        out = f if out is None else out.unionByName(f)
    return out


@query("with " + VECTORS + STATE + """ select s.state, q.query_id, count(a.vec_id) as overlap, 1 - count(a.vec_id) / 10.0::double as decay
from states s cross join q left join (select a.state, a.query_id, a.vec_id from knn_s a join knn_s b on b.state = 'S0' and b.query_id = a.query_id and b.vec_id = a.vec_id) a on a.state = s.state and a.query_id = q.query_id
where s.state <> 'S0' group by 1, 2""")
def overlap_decay(spark, d):
    truth = by_state(spark, d, 0)
    return stacked({s: evolve.overlap(truth[s], truth["S0"], K) for s in STATES[1:]})


@query("with " + VECTORS + STATE + """ select a.state, a.query_id, round((sqrt(a.sqdist) - sqrt(b.sqdist)) / sqrt(b.sqdist), 9) as drift
from knn_s a join knn_s b on b.state = 'S0' and b.query_id = a.query_id and b.rk = 10 where a.rk = 10 and a.state <> 'S0'""")
def density_drift(spark, d):
    truth = by_state(spark, d, 0)
    return stacked({s: evolve.density_drift(truth[s], truth["S0"], K) for s in STATES[1:]}).withColumn("drift", F.round("drift", 9))


@query("with " + VECTORS + """, n0 as (select count(*) as n0 from base),
ins as (select embedding from pool join (select vec_id, row_number() over (order by md5('id:' || vec_id), vec_id) as pos from pool) using (vec_id), n0 where pos <= n0 * 8 // 100),
a as (select i, avg(embedding[i]::double) as m from ins, range(1, 65) t(i) group by 1), b as (select i, avg(embedding[i]::double) as m, var_samp(embedding[i]::double) as s from base, range(1, 65) t(i) group by 1)
select round(sqrt(sum((a.m - b.m) * (a.m - b.m))) / sqrt(sum(s)), 9) as drift from a join b using (i)""")
def distribution_drift(spark, d):
    base, _, pool = parts(spark, d)
    new = pool.join(evolve.hash_order(pool, "id").where(F.col("pos") <= evolve.prefix(base.count(), 8)).select("vec_id"), "vec_id", "left_semi")
    return evolve.distribution_drift(new, base).select(F.round("drift", 9).alias("drift"))


# --- panels --------------------------------------------------------------------------------------------------------


def panel_of(spark, d):
    """Frozen mix, state-local mix and a fixed effort, for the test queries of every state."""
    curves = all_states(spark, d)[1]
    _, queries, _ = parts(spark, d)
    test = queries.select("query_id").where(is_test())
    mixes = effort.two_effort_mix(effort.fixed_curve(curves.where(~is_test()), K, 1.0, "state"), 0.95, "state")
    states = spark.createDataFrame([(s,) for s in STATES], "state string")
    frozen = states.crossJoin(F.broadcast(mixes.where("state = 'S0'").drop("state")))
    mixed = frozen.select(F.lit("frozen").alias("policy"), "*").unionByName(mixes.select(F.lit("local").alias("policy"), "*"))
    each = test.crossJoin(F.broadcast(states.withColumn("policy", F.explode(F.array(F.lit("frozen"), F.lit("local"), F.lit("fixed"))))))
    u = rng.uniform(F.col("query_id"), "sift_query", 20261006)
    assigned = effort.assign_mix(each, mixed, u, "policy", "state").unionByName(each.where("policy = 'fixed'").withColumn("ef", F.lit(14).cast("bigint")))
    return effort.lookup(curves, assigned, "state").select("policy", F.lit(42).alias("seed"), "state", "query_id", F.col("dc").alias("cost"), "hits")


def kept_panel(spark, d):
    """The panel, written once for plans that read it several times."""
    return spooled(panel_of(spark, d), "panel")


PANEL = f""",
fx as (select state, ef, sum(hits) / (count(*) * 10.0::double) as mean_recall from curve_s where {TRAIN} group by 1, 2),
sx as (select *, lag(ef) over w as pe, lag(mean_recall) over w as pr from fx window w as (partition by state order by ef)),
hx as (select * from (select *, row_number() over (partition by state order by ef) as r from sx where mean_recall >= 0.95::double - 1e-12) where r = 1),
mixes as (select state, case when pe is null or abs(mean_recall - 0.95::double) < 1e-15 then ef else pe end as ef_lo, ef as ef_hi,
          case when pe is null or abs(mean_recall - 0.95::double) < 1e-15 then 1.0::double else (0.95::double - pr) / (mean_recall - pr) end as w_hi from hx),
test as (select * from q where not ({TRAIN}))""" + _uniform_sql("test") + """,
assigned as (
  select 'frozen' as policy, s.state, query_id, case when u < w_hi then ef_hi else ef_lo end as ef from states s, uni, mixes m where m.state = 'S0'
  union all select 'local', m.state, query_id, case when u < w_hi then ef_hi else ef_lo end from uni, mixes m
  union all select 'fixed', s.state, query_id, 14 from states s, test),
panel as (select policy, 42 as seed, state, query_id, dc as cost, hits from assigned join curve_s using (state, query_id, ef))"""
TO_PANEL = "with " + VECTORS + STATE + PANEL


@query(TO_PANEL + " select policy, seed, state, query_id, cost, hits from panel")
def validity_panel(spark, d):
    return panel_of(spark, d)


DRIFT = """,
m as (select policy, seed, state, sum(cost) / count(*)::double as cost from panel group by 1, 2, 3),
ra as (select a.policy, a.seed, a.state, a.cost / b.cost as ratio from m a join m b on b.policy = 'local' and b.seed = a.seed and b.state = a.state where a.policy <> 'local'),
dr as (select a.policy, a.seed, a.state, a.ratio / b.ratio - 1 as drift from ra a join ra b on b.policy = a.policy and b.seed = a.seed and b.state = 'S0')"""


@query(TO_PANEL + DRIFT + " select policy, seed, state, round(drift, 9) as drift from dr")
def cost_drift(spark, d):
    return validity.cost_drift(kept_panel(spark, d), "local").withColumn("drift", F.round("drift", 9))


@query(TO_PANEL + """ select a.policy, a.seed, a.state, count(*) filter (b.hits >= 10 and a.hits >= 10) as stable_pass, count(*) filter (b.hits >= 10 and a.hits < 10) as newly_failing,
count(*) filter (b.hits < 10 and a.hits < 10) as stable_fail, count(*) filter (b.hits < 10 and a.hits >= 10) as improved,
(count(*) filter (b.hits >= 10 and a.hits < 10)) / nullif((count(*) filter (b.hits >= 10))::double, 0) as newly_failing_rate
from panel a join panel b on b.policy = a.policy and b.seed = a.seed and b.query_id = a.query_id and b.state = 'S0' group by 1, 2, 3""")
def contract_transitions(spark, d):
    return validity.contract_transitions(kept_panel(spark, d), K)


VERDICT = ", vd as (select *, case when lo >= -0.1::double and hi <= 0.1::double then 'STABLE' when lo > 0.1::double then 'STALE-COSTLIER' when hi < -0.1::double then 'STALE-CHEAPER' else 'INCONCLUSIVE' end as verdict from (select policy, state, drift - 0.02::double as lo, drift + 0.02::double as hi from dr))"


def verdicts_of(spark, d):
    v = validity.cost_drift(kept_panel(spark, d), "local")
    return v.withColumn("verdict", stats.cost_verdict(F.col("drift") - 0.02, F.col("drift") + 0.02))


@query(TO_PANEL + DRIFT + VERDICT + " select policy, state, verdict from vd")
def verdicts(spark, d):
    return verdicts_of(spark, d).select("policy", "state", "verdict")


@query(TO_PANEL + DRIFT + VERDICT + " select policy, case when bool_and(verdict = 'STABLE') then 'STABLE-FAMILY' when bool_or(starts_with(verdict, 'STALE')) then 'STALE-FAMILY' else 'INCONCLUSIVE-FAMILY' end as verdict from vd group by 1")
def family_verdict(spark, d):
    return verdicts_of(spark, d).groupBy("policy").agg(stats.family_verdict(F.col("verdict")).alias("verdict"))


@query(TO_PANEL + """, ex(policy, seed, state) as (select p, 42, state from (values ('frozen'), ('local'), ('fixed')) t(p), states),
cl as (select distinct policy, seed, state from panel), ids as (select distinct query_id from panel)
select 'repeated' as rule, count(*) as n from (select 1 from panel group by policy, seed, state, query_id having count(*) > 1)
union all select 'null', count(*) from panel where cost is null or hits is null union all select 'hits_range', count(*) from panel where hits < 0 or hits > 10
union all select 'cost_positive', count(*) from panel where cost <= 0 union all select 'missing_cell', count(*) from (select * from ex except select * from cl)
union all select 'extra_cell', count(*) from (select * from cl except select * from ex)
union all select 'missing_query', count(*) from (select policy, seed, state, query_id from cl, ids except select policy, seed, state, query_id from panel)""")
def panel_validation(spark, d):
    expected = spark.createDataFrame([(p, 42, s) for p in ("frozen", "local", "fixed") for s in STATES], "policy string, seed int, state string")
    return validity.violations(kept_panel(spark, d), K, expected)


# draws by hash in place of the seeded generator, so that the SQL can follow; replicate -1 is the panel itself
@query(TO_PANEL + """,
ids as (select query_id, row_number() over (order by query_id) - 1 as pos, count(*) over () as n from (select distinct query_id from panel)), nq as (select max(n) as n from ids),
wt as (select r, query_id, count(*)::double as w from (select r, ('0x' || substr(md5(r || ':' || s), 1, 8))::bigint % n as pos from range(0, 200) a(r), nq, range(0, nq.n) b(s)) join ids using (pos) group by 1, 2 union all select -1, query_id, 1.0::double from ids),
co as (select r, policy, state, sum(w * cost) as c from panel join wt using (query_id) group by 1, 2, 3),
ra as (select a.r, a.policy, a.state, a.c / b.c as x from co a join co b on b.r = a.r and b.policy = 'local' and b.state = a.state where a.policy <> 'local'),
cd as (select a.r, a.policy, a.state, a.x / b.x - 1 as x from ra a join ra b on b.r = a.r and b.policy = a.policy and b.state = 'S0' where a.state <> 'S0'),
coh as (select a.policy, a.query_id from panel a join panel b on b.policy = 'local' and b.state = 'S0' and b.query_id = a.query_id where a.state = 'S0' and a.policy <> 'local' and a.hits >= 10 and b.hits >= 10),
nf as (select r, h.policy, t.state, coalesce(sum(w * ((a.hits < 10)::int - (b.hits < 10)::int)), 0) / greatest(coalesce(sum(w), 0), 1e-300) as x from (select distinct policy from panel where policy <> 'local') h, (select distinct state from panel where state <> 'S0') t, wt
  left join coh on coh.policy = h.policy and coh.query_id = wt.query_id left join panel a on a.policy = h.policy and a.state = t.state and a.query_id = coh.query_id left join panel b on b.policy = 'local' and b.state = t.state and b.query_id = coh.query_id where coh.query_id is not null group by 1, 2, 3),
dq as (select policy, state, 'cost' as q, r, x from cd union all select policy, state, 'contract', r, x from nf),
iv as (select policy, state, q, max(x) filter (r = -1) as d, quantile_cont(x, 0.025) filter (r >= 0) as lo, quantile_cont(x, 0.975) filter (r >= 0) as hi from dq group by 1, 2, 3)
select c.policy, c.state, round(c.d, 9) as cost_drift, round(c.lo, 9) as cost_lo, round(c.hi, 9) as cost_hi, round(k.d, 9) as contract_drift, round(k.lo, 9) as contract_lo, round(k.hi, 9) as contract_hi,
case when c.lo >= -0.1::double and c.hi <= 0.1::double then 'STABLE' when c.lo > 0.1::double then 'STALE-COSTLIER' when c.hi < -0.1::double then 'STALE-CHEAPER' else 'INCONCLUSIVE' end as cost_verdict, case when k.lo >= -0.05::double and k.hi <= 0.05::double then 'STABLE' when k.lo > 0.05::double then 'STALE-WORSE' when k.hi < -0.05::double then 'STALE-BETTER' else 'INCONCLUSIVE' end as contract_verdict
from iv c join iv k on k.policy = c.policy and k.state = c.state and k.q = 'contract' where c.q = 'cost'""")
def validity_report(spark, d):
    panel = kept_panel(spark, d)
    n = panel.select("query_id").distinct().count()
    out = validity.analyse(panel, "local", K, index=stats.hashed_positions(n, 200))
    return out.withColumns({c: F.round(c, 9) for c in ("cost_drift", "cost_lo", "cost_hi", "contract_drift", "contract_lo", "contract_hi")})


# --- statistics ----------------------------------------------------------------------------------------------------

SERIES = """,
ser as (select query_id, row_number() over (order by query_id) - 1 as pos, count(*) over () as n, (dc - oracle_dc)::bigint as x from routed join labels using (query_id) where reached)"""


def series_of(spark, d):
    """(query_id, pos, x): a paired difference for each labelled query."""
    c, routed = routed_of(spark, d)
    r = effort.regret(routed, effort.oracle_labels(c, K)).where("regret_search is not null")
    return r.select("query_id", (F.row_number().over(Window.orderBy("query_id")) - 1).cast("bigint").alias("pos"), F.col("regret_search").alias("x"))


@query(TO_LABELS + PREDICTED + SERIES + """,
n as (select count(*) as n from ser), dw as (select r, s from range(0, 200) a(r), n, range(0, n.n) b(s)),
pk as (select r, ('0x' || substr(md5(r || ':' || s), 1, 8))::bigint % (select n from n) as pos from dw),
rp as (select r, sum(x) / count(*)::double as m from pk join ser using (pos) group by 1)
select round(quantile_cont(m, 0.025), 9) as lo, round(quantile_cont(m, 0.975), 9) as hi, (select sum(x) / count(*)::double from ser) as mean from rp""")
def bootstrap_ci(spark, d):
    s = series_of(spark, d)
    n = s.count()
    reps = stats.hash_resample(s, "query_id", 200, n).groupBy("rep").agg((F.sum("x") / F.count("*")).alias("m"))
    return reps.agg(F.round(F.percentile("m", F.lit(0.025)), 9).alias("lo"), F.round(F.percentile("m", F.lit(0.975)), 9).alias("hi")).crossJoin(s.agg((F.sum("x") / F.count("*")).alias("mean")))


@query("""with p as (select l_returnflag || l_linestatus || l_linenumber as test, round(count(*) / (select count(*) from lineitem)::double, 9) as p from lineitem group by 1),
r as (select *, (count(*) over () - row_number() over (order by p, test) + 1) * p as raw from p),
a as (select test, p, least(1.0::double, max(raw) over (order by p, test rows between unbounded preceding and current row)) as adj from r) select test, p, round(adj, 9) as p_adjusted, adj < 0.05 as rejected from a""")
def holm(spark, d):
    items = read(spark, d, "lineitem")
    n = items.agg(F.count("*").alias("_n"))
    p = items.groupBy(F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("test")).count().crossJoin(F.broadcast(n))
    return stats.holm(p.select("test", F.round(F.col("count") / F.col("_n"), 9).alias("p"))).withColumn("p_adjusted", F.round("p_adjusted", 9))


@query(TO_LABELS + PREDICTED + SERIES + """,
nz as (select x::double as d, abs(x::double) as a from ser where x <> 0), rk as (select d, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0::double as r, count(*) over (partition by a) as t from nz)
select count(*) as n_nonzero, coalesce(sum(case when d > 0 then r end), 0)::double as w_plus, coalesce(sum(case when d < 0 then r end), 0)::double as w_minus, coalesce(sum(t::double * t - 1), 0)::double as ties from rk""")
def wilcoxon_ranks(spark, d):
    return stats.signed_ranks(series_of(spark, d).withColumn("zero", F.lit(0)), "x", "zero")


@query(TO_CURVE + PREDICTED + """ select count(*) filter (r.failure and c.hits >= 10) as only_routed, count(*) filter (not r.failure and c.hits < 10) as only_fixed from routed r join curve c on c.query_id = r.query_id and c.ef = 12""")
def mcnemar_counts(spark, d):
    c, routed = routed_of(spark, d)
    both = routed.select("query_id", "failure").join(effort.fixed_policy(c, 12).select("query_id", (F.col("hits") < K).alias("f")), "query_id")
    return both.agg(F.count(F.when(F.col("failure") & ~F.col("f"), 1)).alias("only_routed"), F.count(F.when(~F.col("failure") & F.col("f"), 1)).alias("only_fixed"))


@query(TO_FIXED + " select round(regr_slope(mean_recall, ln(ef)), 9) as slope from fixed")
def ols_slope(spark, d):
    return effort.fixed_curve(base_curve(spark, d), K).agg(F.round(F.regr_slope("mean_recall", F.ln(F.col("ef").cast("double"))), 9).alias("slope"))


# --- frozen models, applied as expressions -------------------------------------------------------------------------

TREE = {"kind": "tree", "classes": ["high", "low"], "features": ["knn_dist", "lid"], "root": {
    "feature": "knn_dist", "threshold": 1.2, "low": {"p": [0.25, 0.75]}, "high": {"feature": "lid", "threshold": 40.0, "low": {"p": [0.5, 0.5]}, "high": {"p": [0.9, 0.1]}}}}
LOGIT = {"kind": "logistic", "classes": [0, 1], "features": ["knn_dist", "concentration"], "mean": [1.2, 0.95], "scale": [0.02, 0.01], "coef": [[0.7, -0.3]], "intercept": [0.1]}


@query("with " + VECTORS + KNN + FEATURES + """, f as (select query_id, round(knn_dist, 6)::float::double as a, round(lid, 6)::float::double as b from feat)
select query_id, case when a <= 1.2::double then 0.25::double when b <= 40.0::double then 0.5::double else 0.9::double end as p_high, case when a <= 1.2::double then 0 when b <= 40.0::double then 1 else 2 end as leaf from f""")
def tree_inference(spark, d):
    f = features_of(spark, d).select("query_id", F.round("knn_dist", 6).alias("knn_dist"), F.round("lid", 6).alias("lid"))
    return f.select("query_id", models.probability(TREE, "high").alias("p_high"), models.leaf(TREE).alias("leaf"))


@query("with " + VECTORS + KNN + FEATURES + " select query_id, round(1 / (1 + exp(-(0.1::double + (knn_dist - 1.2::double) / 0.02::double * 0.7::double + (concentration - 0.95::double) / 0.01::double * -0.3::double))), 9) as p from feat")
def logistic_inference(spark, d):
    return features_of(spark, d).select("query_id", F.round(models.probability(LOGIT, 1), 9).alias("p"))
