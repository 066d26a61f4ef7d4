"""Hand values and published golden values of the scalar functions, draws and statistics."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.functions import rng, stats
from halyard.functions import vectors as vec


def test_twister_and_shuffle():
    t = rng.Twister()
    assert [t() for _ in range(10000)][-1] == 9981545732273789042
    assert sorted(rng.shuffle(20, 1, 5)) == [1, 7, 10, 14, 17]
    ids = set(rng.shuffle(10000, 20261001, 2000))
    text = "query_id,split\n" + "".join(f"{i},{'test' if i in ids else 'train'}\n" for i in range(10000))
    assert hashlib.sha256(text.encode()).hexdigest() == "e0e3c6faaa56f98367cab0f9baedfb6c8a9ab788543538221d546f0aa8b03802"
    train = ",".join(str(i) for i in range(10000) if i not in ids)
    assert hashlib.sha256(train.encode()).hexdigest() == "7986fe84286449ac65d13df5f5ddc07108aa3cf8c317f4ab954f3866b33ac72c"


def test_hashes():
    assert rng.scramble(0) == 0xE220A8397B1DCDAF
    assert rng.text_hash("") == 1469598103934665603


def test_split_table(spark):
    assert [r[0] for r in rng.split(spark, 20, 5, 1).where("split = 'test'").orderBy("query_id").collect()] == [1, 7, 10, 14, 17]
    with pytest.raises(ValueError):
        rng.split(spark, 5, 5, 1)


def test_vector_expressions(spark):
    row = spark.sql("select array(1.0D, 4.0D, 16.0D) d, array(4.0D, 4.0D) e, array(0.0D, 1.0D) z").select(
        vec.local_dimension(F.col("d"), 3).alias("lid"), vec.local_dimension(F.col("e"), 2).alias("same"), vec.local_dimension(F.col("z"), 2).alias("zero"),
        vec.knn_distance(F.col("d"), 3).alias("k"), vec.concentration(F.col("d"), 3).alias("c"), vec.concentration(F.array(F.lit(0.0), F.lit(0.0)), 2).alias("flat")).first()
    assert row["lid"] == pytest.approx(2 / math.log(8)) and math.isinf(row["same"]) and row["zero"] == 0
    assert (row["k"], row["c"], row["flat"]) == (4.0, 0.25, 1.0)


@pytest.mark.parametrize("dim", [2, 5, 12])
def test_dimension_of_known_data(spark, dim):
    k = 2000
    d = [((i / k) ** (1 / dim)) ** 2 for i in range(1, k + 1)]
    got = spark.createDataFrame([(d,)], "d array<double>").select(vec.local_dimension(F.col("d"), k)).first()[0]
    assert got == pytest.approx(dim, rel=0.05)


def test_recalls(spark):
    row = spark.sql("select array(1L, 2L, 3L) f, array(3L, 9L, 1L) t, array(1.0D, 2.0D, 2.0000001D) fd, array(1.0D, 1.5D, 2.0D) td").select(vec.recall(F.col("f"), F.col("t"), 3).alias("r"), vec.tie_recall(F.col("fd"), F.col("td"), 3).alias("t")).first()
    assert row["r"] == pytest.approx(2 / 3) and row["t"] == 1.0


def test_drift_and_verdicts(spark):
    assert stats.anchored_drift(1221, 1000, 1110, 1000) == pytest.approx(0.10)
    rows = spark.createDataFrame([(-0.1, 0.1), (0.11, 0.2), (-0.3, -0.11), (0.0, 0.2)], "lo double, hi double")
    got = [r[0] for r in rows.select(stats.cost_verdict(F.col("lo"), F.col("hi"))).collect()]
    assert got == ["STABLE", "STALE-COSTLIER", "STALE-CHEAPER", "INCONCLUSIVE"]
    v = spark.createDataFrame([("a", "STABLE"), ("a", "STABLE"), ("b", "STABLE"), ("b", "STALE-WORSE"), ("c", "INCONCLUSIVE")], "g string, v string")
    assert {r[0]: r[1] for r in v.groupBy("g").agg(stats.family_verdict(F.col("v"))).collect()} == {"a": "STABLE-FAMILY", "b": "STALE-FAMILY", "c": "INCONCLUSIVE-FAMILY"}


def test_transitions(spark):
    rows = [(a, b) for a in (True, False) for b in (True, False)] * 2
    got = spark.createDataFrame(rows, "a boolean, b boolean").agg(*stats.transitions(F.col("a"), F.col("b"))).first()
    assert tuple(got) == (2, 2, 2, 2)


def test_holm(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5, 0.04]
    adjusted, rejected = stats.holm_values(p)
    assert adjusted == pytest.approx([0.05, 0.12, 0.12, 0.03, 0.5, 0.12]) and rejected.tolist() == [False, False, False, True, False, False]
    got = stats.holm(spark.createDataFrame(list(enumerate(p)), "test int, p double")).orderBy("test").collect()
    assert [r["p_adjusted"] for r in got] == pytest.approx(adjusted.tolist())


def test_small_tests(spark):
    assert stats.mcnemar(0, 0) == 1.0 and stats.mcnemar(1, 9) == pytest.approx(22 / 1024)
    assert stats.signed_rank_test(0, 0, 0)[:3] == (0, 1.0, 0.0)
    assert stats.signed_rank_test(5, 0, 15)[:3] == (5, 2 / 32, -1.0)  # one choice of 32 on either side
    for n in (3, 6, 9):
        sums = [sum(r for r, bit in enumerate(bits, 1) if bit) for bits in itertools.product((0, 1), repeat=n)]
        for w in range(n * (n + 1) // 2 + 1):
            assert stats.rank_sum_below(n, w) == sum(x <= w for x in sums) / 2**n
    exact, near = stats.signed_rank_test(40, 300, 520), stats.signed_rank_test(40, 300, 520, exact_to=0)
    assert exact.exact and not near.exact and exact.p == pytest.approx(near.p, abs=0.01)
    r = stats.signed_ranks(spark.createDataFrame([(1.0, 0.0), (2.0, 0.0), (0.0, 2.0), (5.0, 5.0)], "a double, b double"), "a", "b").first()
    assert (r["n_nonzero"], r["w_plus"], r["w_minus"]) == (3, 3.5, 2.5)
    assert stats.row_slopes([1, 2, 3], [[2, 4, 6], [1, 1, 1]]) == pytest.approx([2, 0])
    assert np.isnan(stats.spearman_rows([1, 1, 1], [1, 2, 3])[0]) and stats.spearman_rows([1, 2, 9], [2, 3, 4])[0] == pytest.approx(1)
    assert stats.sign_p([1, 2, 3]) == 1 / 2000 and stats.sign_p([-1, 0, 1, 2, float('nan')]) == 1.0 and stats.sign_p([-1, *[1] * 9]) == 0.2
    with pytest.raises(ValueError):
        stats.interval([1.0, float("nan")])


def test_bootstrap_is_shared():
    i = stats.resamples(7, 50)
    x = np.arange(7.0)
    assert stats.resampled_means(x, stats.weights(i)) == pytest.approx([sum(x[k] for k in row) / 7 for row in i])
    lo, hi = stats.mean_interval(x, 500)
    assert 0 <= lo < 3 < hi <= 6
    assert (stats.resamples(7, 50) == i).all()


def test_random_intercept_recovers_a_slope():
    r = np.random.default_rng(0)
    g = np.repeat([1, 2, 3], 8)
    x = np.tile(np.linspace(0, 1, 8), 3)
    y = 2 * x + np.repeat([0.5, -0.5, 0.1], 8) + r.normal(0, 0.05, 24)
    fit = stats.random_intercept(y, np.stack([np.ones(24), x], 1), g)
    assert fit["coef"][1] == pytest.approx(2, abs=0.1) and fit["ci95"][1][0] < 2 < fit["ci95"][1][1] and fit["group_var"] > 0
    assert "undetermined" in stats.random_intercept([1, 1], np.ones((2, 2)), [1, 1])


def test_gates(spark):
    rows = spark.createDataFrame([("a", 0.9, 0.91), ("a", 0.8, 0.85), ("b", 0.9, 0.5), ("c", None, 0.4)], "g string, x double, y double")
    got = {r["g"]: (r["passed"], r["failed"]) for r in stats.gate(rows, {"high": F.avg("x") >= 0.85, "steady": F.min("y") > 0.6}, "g").collect()}
    assert got == {"a": (True, []), "b": (False, ["steady"]), "c": (False, ["high", "steady"])}
    assert {r["g"]: r["shifted"] for r in stats.calibration_shift(rows, "x", "y", 0.1, "g").collect()} == {"a": False, "b": True, "c": None}
