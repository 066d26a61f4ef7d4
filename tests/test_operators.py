"""Operators against hand cases, second implementations and properties that must hold."""

import pickle

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from halyard.operators import effort, evolve, graph, ivf, knn, models, validity


def table(spark, vectors, first=0, name="vec_id"):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(vectors)], f"{name} bigint, embedding array<float>")


@pytest.fixture(scope="module")
def cloud(spark):
    r = np.random.default_rng(3)
    x, q = r.normal(size=(300, 8)).astype(np.float32), r.normal(size=(20, 8)).astype(np.float32)
    return x, q, table(spark, x), table(spark, q, name="query_id")


def brute(x, q, k, skip=()):
    d = ((q.astype(float)[:, None, :] - x.astype(float)[None]) ** 2).sum(2)
    keep = [i for i in range(len(x)) if i not in set(skip)]
    return {j: sorted(keep, key=lambda i: (d[j, i], i))[:k] for j in range(len(q))}


def ids(df):
    return {r["query_id"]: list(r["ids"]) for r in knn.as_lists(df).collect()}


def test_knn_hand_cases(spark):
    base, q = table(spark, [[0], [10], [3], [7], [1]]), table(spark, [[2]], name="query_id")
    got = knn.as_lists(knn.exact_knn(base, q, 4)).first()
    assert list(got["ids"]) == [2, 4, 0, 3] and list(got["dists"]) == [1, 1, 4, 25]
    same = table(spark, np.ones((5, 3)))
    assert ids(knn.exact_knn(same, table(spark, [[1, 1, 1]], name="query_id"), 3)) == {0: [0, 1, 2]}


def test_knn_is_brute_force_for_any_partitioning(spark, cloud):
    x, q, base, queries = cloud
    want = brute(x, q, 10)
    for n in (1, 3, 7):
        assert ids(knn.exact_knn(base.repartition(n), queries, 10)) == want
    gone = spark.createDataFrame([(i,) for i in range(0, 300, 7)], "vec_id bigint")
    assert ids(knn.exact_knn(base, queries, 10, gone)) == brute(x, q, 10, range(0, 300, 7))


def test_knn_in_blocks(spark, cloud, monkeypatch):
    x, q, base, queries = cloud
    monkeypatch.setattr(knn, "BLOCK_BYTES", 2000)
    assert ids(knn.exact_knn(base, queries, 5)) == brute(x, q, 5)


def test_knn_errors(spark, cloud):
    _, _, base, queries = cloud
    for k in (0, 301):
        with pytest.raises(ValueError):
            knn.exact_knn(base, queries, k)
    with pytest.raises(Exception, match="dimension"):
        knn.exact_knn(base, table(spark, [[1.0, 2.0]], name="query_id"), 1).collect()
    assert knn.exact_knn(base, queries.limit(0), 1).count() == 0


def test_set_distance(spark):
    a, b = table(spark, [[0], [5]]), table(spark, [[1], [9]])
    assert {r[0]: r[1] for r in knn.set_distance(a, b).collect()} == {0: 1.0, 1: 16.0}
    assert {r[0]: r[1] for r in knn.set_distance(a, a, True).collect()} == {0: 25.0, 1: 25.0}


def test_exhaustive_effort_finds_all(spark, cloud):
    x, q, base, queries = cloud
    centres = ivf.anchors(base, 12)
    curve = ivf.curve(ivf.probe_order(queries, centres, 12), ivf.assign(base, centres), knn.exact_knn(base, queries, 10), 12)
    last = curve.where("ef = 12").collect()
    assert all(r["hits"] == 10 and r["dc"] == 312 for r in last) and len(last) == 20
    rows = sorted((r["query_id"], r["ef"], r["hits"], r["dc"]) for r in curve.collect())
    assert all(a[0] != b[0] or (a[2] <= b[2] and a[3] <= b[3]) for a, b in zip(rows, rows[1:], strict=False))


def test_grid():
    g = effort.geometric_grid(10, 4096, 1.05)
    assert len(g) == 121 and g[:21] == list(range(10, 31)) and g[21:23] == [32, 34] and g[-2:] == [3932, 4096]
    assert effort.geometric_grid(10, 45, 2.0) == [10, 20, 40, 45] and effort.doubling_ladder(10, 45) == [10, 20, 40, 45]
    for bad in ((0, 5, 2.0), (5, 4, 2.0), (1, 5, 1.0)):
        with pytest.raises(ValueError):
            effort.geometric_grid(*bad)


def curves(spark, *hits):
    return spark.createDataFrame([(q, e, h, 100 * e + q) for q, row in enumerate(hits) for e, h in enumerate(row)], "query_id bigint, ef bigint, hits bigint, dc bigint")


def test_labels(spark):
    got = {r["query_id"]: (r["reached"], r["oracle_ef"], r["first_ef"]) for r in effort.oracle_labels(curves(spark, [8, 10, 9, 10, 10], [5, 10, 9, 9, 9], [10, 10, 10, 10, 10]), 10).collect()}
    assert got == {0: (True, 3, 1), 1: (False, None, 1), 2: (True, 0, 0)}
    got = {r["query_id"]: r["oracle_ef"] for r in effort.oracle_labels(curves(spark, [8, 10, 9, 10, 10]), 10, 0.9).collect()}
    assert got == {0: 1}


def test_candidate_rules(spark):
    rows = [(0, [1, 1, 1]), (1, [0, 1, 1]), (2, [1, 0, 1]), (3, [1, 1, 0]), (4, [0, 0, 0])]
    c = spark.createDataFrame([(q, j, bool(s), 10 * (j + 1)) for q, row in rows for j, s in enumerate(row)], "query_id bigint, j bigint, success boolean, cost bigint")
    assert [r["y"] for r in effort.candidate_oracle(c, 3).orderBy("query_id").collect()] == [0, 1, 2, 3, 3]
    got = effort.contract_oracle(c, 0.6).first()
    assert got["feasible"] and got["mean_cost"] == (10 + 20 + 30 + 10 + 10) / 5 and got["achievable_rate"] == 0.6
    assert not effort.contract_oracle(c, 0.8).first()["feasible"]


def test_choice_and_tau(spark):
    p = spark.createDataFrame([(q, j, v) for q, row in enumerate([[0.2, 0.9, 0.5], [0.1, 0.2, 0.3]]) for j, v in enumerate(row)], "query_id bigint, j bigint, p double")
    got = {r["query_id"]: (r["choice"], r["fallback"]) for r in effort.choose(p, 0.5).collect()}
    assert got == {0: (1, False), 1: (2, True)}
    quality = spark.createDataFrame([(q, j, float(j >= 1)) for q in range(2) for j in range(3)], "query_id bigint, j bigint, q double")
    best = effort.calibrate_tau(p, quality, 1.0).first()
    assert best["tau"] == pytest.approx(0.201) and best["quality"] == 1.0
    assert effort.calibrate_tau(p, quality.withColumn("q", F.lit(0.0)), 1.0).first()["tau"] is None


def test_mix(spark):
    fixed = spark.createDataFrame([(10, 0.80), (20, 0.90), (40, 0.96), (80, 0.99)], "ef bigint, mean_recall double")
    got = effort.two_effort_mix(fixed, 0.95).first()
    assert (got["ef_lo"], got["ef_hi"]) == (20, 40) and got["w_hi"] == pytest.approx(5 / 6)
    assert tuple(effort.two_effort_mix(fixed, 0.80).first()) == (10, 10, 1.0)
    assert effort.two_effort_mix(fixed, 0.999).count() == 0


def test_interpolation(spark):
    fixed = spark.createDataFrame([(18, 0.8, 500.0), (48, 0.9, 1000.0), (327, 1.0, 1400.0)], "ef bigint, mean_recall double, mean_dc double")
    want = spark.createDataFrame([(0.95,), (0.5,), (1.1,)], "recall double")
    assert {r[0]: r[1] for r in effort.interpolated_cost(fixed, want).collect()} == {0.95: pytest.approx(1200), 0.5: 500.0, 1.1: float("inf")}


def test_lookup_of_a_missing_point_raises(spark):
    c = curves(spark, [8, 10])
    with pytest.raises(Exception, match="no curve point"):
        effort.fixed_policy(c, 7).collect()


def test_selection():
    rows = [{"name": "deep", "feasible": True, "cost": 100.0, "score": 0.9}, {"name": "flat", "feasible": True, "cost": 100.5, "score": 0.89}, {"name": "no", "feasible": False, "cost": 1.0, "score": 1.0}]
    assert effort.select_family(rows, 0.01, ["flat", "deep", "no"]) == "flat" and effort.select_family(rows, 0.0, ["flat", "deep", "no"]) == "deep"
    assert effort.select_family(rows[2:], 0.1, []) is None and effort.select_candidate(rows, 0.02, ["flat", "deep"]) == "flat"
    with pytest.raises(RuntimeError):
        effort.select_candidate(rows[2:], 0, [])


def test_lagrangian_reaches_its_target(spark):
    r = np.random.default_rng(1)
    rows = [(q, j, int(min(10, h + r.integers(0, 3))), 10 * 2**j) for q in range(30) for j, h in enumerate([3, 6, 8, 10])]
    c = spark.createDataFrame(rows, "query_id bigint, j bigint, hits bigint, cost bigint").persist()
    got = effort.lagrangian(c, 10, 0.8)
    assert got["recall"] >= 0.8 - 1e-9 and effort.lagrangian(c, 10, 1.5) is None
    after = effort.priced_choice(c, got["price"] * (1 + 1e-9), 10).agg(F.avg("hits"), F.avg("cost")).first()
    assert abs(after[0] - 10 * got["recall"]) < 1e-9 and abs(after[1] - got["cost"]) < 1e-9
    before = effort.priced_choice(c, got["price"] * (1 - 1e-9), 10).agg(F.avg("hits")).first()[0]
    assert before < 8
    cheaper = effort.priced_choice(c, got["price"] * 0.98, 10).agg(F.avg("hits")).first()[0]
    assert cheaper <= 10 * got["recall"] + 1e-9


# --- graph ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def built(cloud):
    x, *_ = cloud
    g = graph.Graph(8, 64, 42)
    g.add(range(len(x)), x)
    return g


def test_graph_recall_and_cost(cloud, built):
    x, q, *_ = cloud
    truth = brute(x, q, 10)
    by_ef = []
    for ef in (10, 40, 300):
        got = [built.search(v, 10, ef) for v in q]
        by_ef.append((np.mean([len(set(g["labels"]) & set(truth[i])) / 10 for i, g in enumerate(got)]), np.mean([g["dc"] for g in got])))
        assert all(g["dists"] == sorted(g["dists"]) for g in got)
    assert by_ef[0][1] < by_ef[1][1] < by_ef[2][1] and by_ef[2][0] > 0.99


def test_builds_are_reproducible_and_nested(cloud, built):
    x, *_ = cloud
    again = graph.Graph(8, 64, 42)
    again.add(range(200), x[:200])
    again.add(range(200, 300), x[200:])
    assert again.links == built.links and again.entry == built.entry


def test_deleted_are_traversed_not_returned(cloud, built):
    import copy

    x, q, *_ = cloud
    g = copy.deepcopy(built)
    g.delete(range(0, 300, 3))
    truth = brute(x, q, 10, range(0, 300, 3))
    found = [g.search(v, 10, 300)["labels"] for v in q]
    assert all(i % 3 for f in found for i in f)
    assert np.mean([len(set(f) & set(truth[i])) / 10 for i, f in enumerate(found)]) > 0.98


def test_hook_sees_a_plain_search(cloud, built):
    x, q, *_ = cloud
    truth = brute(x, q, 10)
    for i, v in enumerate(q):
        plain, hook = built.search(v, 10, 40), graph.Hook(10, truth=truth[i])
        traced = built.search(v, 10, 40, hook)
        assert traced == plain and hook.seen
        assert all(a[1] <= b[1] and a[-1] <= b[-1] + 1e-12 for a, b in zip(hook.seen, hook.seen[1:], strict=False))
        never = graph.Hook(10, 20, 5, 0.95, lambda f: 0.0)
        assert built.search(v, 10, 40, never) == plain and not never.stopped
        soon = graph.Hook(10, 20, 5, 0.95, lambda f: 1.0)
        assert built.search(v, 10, 40, soon)["dc"] <= plain["dc"] and soon.stopped


def test_live_features():
    got = graph.live_features(4, 120, 17, 42.5, range(1, 11))
    assert got == [4, 120, 17, 42.5, 1, 10, 5.5, 8.25, 3, 5, 7]
    with pytest.raises(ValueError):
        graph.live_features(1, 1, 1, 1, [])


def test_search_is_the_same_for_any_partitioning(spark, cloud):
    _, _, base, queries = cloud
    blob = graph.build(base, [42], 8, 64).first()["graph"]
    rows = lambda n: sorted(map(repr, graph.search(blob, queries.repartition(n), 10, [10, 40]).collect()))
    assert rows(1) == rows(5) and len(rows(2)) == 40


def test_graph_as_a_table(spark, cloud):
    _, q, base, queries = cloud
    blob = graph.build(base, [42], 8, 64).first()["graph"]
    again = graph.from_table(graph.to_table(spark, blob), base, 8, 64)
    rows = lambda g: sorted(map(repr, graph.search(g, queries, 10, [20]).collect()))
    assert rows(again) == rows(blob)


def test_search_cap(spark):
    fixed = spark.createDataFrame([(10, 0.9), (20, 0.99), (40, 1.0)], "ef bigint, mean_recall double")
    assert effort.search_cap(fixed) == 20 and effort.search_cap(fixed, 1.1) is None


# --- evolution, validity, models -----------------------------------------------------------------------------------


def test_states_are_nested(spark, cloud):
    x, q, base, queries = cloud
    pool = table(spark, np.random.default_rng(9).normal(size=(60, 8)), first=1000)
    before = set()
    for p in (1, 2, 4, 8):
        scanned, alive = evolve.live(base, pool, evolve.State("id", p), 300)
        now = {r[0] for r in alive.select("vec_id").collect()}
        assert before <= now and len(now) == 300 + 3 * p
        before = now
    scanned, alive = evolve.live(base, pool, evolve.parse("del_8"), 300)
    assert scanned.count() == 300 and alive.count() == 276
    order = [r[0] for r in evolve.regional_order(pool, [3, 6, 12]).orderBy("pos").collect()]
    smaller = [r[0] for r in evolve.regional_order(pool, [3, 6]).orderBy("pos").collect()]
    assert order[:6] == smaller and len(order) == 12


def test_drift_is_zero_at_the_first_state(spark, cloud):
    x, q, base, queries = cloud
    truth, _ = evolve.state_curve(base, base.limit(0), queries, evolve.State(), 8, 10, 300)
    assert evolve.overlap(truth, truth, 10).agg(F.min("overlap"), F.max("decay")).first() == (10, 0.0)
    assert evolve.density_drift(truth, truth, 10).agg(F.max(F.abs("drift"))).first()[0] == 0.0
    assert evolve.distribution_drift(base, base).first()[0] == 0.0


def test_insertion_pool(spark):
    pool = spark.createDataFrame([(1, [1.0]), (2, [1.0]), (3, [2.0]), (4, [3.0]), (5, [4.0])], "vec_id bigint, embedding array<float>")
    queries = spark.createDataFrame([(0, [3.0])], "query_id bigint, embedding array<float>")
    out = spark.createDataFrame([(5,)], "vec_id bigint")
    assert sorted(r["vec_id"] for r in evolve.insertion_pool(pool, queries, exclude=out).collect()) == [1, 3]


def panel(spark, drift=1.0, fail=0):
    rows = []
    for s in (42, 43):
        for t, f, n in (("S0", 1.0, 0), ("id_8", drift, fail)):
            for i in range(100):
                base = 1000 + 10 * (i % 7)
                rows += [("local", s, t, i, base, 10), ("frozen", s, t, i, int(base * 1.1 * f), 10 if i >= n else 9)]
    return spark.createDataFrame(rows, validity.PANEL)


@pytest.mark.parametrize("drift, fail, cost, contract", [(1.0, 0, "STABLE", "STABLE"), (1.3, 0, "STALE-COSTLIER", "STABLE"), (0.7, 30, "STALE-CHEAPER", "STALE-WORSE")])
def test_known_drift(spark, drift, fail, cost, contract):
    got = validity.analyse(panel(spark, drift, fail), "local", 10, replicates=200).first()
    assert (got["cost_verdict"], got["contract_verdict"]) == (cost, contract)
    assert got["cost_drift"] == pytest.approx(drift - 1, abs=0.01)
    again = validity.analyse(panel(spark, drift, fail), "local", 10, replicates=200).first()
    assert again == got


def test_panels_must_be_whole(spark):
    p = panel(spark)
    expected = p.select("policy", "seed", "state").distinct()
    assert validity.validate(p, 10, expected) is p
    for broken in (p.where("query_id <> 3 or policy <> 'frozen'"), p.unionAll(p.limit(1)), p.withColumn("hits", F.lit(11).cast("bigint")), p.where("state <> 'id_8'"), p.withColumn("cost", F.lit(0).cast("bigint"))):
        with pytest.raises(validity.PanelError):
            validity.validate(broken, 10, expected)


def test_model_exports(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 2))
    rows = [(i, float(a), float(b), int(a + 0.5 * b > 0)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "query_id bigint, a double, b double, y int")
    for export in (models.fit_logistic(df, ["a", "b"], "y"), models.fit_tree(df, ["a", "b"], "y", depth=4, least=10)):
        got = df.select("y", models.predicted(export).alias("p"), models.probability(export, 1).alias("q")).collect()
        assert np.mean([g["y"] == g["p"] for g in got]) > 0.85 and all(0 <= g["q"] <= 1 for g in got)
    assert models.rules(export) and df.select(models.leaf(export).alias("l")).distinct().count() > 2
    one = models.fit_logistic(df.withColumn("y", F.lit(1)), ["a"], "y")
    assert one["kind"] == "constant" and df.select(models.probability(one, 1).alias("p")).first()[0] == 1.0
    f = models.folds(df, "y", "query_id").groupBy("y", "fold").count().collect()
    assert len(f) == 10 and max(r["count"] for r in f if r["y"] == 0) - min(r["count"] for r in f if r["y"] == 0) <= 1


def test_trees_round_to_single_precision(spark):
    export = {"kind": "tree", "classes": [0, 1], "features": ["a"], "root": {"feature": "a", "threshold": float(np.float32(0.1)), "low": {"p": [1.0, 0.0]}, "high": {"p": [0.0, 1.0]}}}
    df = spark.createDataFrame([(0.1,), (float(np.float32(0.1)),), (0.11,)], "a double")
    assert [r[0] for r in df.select(models.probability(export, 1)).collect()] == [0.0, 0.0, 1.0]


def one_batch(labels, vectors):
    import pyarrow as pa

    n, dim = vectors.shape
    return pa.RecordBatch.from_arrays([pa.array(labels), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(vectors.ravel()))], names=["vec_id", "embedding"])


def test_knn_memory_of_a_task_is_a_few_tiles():
    """Distances of all queries to a block of the base at once were 8 bytes a pair, several times over."""
    import tracemalloc

    r = np.random.default_rng(8)
    q, x = r.normal(size=(8000, 4)), r.normal(size=(4096, 4)).astype(np.float32)
    tracemalloc.start()
    list(knn._nearest(np.arange(8000), q, 10)(iter([one_batch(np.arange(4096), x)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_knn_is_the_same_to_the_last_bit(shift):
    """Copies, ties and vectors far from the origin, where a product of matrices cancels; with groups, each is as if it stood alone."""
    r = np.random.default_rng(9)
    x, q = (r.normal(size=(3000, 16)) + shift).astype(np.float32), (r.normal(size=(300, 16)) + shift).astype(np.float32)
    x[500:900], q[3] = x[7], x[7]
    names, live = r.permutation(3000), r.integers(0, 8, 3000)
    best = knn.Nearest(q, 10, 3)
    for at in range(0, 3000, 1300):
        best.see(names[at:at + 1300], x[at:at + 1300], live[at:at + 1300])
    for g in range(3):
        mine = live >> g & 1 == 1
        d = knn.squared_distances(q, x[mine])
        i = np.broadcast_to(names[mine], d.shape)
        o = np.lexsort((i, d), axis=1)[:, :10]
        assert np.array_equal(best.d[g], np.take_along_axis(d, o, 1)) and np.array_equal(best.i[g], np.take_along_axis(i, o, 1))


def test_states_in_one_pass_are_those_one_by_one(spark, cloud):
    _, _, base, queries = cloud
    pool = table(spark, np.random.default_rng(5).normal(size=(60, 8)), first=1000)
    names = ["S0", "id_2", "id_8", "del_2", "del_8"]
    truth = evolve.state_truths(base, pool, queries, names, 10, 300)
    curve = evolve.state_curves(base, pool, queries, names, 12, truth, 300)
    for s in names:
        one, own = evolve.state_curve(base, pool, queries, evolve.parse(s), 12, 10, 300)
        assert sorted(map(tuple, truth.where(F.col("state") == s).drop("state").collect())) == sorted(map(tuple, one.collect()))
        assert sorted(map(tuple, curve.where(F.col("state") == s).drop("state").collect())) == sorted(map(tuple, own.collect()))


def test_search_of_cells_writes_no_pairs(spark, cloud):
    """The nearest of the scanned cells, as a filter on all pairs has them; the plan joins no vectors."""
    x, q, base, queries = cloud
    centres = ivf.anchors(base, 12)
    got = ivf.search(base, queries, centres, 12, 3, 10)
    cell, order = knn.squared_distances(x, x[:12]).argmin(1), knn.squared_distances(q, x[:12]).argsort(1, kind="stable")[:, :3]
    for j, rows in ids(got).items():
        assert rows == brute(x, q[j:j + 1], 10, [i for i in range(300) if cell[i] not in order[j]])[0]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_results_are_written_in_parts(monkeypatch):
    """A task's results, of one group or of several, leave in batches of few queries; together they are what one batch held."""
    r = np.random.default_rng(5)
    base, q = r.integers(0, 3, (90, 4)).astype(np.float32), r.integers(0, 3, (50, 4)).astype(np.float32)
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(90)), pa.array(list(base)), pa.array(r.integers(1, 8, 90))], names=["vec_id", "embedding", "live"])
    ids = np.arange(50) * 5
    for make in (lambda: knn._nearest(ids, q, 4), lambda: knn._nearest_by_group(ids, q, 4, 3)):
        monkeypatch.setattr(knn, "OUT_QUERIES", 1000, raising=False)
        whole = list(make()([rows]))
        monkeypatch.setattr(knn, "OUT_QUERIES", 8, raising=False)
        parts = list(make()([rows]))
        assert len(whole) == 1 and len(parts) == 7
        assert all(len(set(b["query_id"].to_pylist())) <= 8 for b in parts)
        assert pa.Table.from_batches(parts).to_pylist() == whole[0].to_pylist()


def test_a_graph_reaches_the_driver_through_arrow(spark, monkeypatch):
    """Rows are pickled in the driver's JVM, whose heap a graph of 61,538 vectors filled."""
    from pyspark.sql.classic.dataframe import DataFrame

    from halyard.plans import contract, flows

    want = graph.build(contract.parts(spark, "/root/testdata/sf0.001")[0], [42], 8, 64).first()["graph"]
    for name in ("collect", "first", "head", "take"):
        monkeypatch.setattr(DataFrame, name, lambda *a: pytest.fail("a pickled row"))
    assert flows.graph_of(spark, "/root/testdata/sf0.001") == want


def test_a_pickled_graph_holds_its_vectors_once():
    x = np.random.default_rng(3).normal(size=(400, 64)).astype(np.float32)
    g = graph.Graph(4, 16, 1)
    g.add(range(300), x[:300])
    blob = pickle.dumps(g)
    assert len(blob) < 300 * 64 * 8 * 1.4
    again = pickle.loads(blob)
    g.add(range(300, 400), x[300:])
    again.add(range(300, 400), x[300:])
    assert again.links == g.links and again.search(x[0], 5, 16) == g.search(x[0], 5, 16) and np.array_equal(again.array(), g.array())
    assert pickle.loads(pickle.dumps(graph.Graph())).ids == []
