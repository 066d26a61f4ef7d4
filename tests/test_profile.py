"""Descriptions of tables: empty tables, nulls, values outside the bins, incomplete grids, report text, array files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.operators import effort, profile
from halyard.sources import tables


def test_describe_and_bins(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (2, 4.0)], "j int, v double")
    d = {r["column"]: r for r in profile.describe(df, ["j", "v"]).collect()}
    assert d["v"]["n"] == 2 and d["v"]["median"] == 3.0 and d["j"]["most"] == 2.0 and abs(d["v"]["std"] - 2**0.5) < 1e-12
    assert [(r["bin"], r["n"]) for r in profile.bin_counts(df, "j", 4).orderBy("bin").collect()] == [(0, 0), (1, 1), (2, 2), (3, 0)]
    assert [(r["n"], r["share"]) for r in profile.bin_counts(df.limit(0), "j", 2).collect()] == [(0, None)] * 2
    for bad in (spark.createDataFrame([(9,)], "j int"), spark.createDataFrame([(None,)], "j int")):
        with pytest.raises(Exception, match="no such bin"):
            profile.bin_counts(bad, "j", 4).collect()


def test_grid_and_matrix(spark):
    rows = [(1, 10), (1, 20), (2, 10), (3, 10), (3, 20), (3, 20), (4, 10), (4, 30)]
    df = spark.createDataFrame(rows, "q int, ef int")
    assert {r["q"]: r["same"] for r in profile.follows_grid(df, "q", "ef", [10, 20]).collect()} == {1: True, 2: False, 3: False, 4: False}
    m = {(r["a"], r["b"]): r["rho"] for r in profile.rank_matrix(spark.createDataFrame([(1, 3, 5), (2, 2, 5), (3, 1, 5)], "x int, y int, z int"), ["x", "y", "z"]).collect()}
    assert len(m) == 9 and m["x", "y"] == m["y", "x"] == -1.0 and m["x", "x"] == 1.0 and m["z", "x"] is None


def test_markdown(spark):
    df = spark.createDataFrame([("a|b", 0.123456, None)], "n string, x double, y int")
    assert profile.markdown(df) == "| n | x | y |\n| --- | --- | --- |\n| a\\|b | 0.1235 |  |"
    with pytest.raises(ValueError):
        profile.markdown(spark.range(3), most=2)


def test_contract_regret_of_the_best_policy_is_none(spark):
    c = spark.createDataFrame([(q, j, 10 if j >= q else 5, 10 * (j + 1), j >= q) for q in range(3) for j in range(3)], "query_id bigint, j bigint, hits bigint, cost bigint, success boolean")
    best = effort.contract_regret(spark.range(3).select(F.col("id").alias("query_id"), F.col("id").alias("choice")), c).first()
    assert best["success_rate"] == 1.0 and best["contract_regret"] == 0.0
    assert effort.contract_regret(spark.range(3).select(F.col("id").alias("query_id"), F.lit(2).cast("bigint").alias("choice")), c).first()["contract_regret"] == 10.0


def test_npz(spark, tmp_path):
    path = str(tmp_path / "a.npz")
    np.savez(path, overlap=np.arange(6).reshape(3, 2), one=np.array([7.0, 8.0]))
    assert [tuple(r["values"]) for r in tables.read_npz(spark, path, "overlap").orderBy("row").collect()] == [(0, 1), (2, 3), (4, 5)]
    assert [r["values"] for r in tables.read_npz(spark, path, "one").orderBy("row").collect()] == [[7.0], [8.0]]
    with pytest.raises(Exception, match="no array"):
        tables.read_npz(spark, path, "missing").collect()
