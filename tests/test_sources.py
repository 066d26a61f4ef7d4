"""Files: round trips, truncation, strict headers, frozen artifacts; and the update stream."""

import copy
import json
import struct

import numpy as np
import pytest

from halyard.sources import config, tables, vecs
from halyard.streaming import live


def test_vectors_round_trip(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(50, 7)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row bigint, vec array<float>")
    path = str(tmp_path / "a.fvecs")
    assert vecs.write(df.repartition(4), path) == 50
    got = vecs.read(spark, path).orderBy("row").collect()
    assert [r["row"] for r in got] == list(range(50)) and np.array_equal(np.array([r["vec"] for r in got], np.float32), x)
    assert vecs.read(spark, path, max_rows=9).count() == 9
    ints = spark.createDataFrame([(0, [1, -2]), (1, [3, 4])], "row bigint, vec array<int>")
    vecs.write(ints, str(tmp_path / "b.ivecs"), "ivecs")
    assert [list(r["vec"]) for r in vecs.read(spark, str(tmp_path / "b.ivecs"), "ivecs").orderBy("row").collect()] == [[1, -2], [3, 4]]


def test_bad_vector_files(spark, tmp_path):
    for name, data in (("cut", struct.pack("<iff", 3, 1, 2)), ("zero", struct.pack("<i", 0)), ("empty", b"")):
        p = tmp_path / name
        p.write_bytes(data)
        with pytest.raises(vecs.VectorFileError):
            vecs.dimension(spark, str(p))
    p = tmp_path / "mixed"
    p.write_bytes(struct.pack("<iff", 2, 1, 2) + struct.pack("<iff", 3, 1, 2))
    with pytest.raises(Exception, match="dimension"):
        vecs.read(spark, str(p)).collect()


def test_trace_round_trip(spark, tmp_path):
    rows = [tuple([i, *[i + 0.25 * j for j in range(12)]]) for i in range(5)]
    df = spark.createDataFrame(rows, ", ".join(["query_id bigint"] + [f"{c} double" for c in vecs.TRACE[1:]]))
    path = str(tmp_path / "t.f64")
    assert vecs.write_trace(df, path) == 5
    assert sorted(map(tuple, vecs.read_trace(spark, path).collect())) == sorted(rows)


def test_strict_tables(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    assert tables.read_split(spark, file("a", "query_id,split\n0,train\n1,test\n")).count() == 2
    for text in ("query_id,side\n0,train\n", "query_id,split\n1,train\n", "query_id,split\n0,train\n0,test\n", "query_id,split\n0,dev\n"):
        with pytest.raises(tables.TableError):
            tables.read_split(spark, file("b", text))
    assert tables.read_policy(spark, file("c", "query_id,ef\n5,10\n2,20\n")).count() == 2
    for text in ("query_id,ef\n5,0\n", "query_id,ef\n5,1\n5,2\n"):
        with pytest.raises(tables.TableError):
            tables.read_policy(spark, file("d", text))
    with pytest.raises(tables.TableError):
        tables.read_deleted(spark, file("e", "label\n7\n"), 7)
    with pytest.raises(Exception):
        tables.read_policy(spark, file("f", "query_id,ef\nx,1\n")).collect()


def test_frozen_files(tmp_path):
    (tmp_path / "m.json").write_text("{}")
    tables.write_manifest(str(tmp_path), "m.json")
    assert list(tables.verify_manifest(str(tmp_path))) == ["m.json"]
    (tmp_path / "m.json").write_text("{ }")
    with pytest.raises(tables.TableError):
        tables.verify_manifest(str(tmp_path))
    with pytest.raises(FileExistsError):
        tables.write_json({}, str(tmp_path / "m.json"))
    assert len(tables.experiment_id("x", 0).split("_")[0]) == 12 and tables.experiment_id("x", 0).endswith("19700101T000000Z")


def test_cached_and_same_rows(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(5)

    path = str(tmp_path / "c")
    a, b = tables.cached(spark, path, make), tables.cached(spark, path, make)
    assert len(made) == 1 and tables.same_rows(a, b) and not tables.same_rows(a, b.limit(4))


def test_update_stream(spark, tmp_path):
    base = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "vec_id bigint, embedding array<float>")
    log = spark.createDataFrame([(1, "insert", 3, [2.0]), (2, "delete", 1, None), (3, "insert", 2, [9.0]), (4, "delete", 3, None), (5, "insert", 4, [4.0])], live.LOG)
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    queries = spark.createDataFrame([(0, [4.5])], "query_id bigint, embedding array<float>")
    stream = spark.readStream.schema(live.LOG).parquet(str(tmp_path / "log"))
    q = live.maintain(spark, stream, base, str(tmp_path / "live"), str(tmp_path / "cp"), live.truth_of(queries, 1, str(tmp_path / "truth")))
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(live.version_path(str(tmp_path / "live"), 1)).collect()
    assert sorted((r["vec_id"], r["embedding"][0]) for r in got) == [(2, 9.0), (4, 4.0)]
    assert spark.read.parquet(str(tmp_path / "truth")).first()["vec_id"] == 4


GOOD = {"name": "a", "data": "d", "index": {"kind": "ivf", "m": 16, "build_effort": 200, "seeds": [42, 43], "cells": 20}, "sweep": {"k": 10, "least": 10, "most": 64, "ratio": 1.05, "target": 1}, "split": {"tests": 5, "seed": 1}, "states": ["S0", "id_8"]}


def test_configurations(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(GOOD))
    c = config.load(str(tmp_path / "c.json"))
    assert c.sweep.target == 1.0 and config.cells(c) == [(42, "S0"), (42, "id_8"), (43, "S0"), (43, "id_8")]

    def bad(path, value):
        x = copy.deepcopy(GOOD)
        *up, last = path.split(".")
        at = x
        for p in up:
            at = at[p]
        if value is None:
            del at[last]
        else:
            at[last] = value
        with pytest.raises(config.ConfigError):
            config.parse(x)

    for path, value in (("name", None), ("index.m", None), ("index.extra", 1), ("index.m", 1), ("index.m", "16"), ("index.seeds", [1, 1]), ("index.seeds", ["a"]), ("sweep.ratio", 1.0), ("sweep.target", 1.5), ("states", ["id_8"]), ("split", 3)):
        bad(path, value)


def test_steps_resume(spark, tmp_path):
    log = []
    steps = [("a", lambda t: spark.range(3)), ("b", lambda t: t["a"].selectExpr("id * 2 as id"))]
    for _ in range(2):
        out = tables.run_steps(spark, str(tmp_path), steps, log)
    assert log == ["a", "b"] and sorted(r[0] for r in out["b"].collect()) == [0, 2, 4]
    tables.established(spark, str(tmp_path / "s"), lambda: spark.range(4))
    tables.established(spark, str(tmp_path / "s"), lambda: spark.range(4))
    with pytest.raises(tables.TableError):
        tables.established(spark, str(tmp_path / "s"), lambda: spark.range(5))
