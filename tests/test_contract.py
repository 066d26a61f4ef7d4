"""Every registered query that has SQL beside it, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows, names):
    order = sorted(names)

    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else v
        return v

    return sorted(repr([value(r[names.index(n)]) for n in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), names)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL) - {"pipeline"}))
def test_runs_without_sql(spark, name):
    if name.startswith("op"):
        pytest.skip("tests/llm compares it with a brute-force version")
    assert entry.queries()[name](spark, SF).count() > 0
