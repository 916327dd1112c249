"""Every query with SQL against DuckDB on the smallest driver tables; the others must run."""

import math
import os
import re

import duckdb
import pytest

from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in catalogue.SQL:
        assert rows
        return
    want = duck.sql(catalogue.SQL[name])
    assert sorted(want.columns) == sorted(got.columns)
    places = [want.columns.index(c) for c in got.columns]
    assert sorted(tuple(map(plain, r)) for r in rows) == sorted(tuple(plain(r[i]) for i in places) for r in want.fetchall())


def test_names_follow_the_inventory():
    assert all(re.fullmatch(r"[a-z]+\d*[a-z0-9_]*", n) for n in catalogue.QUERIES)
    assert len(catalogue.SQL) > 0.8 * len(catalogue.QUERIES)


def test_plans_push_filters_and_prune_columns(spark):
    plan = catalogue.QUERIES["src2_pushdown_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag)" in plan and "l_comment" not in plan and "l_extendedprice" not in plan


def test_asof_join_is_one_shuffle(spark):
    from tidemark.operators.joins import asof

    a = spark.createDataFrame([("x", 3), ("x", 7), ("y", 1)], "k string, t int")
    b = spark.createDataFrame([("x", 3, 1.0), ("x", 5, 2.0), ("y", 2, 9.0), ("x", 6, None)], "k string, t int, v double")
    out = asof(a, b, "t", "v", ["k"])
    assert sorted((r.k, r.t, r.v) for r in out.collect()) == [("x", 3, 1.0), ("x", 7, 2.0), ("y", 1, None)]
    assert sorted((r.k, r.t, r.v) for r in asof(a, b, "t", "v", ["k"], forward=True).collect()) == [("x", 3, 1.0), ("x", 7, None), ("y", 1, 9.0)]
    plan = out._jdf.queryExecution().toString()
    assert "Join" not in plan.split("Physical Plan")[1]
