"""Accounts of many gates, series side by side, selection, and the guards of readers and manifests."""

import datetime as dt
import hashlib
import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.kernels import accounts, resample
from tidemark.plans import gates, inference, operations, strategies, walkforward
from tidemark.sources import readers

DAY = dt.date(2001, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


def test_accounts_agree_with_the_operators(spark):
    draw = np.random.default_rng(3)
    n = 60
    tri, rf, g = 100 * np.cumprod(1 + 0.01 * draw.standard_normal(n)), np.full(n, 0.0001), (draw.uniform(size=n) < 0.4).astype(float)
    rows = [("a", day(k), float(tri[k]), float(rf[k]), float(g[k]) if k > 3 else None) for k in range(n)]
    days = spark.createDataFrame(rows, "series_id string, date date, tri double, rf double, g double")
    for lag in (0, 1, 2):
        want = [r.r for r in strategies.switch_returns(days, lag, 0.002, 0.001).orderBy("date").collect()]
        got = accounts.switch_path(tri, rf, np.where(np.arange(n) > 3, g, np.nan)[None], lag, 0.002, 0.001)[0]
        assert np.allclose(got[1:], want[1:]) and np.isnan(got[0]) and want[0] is None
    plan = {
        "is_entry": np.arange(n) % 20 == 1, "is_expiry": np.arange(n) % 20 == 19, "forward": np.full(n, 100.0), "premium": np.full(n, 5.0),
        "payoff": draw.uniform(0, 8, n), "mark": draw.uniform(3, 6, n), "exit_px": draw.uniform(3, 6, n), "rf": rf,
    }
    rows = [("m", day(k), *(v[k].item() for v in plan.values()), float(g[k])) for k in range(n)]
    table = spark.createDataFrame(rows, "member string, date date, is_entry boolean, is_expiry boolean, forward double, premium double, payoff double, mark double, exit_px double, rf double, g double")
    want = [r.value for r in strategies.simulate(table, ["member"], 1, 0.002, 0.003).orderBy("date").collect()]
    assert np.allclose(accounts.straddle_path(plan, g[None], 1, 0.002, 0.003)[0], want)


def test_interleaved_series_are_refitted_apart(spark):
    rows = [(s, k, day(k), float(k if s == "up" else -k)) for k in range(100) for s in ("up", "down")]
    frame = spark.createDataFrame(rows, "series_id string, pos long, date date, v double")
    both = gates.percentile_gate(frame, "v", 0.8, first=50, step=25, window=20, min_history=20)
    for s in ("up", "down"):
        alone = gates.percentile_gate(frame.where(F.col("series_id") == s), "v", 0.8, first=50, step=25, window=20, min_history=20)
        want = [(r.pos, r.refit, r.g) for r in alone.orderBy("pos").collect()]
        assert [(r.pos, r.refit, r.g) for r in both.where(F.col("series_id") == s).orderBy("pos").collect()] == want
    assert both.where("g = 1").select("series_id").distinct().collect()[0][0] == "up"
    sweep = gates.percentile_sweep(frame, "v", [0.5, 0.8], first=50, step=25, window=20, min_history=20)
    assert sweep.count() == 2 * 2 * 50
    dated = gates.refits_at(frame, spark.createDataFrame([(day(50),), (day(75),), (day(500),)], "date date"))
    assert sorted(map(tuple, dated.collect())) == [(s, a, b) for s in ("down", "up") for a, b in ((50, 75), (75, 100))]


def test_rotations_need_room_and_find_timing(spark):
    draw = np.random.default_rng(0)
    bad = np.repeat((draw.uniform(size=60) < 0.3).astype(float), 10)
    r = np.where(bad == 1, -0.01, 0.005) + 0.002 * draw.standard_normal(600)
    score = inference.switch_score(np.cumprod(1 + r), np.zeros(600), 0, 1, 0.0, 0.0)
    found = inference.circular_shift_test(spark, bad, score, n=199, margin=100).first()
    assert found.p == pytest.approx(1 / 200) and found.observed > found.null_mean
    with pytest.raises(ValueError):
        inference.circular_shift_test(spark, bad[:150], score, n=9, margin=100)


def test_differences_use_the_difference_of_the_series(spark):
    draw = np.random.default_rng(1)
    common = np.convolve(draw.standard_normal(900), np.ones(20) / 20, "same") * 0.01
    a, b = common + 0.01 * draw.standard_normal(900), common + 0.01 * draw.standard_normal(900)
    rows = spark.createDataFrame([(day(k), float(a[k]), float(b[k]), 0.0) for k in range(900)], "date date, a double, b double, rf double")
    found = inference.paired_difference(rows, "a", "b", "mppm", n_boot=400).first()
    assert found.length == resample.block_length(a - b) and found.diff == pytest.approx(resample.mppm(a) - resample.mppm(b))
    test = inference.sharpe_difference_test(rows, "a", "b", n_boot=400).first()
    assert test.length == found.length and 0 <= test.p <= 1 and test.low < test.diff < test.high


def test_the_best_penalty_is_taken_until_the_next_selection(spark):
    n = 900
    crash = set(range(300, 340))
    days = spark.createDataFrame([("a", day(k), float(100 * 0.999 ** sum(c <= k for c in crash) * 1.0002**k), 0.0) for k in range(n)], "series_id string, date date, tri double, rf double")
    flags = [(50.0, day(k), 1.0 if k in crash else 0.0) for k in range(n)] + [(5.0, day(k), 1.0 if k % 2 else 0.0) for k in range(n)]
    paths = spark.createDataFrame(flags, "penalty double, date date, g double")
    dates = spark.createDataFrame([(day(k),) for k in (100, 500, 800)], "date date")
    run = walkforward.Run(min_validation=252)
    got = {r.date: (r.penalty, r.g) for r in walkforward.select_penalty(paths, days, dates, run).collect()}
    assert got[day(499)] == (None, None) and got[day(500)] == (50.0, 0.0) and got[day(899)][0] == 50.0


def test_guards(spark, tmp_path):
    def blob(*names):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for name in names:
                z.writestr(name, "a,b\n1,2")
        return spark.createDataFrame([("x.zip", held.getvalue())], "path string, content binary")

    assert [tuple(r) for r in readers.records_from_zips(blob("read.me", "DAY.CSV"), ["a", "b"]).collect()] == [("1", "2")]
    with pytest.raises(Exception, match="CSV members"):
        readers.records_from_zips(blob("a.csv", "b.csv"), ["a", "b"]).collect()
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    assert readers.assert_rows(rows, F.col("k") > 0, "bad").count() == 2
    with pytest.raises(Exception, match="rows of another date"):
        readers.assert_rows(rows, F.col("k") > 1, "rows of another date").collect()
    path = f"{tmp_path}/t"
    spark.createDataFrame([(dt.date(2001, 1, 2),)], "d date").coalesce(1).write.parquet(path)
    file = next(p for p in (tmp_path / "t").iterdir() if p.suffix == ".parquet")
    found = operations.manifest(spark, f"{path}/*.parquet", "d").first()
    assert (found.file, found.sha256, found.rows) == (file.name, hashlib.sha256(file.read_bytes()).hexdigest(), 1)
