"""Operators on hand-made tables: readers, cleaning, strategies, checks, live rows, streams."""

import datetime as dt
import io
import math
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import joins, rows, windows
from tidemark.plans import checks, gates, inference, operations, strategies
from tidemark.plans.adapters import cash_return
from tidemark.session import Settings
from tidemark.sources import readers


def day(n, month=1):
    return dt.date(2001, month, n)


def test_dates(spark):
    text = ["24-OCT-2008", "24 Oct 2008", "3-feb-07", "03-Feb-2007"]
    got = spark.createDataFrame([(t,) for t in text], "t string").select(S.parse_day_month_year(F.col("t")).alias("d")).collect()
    assert [r.d for r in got] == [dt.date(2008, 10, 24)] * 2 + [dt.date(2007, 2, 3)] * 2
    frame = spark.createDataFrame([(day(5), day(12)), (day(6), day(8))], "a date, b date")
    assert [r[0] for r in frame.select(S.weekdays_between(F.col("a"), F.col("b"))).collect()] == [5, 0]


def test_glued_and_damaged_lines(spark):
    lines = spark.createDataFrame([("a,b,c,d,e,f",), ("",), ("g,h,i",)], "value string")
    assert sorted(r.record for r in rows.repair_lines(lines, 3).collect()) == [["a", "b", "c"], ["d", "e", "f"], ["g", "h", "i"]]
    with pytest.raises(Exception, match="damaged line"):
        rows.repair_lines(spark.createDataFrame([("a,b",)], "value string"), 3).collect()


def test_zip_reader(spark):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("x.csv", b"B,A,\n1, x \xff,2,y,\n\n")
    with pytest.raises(Exception, match="damaged line"):
        readers.records_from_zips(spark.createDataFrame([("p", held.getvalue())], "path string, content binary"), ["A", "B"]).collect()
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("x.csv", b"B,A\n1, x \xff,2,y\n\n")
    got = readers.records_from_zips(spark.createDataFrame([("p", held.getvalue())], "path string, content binary"), ["A", "B"]).collect()
    assert sorted((r.A, r.B) for r in got) == [("x �", "1"), ("y", "2")]


def test_json_payloads(spark):
    good = spark.createDataFrame([('[{"v": "-"}, {"v": "2.5"}]',), ('{"d": "[{\\"v\\": \\"3\\"}]"}',)], "p string")
    got = readers.json_records(good, "p", "array<struct<v:string>>").select(rows.sentinel_double(F.col("record.v")).alias("v"))
    assert sorted((r.v is None, r.v) for r in got.collect() if r.v is not None) == [(False, 2.5), (False, 3.0)]
    with pytest.raises(Exception, match="no JSON list"):
        readers.json_records(spark.createDataFrame([("<html>",)], "p string"), "p", "array<struct<v:string>>").collect()


def test_fetch_retries():
    answers, waits = iter([(500, b""), (429, b""), (200, b"ok")]), []
    assert readers.fetch(lambda u: next(answers), "u", sleep=waits.append) == b"ok" and waits == [1, 2]
    assert readers.fetch(lambda u: (404, b""), "u") is None
    with pytest.raises(OSError):
        readers.fetch(lambda u: (403, b""), "u")

    def lost(u):
        raise ConnectionError

    with pytest.raises(OSError):
        readers.fetch(lost, "u", sleep=waits.append)


def test_keep_first_treats_nulls_as_equal(spark):
    frame = spark.createDataFrame([("F", None, 1.0), ("F", None, 3.0), ("O", 10.0, 2.0), ("O", 10.0, 2.0)], "i string, k double, v double")
    got = rows.keep_first(frame, ["i", "k"], F.desc("v")).collect()
    assert sorted((r.i, r.k, r.v) for r in got) == [("F", None, 3.0), ("O", 10.0, 2.0)]


def test_ewm_equals_pandas_beyond_overflow(spark):
    n = 6000
    x = pd.Series([math.sin(k) if k % 7 else None for k in range(n)], dtype=float)
    frame = spark.createDataFrame([("s", k, None if math.isnan(v) else float(v)) for k, v in enumerate(x)], "series_id string, date int, x double")
    got = windows.with_ewm(frame, {"m": (F.col("x"), 2.0)}, ["series_id"]).orderBy("date").toPandas()["m"]
    want = x.ewm(halflife=2, ignore_na=False).mean()
    assert abs(got[100:] - want[100:]).max() < 1e-12


def test_rolling_and_majority(spark):
    gate = [None, None, 1, 1, 1, 0, 0, 1, 1, 1]
    frame = spark.createDataFrame([("s", k, None if g is None else float(g)) for k, g in enumerate(gate)], "series_id string, date int, g double")
    got = frame.select("date", windows.majority(F.col("g"), 3, windows.by_date("series_id")).alias("m")).orderBy("date").collect()
    assert [r.m for r in got] == [None] * 4 + [1, 1, 0, 0, 1, 1]


def test_switch_returns_by_hand(spark):
    gate = [0.0, 1.0, 1.0, 0.0, None, 0.0]
    days = spark.createDataFrame([("s", day(k + 1), 100.0 + k, 0.001, g) for k, g in enumerate(gate)], "series_id string, date date, tri double, rf double, g double")
    got = [r.r for r in strategies.switch_returns(days, lag=1, buy=0.01, sell=0.02).orderBy("date").collect()]
    # positions after each close: 1 1 0 0 1 1; held is the close before
    want = [None, 1 / 100, 1 / 101 - 0.02, 0.001, 0.001 - 0.01, 1 / 104]
    assert got[0] is None and got[1:] == pytest.approx(want[1:])


def test_account_by_hand(spark):
    schema = "member string, date date, is_entry boolean, is_expiry boolean, forward double, premium double, payoff double, mark double, exit_px double, rf double, g double"
    flat = [(True, False), (False, False), (False, True)]
    days = [("m", day(k + 1), e, x, 100.0, 5.0, 3.0, 4.0, 4.5, 0.0, 0.0) for k, (e, x) in enumerate(flat)]
    got = [r.value for r in strategies.simulate(spark.createDataFrame(days, schema), ["member"], 0, 0.01, 0.02).orderBy("date").collect()]
    cash = 1 + 0.01 * 5 * 0.98
    assert got == pytest.approx([cash - 0.04, cash - 0.04, cash - 0.03])
    days = [(*d[:-1], float(k == 1)) for k, d in enumerate(days)]
    got = [r.value for r in strategies.simulate(spark.createDataFrame(days, schema), ["member"], 0, 0.01, 0.02).orderBy("date").collect()]
    assert got == pytest.approx([cash - 0.04, cash - 0.01 * 4.5 * 1.01, cash - 0.01 * 4.5 * 1.01])


def test_cash_return_by_hand(spark):
    days = spark.createDataFrame([(day(5),), (day(8),), (day(9),)], "date date")
    auctions = spark.createDataFrame([(day(5), 6.0), (day(8), 7.0)], "date date, yield_pct double")
    got = [r.rf for r in cash_return(days, auctions).orderBy("date").collect()]
    assert got[0] is None and got[1:] == pytest.approx([0.06 * 3 / 365, 0.07 / 365])


def test_expiry_alignment(spark):
    futures = spark.createDataFrame([(day(30), day(31)), (day(31, 3), day(30, 4))], "date date, expiry date")
    panel = spark.createDataFrame([(day(2), day(31)), (day(3), day(18)), (day(31, 3), day(30, 4))], "date date, expiry date")
    got = {r.date: r.expiry for r in strategies.align_expiries(panel, futures).collect()}
    assert got == {day(2): day(30), day(3): day(18), day(31, 3): day(30, 4)}


def test_interval_join(spark):
    points = spark.createDataFrame([(k,) for k in range(10)], "t int")
    spans = spark.createDataFrame([(1, 2, 4), (2, 6, 6)], "id int, a int, b int")
    got = joins.in_interval(points, spans, "t", "a", "b").collect()
    assert sorted((r.t, r.id) for r in got) == [(2, 1), (3, 1), (4, 1), (6, 2)]


def test_checks_find_planted_defects(spark):
    a, b = (spark.createDataFrame([(d,) for d in days], "date date") for days in ([day(1), day(2), day(9)], [day(1), day(9), day(3), day(30)]))
    assert {(r.date, r.side) for r in checks.calendar_mismatches(a, b).collect()} == {(day(2), "a"), (day(3), "b")}
    assert checks.calendar_mismatches(a, b, ["2001-01-02", "2001-01-03"]).count() == 0
    settle = spark.createDataFrame([(day(1), 100.0), (day(2), 100.0), (day(3), 100.0)], "date date, settle double")
    close = spark.createDataFrame([(day(1), 101.0), (day(2), 120.0)], "date date, close double")
    assert sorted(r.date for r in checks.settlement_gaps(settle, close).collect()) == [day(2), day(3)]
    assert [(r.date, r.n) for r in checks.long_gaps(a, 4).collect()] == [(day(2), 5)]
    report = checks.report({"x": a, "y": a.limit(0)})
    assert {(r.check, r.n_bad) for r in report.collect()} == {("x", 3), ("y", 0)} and not checks.passed(report)


def test_refit_windows(spark):
    frame = spark.range(100).select(F.lit("s").alias("series_id"), F.col("id").alias("pos"), F.col("id").alias("date"), F.col("id").cast("double").alias("v"))
    own = gates.trailing(frame, spark.createDataFrame([(50,), (75,)], "refit long"), 20)
    spans = {r.refit: (r.a, r.b, r.n) for r in own.groupBy("refit").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.count("*").alias("n")).collect()}
    assert spans == {50: (31, 50, 20), 75: (56, 75, 20)}
    gate = gates.percentile_gate(frame, "v", 0.8, first=50, step=25, window=20, min_history=20).orderBy("pos").collect()
    assert [r.g for r in gate[:50]] == [None] * 50 and gate[50].g == 1 and all(r.refit == 75 for r in gate[75:])


def test_holm_and_summary(spark):
    frame = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "t string, p double")
    assert {r.t: round(r.adjusted, 9) for r in inference.holm(frame, "p", "t").collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_quotes_and_orders(spark):
    schema = "symbol string, lot_size int, depth struct<buy:array<struct<price:double,quantity:int>>,sell:array<struct<price:double,quantity:int>>>"
    quotes = spark.createDataFrame([("x", 25, ([(99.0, 1)], [(101.0, 2)])), ("i", 25, ([], []))], schema)
    flat = {r.symbol: r for r in operations.flatten_quotes(quotes).collect()}
    assert (flat["x"].mid, flat["x"].half_spread_pct, flat["x"].bid2) == (100.0, 0.01, None) and flat["i"].mid is None
    order = operations.straddle_legs(operations.flatten_quotes(quotes.where("symbol = 'x'")), "SELL", 0.05, 2).first()
    assert (order.quantity, order.price) == (50, 99.0)
    with pytest.raises(Exception, match="market too wide"):
        operations.straddle_legs(operations.flatten_quotes(quotes), "SELL", 0.05, 2).collect()
    assert operations.blocked({"enabled": True, "lots": False}) == ["lots", "dry run only"]


def test_lock_and_config(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"x\r\ny\n")
    operations.create_lock(spark, f"{tmp_path}/in", str(tmp_path / "lock.json"))
    (tmp_path / "in" / "a.txt").write_bytes(b"x\ny\n")
    operations.verify_lock(spark, f"{tmp_path}/in", str(tmp_path / "lock.json"))
    (tmp_path / "in" / "a.txt").write_bytes(b"z\n")
    with pytest.raises(ValueError):
        operations.verify_lock(spark, f"{tmp_path}/in", str(tmp_path / "lock.json"))
    assert operations.config_hash({"a": 1, "b": 2}) == operations.config_hash({"b": 2, "a": 1})
    assert Settings.from_env({"TIDEMARK_N_BOOT": "7", "OTHER": "x"}).n_boot == 7
    with pytest.raises(ValueError):
        Settings.from_env({"TIDEMARK_N_BOOT": "0"})


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.kernels.hmm import filter_prob
    from tidemark.streaming import online

    frame = spark.createDataFrame([(s, day(k + 1), 0.3 * math.sin(k * (2 if s == "a" else 3))) for s in "ab" for k in range(25)], "series_id string, date date, r double")
    got = online.run_batch_of_stream(spark, frame, online.hmm_filter, f"{tmp_path}/s").orderBy("series_id", "date").toPandas()
    for s, own in frame.toPandas().sort_values("date").groupby("series_id"):
        want, _ = filter_prob(online.MODEL, own["r"].to_numpy())
        assert got.loc[got["series_id"] == s, "p"].to_numpy() == pytest.approx(want, abs=1e-8)


def test_changepoint_stream_equals_batch(spark, tmp_path):
    from tidemark.kernels import bocpd
    from tidemark.streaming import online

    frame = spark.createDataFrame([(s, day(k + 1), 0.01 * math.sin(k * (2 if s == "a" else 3))) for s in "ab" for k in range(28)], "series_id string, date date, r double")
    early, late = (frame.where(f"day(date) {x} 14") for x in ("<=", ">"))
    path = f"{tmp_path}/in"
    for part in (early, late):  # two triggers, so the second starts from the saved state
        part.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(frame.schema).parquet(path)
        sink = online.bocpd_variance(stream, 1e-4).writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append")
        sink.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("series_id", "date").toPandas()
    assert len(got) == 56
    for s, own in frame.toPandas().sort_values("date").groupby("series_id"):
        want = bocpd.variance_path(own["r"].to_numpy(), 1e-4)
        assert got.loc[got["series_id"] == s, "variance"].to_numpy() == pytest.approx(want, rel=1e-12)


def test_entry_without_the_optional_subpackage():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['tidemark.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'win6_ewm' in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
