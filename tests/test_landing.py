"""Landing files of a range, sources, sinks and live snapshots."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.plans.operations import snapshot
from tidemark.sources import readers

DAY = dt.date(2024, 1, 1)


def days(*n):
    return [DAY + dt.timedelta(k) for k in n]


def test_range_lands_marks_and_resumes(tmp_path):
    asked = []

    def get(day):
        asked.append(day)
        return None if day in days(1, 8) else b"x"

    end, today = DAY + dt.timedelta(9), DAY + dt.timedelta(10)
    done = readers.download_range(get, str(tmp_path), DAY, end, today)
    assert done == {"landed": days(0, 2, 3, 4, 5, 6, 7, 9), "missing": days(1), "pending": days(8)}
    asked.clear()
    assert readers.download_range(get, str(tmp_path), DAY, end, today) == {"landed": [], "missing": [], "pending": days(8)}
    assert asked == days(8) and not list(tmp_path.glob("*.part*"))


def test_a_failed_day_leaves_no_file(tmp_path):
    def get(day):
        raise OSError("lost")

    with pytest.raises(OSError):
        readers.download_range(get, str(tmp_path), DAY, DAY, DAY)
    assert not list(tmp_path.iterdir())


def test_years_keep_the_first_of_equal_dates(spark):
    def rows(a, b):
        return spark.createDataFrame([(a, int(a[:4])), ("2000-06-01", int(a[:4]))], "date string, v int")

    got = readers.fetch_years(rows, 1999, 2001)
    assert sorted(map(tuple, got.collect())) == [("1999-01-01", 1999), ("2000-01-01", 2000), ("2000-06-01", 1999), ("2001-01-01", 2001)]


def test_sources_must_have_rows_and_the_right_format(spark):
    one = spark.range(2)
    assert readers.fetch_sources({"a": lambda: one, "b": lambda: one}).groupBy("source").count().count() == 2
    with pytest.raises(ValueError, match="'b'"):
        readers.fetch_sources({"a": lambda: one, "b": lambda: one.where("id > 5")})
    assert readers.checked_body(b"PK\x03\x04..", "xlsx")
    with pytest.raises(ValueError, match="html"):
        readers.checked_body(b"<html>", "xlsx")


def test_sinks(spark, tmp_path):
    readers.write_gzip_csv(spark.range(3), str(tmp_path / "csv"))
    assert list((tmp_path / "csv").glob("*.csv.gz"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    for n in (1, 2, 2):
        readers.append_snapshot(spark.range(n), str(tmp_path / "snap"), dt.datetime(2024, 1, n, 9, 30))
    assert spark.read.parquet(str(tmp_path / "snap")).groupBy("snapshot_date").count().orderBy("snapshot_date").collect() == [(dt.date(2024, 1, 1), 1), (dt.date(2024, 1, 2), 2)]


def test_snapshot_asks_in_chunks(spark):
    calls, pauses = [], []
    held = spark.createDataFrame([("a", 25), ("b", 25), ("c", 50)], "symbol string, lot_size int")

    def quotes(symbols):
        calls.append(symbols)
        level = {"price": 10.0, "quantity": 5.0}
        return [{"symbol": s, "depth": {"buy": [level], "sell": [level | {"price": 12.0}]}} for s in symbols if s != "b"]

    schema = "symbol string, depth struct<buy: array<struct<price: double, quantity: double>>, sell: array<struct<price: double, quantity: double>>>"
    at = dt.datetime(2024, 1, 1, 9, 30, tzinfo=dt.timezone(dt.timedelta(hours=5, minutes=30)))
    got = snapshot(spark, quotes, held, schema, at, lambda: pauses.append(1), size=2)
    rows = {r.symbol: r for r in got.withColumn("at", F.date_format("at", "HH:mm")).collect()}
    assert calls == [["a", "b"], ["c"]] and len(pauses) == 1
    assert rows["a"].mid == 11 and rows["b"].mid is None and rows["c"].lot_size == 50 and rows["a"].at == "04:00"
    with pytest.raises(ValueError, match="zone"):
        snapshot(spark, quotes, held, schema, at.replace(tzinfo=None), lambda: None)
