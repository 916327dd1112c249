"""As-of, calendar and interval joins, written so that no pair of rows is tried in vain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, on: str, value: str, keys: list[str] | None = None, forward: bool = False) -> DataFrame:
    """``left`` with the ``value`` of the latest ``right`` row at or before ``on`` (forward: the first at or after).

    Both sides are stacked and the value is carried along one window: a single shuffle by the keys,
    whatever the number of matches. Rows of ``right`` with a NULL value are skipped; without a match
    the value is NULL. Without keys the whole table is one series.
    """
    keys = keys or []
    cols = left.columns
    lookup = right.select(*keys, on, F.col(value).alias("__v"), F.lit(0).alias("__probe"))
    probe = left.withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__probe", F.lit(1))
    both = probe.unionByName(lookup, allowMissingColumns=True)
    order = [F.col(on).desc() if forward else F.col(on).asc(), F.col("__probe").asc()]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__probe = 1").select(*cols, value)


def next_in_calendar(calendar: DataFrame, date: str = "date", name: str = "next_date", keys: list | None = None) -> DataFrame:
    """The calendar with each date's successor."""
    return calendar.withColumn(name, F.lead(date).over(Window.partitionBy(*(keys or [])).orderBy(date)))


def align(spine: DataFrame, values: DataFrame, on: list[str] | str) -> DataFrame:
    """Values on the spine's rows; NULL where there is none."""
    return spine.join(values, on, "left")


def mismatches(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, with ``side`` (a or b)."""
    left = a.select(key).distinct()
    right = b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("a")).unionByName(
        right.join(left, key, "left_anti").withColumn("side", F.lit("b"))
    )


def in_interval(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Points with the interval that they lie in (bounds included), for intervals that don't overlap.

    The interval with the latest start at or before a point is found as-of; then its end is checked.
    """
    struct = F.struct(*[F.col(c) for c in intervals.columns])
    lookup = intervals.select(F.col(start).alias(at), struct.alias("__iv"))
    found = asof(points, lookup, at, "__iv")
    return found.where(F.col(f"__iv.{end}") >= F.col(at)).select(*points.columns, *[F.col(f"__iv.{c}") for c in intervals.columns])


def nearest(value: Column, target: Column) -> Column:
    """Sort key that puts the value nearest to the target first, ties to the lower value."""
    return F.struct(F.round(F.abs(value - target), 9), value)
