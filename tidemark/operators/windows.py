"""Causal operators on daily series: columns over a window partitioned by series, ordered by date.

A missing value is NULL throughout. Each function returns a Column, so several of them share one
shuffle and one sort when they are selected together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_date(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def log_return(price: Column, w: WindowSpec) -> Column:
    return F.log(price) - F.log(F.lag(price).over(w))


def simple_return(price: Column, w: WindowSpec) -> Column:
    return F.try_divide(price, F.lag(price).over(w)) - 1


def shifted(x: Column, k: int, w: WindowSpec, default: float | None = None) -> Column:
    out = F.lag(x, k).over(w)
    return out if default is None else F.coalesce(out, F.lit(default))


def rolling_mean(x: Column, n: int, w: WindowSpec) -> Column:
    """Mean of the last n values, NULL until all n are there."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, F.avg(x).over(frame))


def forward_fill(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(running(w))


def with_ewm(df: DataFrame, means: dict[str, tuple[Column, float]], keys: list[str], order: str = "date") -> DataFrame:
    """Add exponentially weighted means: ``{name: (value, halflife)}``, weights halving every halflife rows.

    sum(x 2^(i/h)) / sum(2^(i/h)) over the rows so far, NULL while there are fewer rows than the
    halflife. The exponent restarts in blocks of 500 halflives, as 2^(i/h) would overflow; a row
    needs its own block and the one before, since older weights are below 2^-500.
    """
    df = df.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    for name, (x, halflife) in means.items():
        size = int(500 * halflife)
        df = df.withColumn("__b", F.floor(F.col("__i") / size)).withColumn("__x", x)
        df = df.withColumn("__w", F.when(F.col("__x").isNotNull(), F.pow(F.lit(2.0), F.pmod("__i", F.lit(size)) / F.lit(float(halflife)))))
        own = Window.partitionBy(*keys).orderBy("__b").rangeBetween(-1, -1)
        now = Window.partitionBy(*keys, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        carry = F.lit(2.0 ** (-size / halflife))
        top, bottom = (
            F.coalesce(F.sum(v).over(now), F.lit(0.0)) + F.coalesce(F.sum(v).over(own), F.lit(0.0)) * carry
            for v in (F.col("__x") * F.col("__w"), F.col("__w"))
        )
        mean = F.when(F.col("__i") + 1 >= math.ceil(halflife), F.try_divide(top, bottom))
        df = df.withColumn(name, mean).drop("__b", "__x", "__w")
    return df.drop("__i")


def wealth(r: Column, w: WindowSpec) -> Column:
    return F.exp(F.sum(F.log1p(r)).over(running(w)))


def running_max(x: Column, w: WindowSpec) -> Column:
    return F.max(x).over(running(w))


def run_start(state: Column, w: WindowSpec) -> Column:
    """1 where a maximal run of equal states begins; its running sum numbers the runs."""
    return F.when(F.lag(state).over(w).eqNullSafe(state), 0).otherwise(1)


def realized_vol(r: Column, w: WindowSpec, n: int = 21, year: int = 252) -> Column:
    return F.sqrt(rolling_mean(r * r, n, w) * year)


def majority(gate: Column, k: int, w: WindowSpec) -> Column:
    """1 if more than half of the last k values are 1, NULL until there are k values."""
    mean = rolling_mean(gate, k, w)
    return F.when(mean.isNotNull(), (mean > 0.5).cast("double"))
