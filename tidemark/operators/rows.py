"""Row-level operators: deduplication, pivots, sets, cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in the given order; NULL keys are equal to each other."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", place).where("__n = 1").drop("__n")


def by_priority(df: DataFrame, keys: list[str], column: str, ranking: list[str]) -> DataFrame:
    """One row per key: of the source that comes first in ``ranking``; unknown sources come last."""
    rank = reduce(lambda acc, x: F.when(F.col(column) == x[1], x[0]).otherwise(acc), enumerate(ranking), F.lit(len(ranking)))
    return keep_first(df, keys, rank, F.col(column))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_no_rows(df: DataFrame, message: str) -> None:
    """Raise ValueError with the first offending rows, if there are any."""
    bad = df.limit(5).collect()
    if bad:
        raise ValueError(f"{message}: {[r.asDict() for r in bad]}")


def pivot_mean(df: DataFrame, keys: list[str], column: str, values: list[str], measures: list[str]) -> DataFrame:
    """Mean of each measure per value of ``column``, as ``<measure>_<value>``; one aggregate, no pivot pass."""
    return df.groupBy(*keys).agg(
        *[F.avg(F.when(F.col(column) == v, F.col(m))).alias(f"{m}_{v.lower()}") for m in measures for v in values]
    )


def strict_double(c: Column) -> Column:
    """Number of a trimmed string; blank is NULL, anything else that is no number raises."""
    return F.nullif(F.trim(c), F.lit("")).cast("double")


def lenient_double(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def sentinel_double(c: Column, sentinel: str = "-") -> Column:
    return F.nullif(F.trim(c), F.lit(sentinel)).cast("double")


def map_values(c: Column, mapping: dict[str, str]) -> Column:
    """Mapped value; NULL for values that the mapping lacks."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), c)


def trim_all(df: DataFrame) -> DataFrame:
    """Trim column names and string values; columns without a name are dropped."""
    named = [c for c in df.columns if c.strip() and not c.strip().startswith(("Unnamed", "_c"))]
    return df.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip()) for c in named])


def repair_lines(lines: DataFrame, n_fields: int, text: str = "value") -> DataFrame:
    """Split lines that hold several glued records of ``n_fields`` fields; blank lines are dropped.

    A line whose fields are no whole number of records raises.
    """
    fields = F.split(F.col(text), ",")
    n = F.size(fields)
    ok = F.when(
        F.pmod(n, F.lit(n_fields)) != 0,
        F.raise_error(F.concat(F.lit("damaged line: "), F.col(text))),
    ).otherwise(fields)
    starts = F.sequence(F.lit(0), (F.size(ok) / n_fields).cast("int") - 1)
    parts = F.transform(starts, lambda k: F.slice(ok, k * n_fields + 1, n_fields))
    return lines.where(F.trim(F.col(text)) != "").select(*[c for c in lines.columns if c != text], F.explode(parts).alias("record"))
