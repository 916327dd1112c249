"""Readers of the supported layouts and payloads, and the sinks."""

from __future__ import annotations

import datetime as dt
import io
import os
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tidemark.operators.rows import repair_lines


@F.pandas_udf(ArrayType(StringType()))
def _zip_lines(content: pd.Series) -> pd.Series:
    def lines(blob: bytes) -> list[str]:
        with zipfile.ZipFile(io.BytesIO(bytes(blob))) as z:
            tables = [n for n in z.namelist() if n.lower().endswith(".csv")]
            if len(tables) != 1:
                raise ValueError(f"a zip holds {len(tables)} CSV members: {z.namelist()}")
            return z.read(tables[0]).decode("utf-8", "replace").splitlines()

    return content.map(lines)


def assert_rows(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """``df`` as it is; a row for which ``ok`` does not hold (or is NULL) makes the job fail with the message and the row."""
    bad = F.raise_error(F.concat(F.lit(message + ": "), F.to_json(F.struct(*df.columns))))
    first = df.columns[0]
    return df.withColumn(first, F.when(F.coalesce(ok, F.lit(False)), F.col(first)).otherwise(bad.cast(df.schema[first].dataType)))


def records_from_zips(blobs: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, all strings, of the one CSV member of each zip in ``content``; glued records are split.

    A zip with no or several CSV members raises; other members are ignored.
    The header line decides the order and number of fields; names are trimmed.
    """
    lines = blobs.select("path", F.posexplode(_zip_lines("content")).alias("nth", "value"))
    head = lines.where("nth = 0").select("path", F.transform(F.split("value", ","), lambda x: F.trim(x)).alias("names"))
    widths = [r.n for r in head.select(F.size("names").alias("n")).distinct().limit(3).collect()]
    if len(widths) > 1:
        raise ValueError(f"the files have headers of {widths} fields")
    if not widths:
        return blobs.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    rows = repair_lines(lines.where("nth > 0").select("path", "value"), widths[0]).join(head, "path")
    cell = [F.trim(F.element_at("record", F.array_position("names", c).cast("int"))).alias(c) for c in columns]
    return rows.select(*cell)


def gz_csv(spark: SparkSession, pattern: str, schema: str, date_in_name: str) -> DataFrame:
    """Gzipped CSV files, all strings, with the date that their path holds."""
    rows = spark.read.schema(schema).option("header", True).csv(pattern)
    return rows.withColumn("date", F.to_date(F.regexp_extract(F.col("_metadata.file_path"), date_in_name, 1)))


def json_records(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Records of a payload that is a list, or an object whose field ``d`` is a list in a string.

    Anything else, such as an HTML error page, raises.
    """
    text = F.trim(F.col(column))
    inner = F.when(text.startswith("["), text).when(text.startswith("{"), F.get_json_object(text, "$.d"))
    parsed = F.from_json(inner, schema, {"mode": "PERMISSIVE"})
    ok = F.when(parsed.isNull(), F.raise_error(F.concat(F.lit("no JSON list: "), F.substring(text, 1, 60)))).otherwise(parsed)
    return df.select(*[c for c in df.columns if c != column], F.explode(ok).alias("record"))


def sheet_records(cells: DataFrame, headers: dict[str, str], sheet: str = "sheet") -> DataFrame:
    """Records of sheets given as cells (sheet, row, col, val): below the row that holds all header texts."""
    found = F.lower(F.trim("val"))
    marks = cells.where(found.isin(*headers.values()))
    head = marks.groupBy(sheet, "row").agg(
        F.count_distinct(found).alias("n"), *[F.min(F.when(found == text, F.col("col"))).alias(f"__{name}") for name, text in headers.items()]
    )
    first = F.row_number().over(Window.partitionBy(sheet).orderBy("row"))
    head = head.where(F.col("n") == len(headers)).withColumn("first", first).where("first = 1").withColumnRenamed("row", "head")
    body = cells.join(head, sheet).where("row > head")
    return body.groupBy(sheet, "row").agg(
        *[F.max(F.when(F.col("col") == F.col(f"__{name}"), F.col("val"))).alias(name) for name in headers]
    ).drop("row")


def regex_records(df: DataFrame, column: str, pattern: str, names: list[str]) -> DataFrame:
    """One row per match of the pattern, its groups as columns; escaped quotes are undone first."""
    text = F.replace(F.col(column), F.lit('\\"'), F.lit('"'))
    groups = [F.regexp_extract_all(text, F.lit(pattern), k + 1) for k in range(len(names))]
    zipped = F.explode(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, names)])).alias("__m")
    return df.select("*", zipped).select(*df.columns, *[F.col(f"__m.{n}").alias(n) for n in names])


def missing_days(landed: DataFrame, date: str = "date") -> DataFrame:
    """Calendar days between the first and the last landed one that have not landed."""
    spine = landed.agg(F.min(date).alias("a"), F.max(date).alias("b")).where("a is not null")
    return spine.select(F.explode(F.sequence("a", "b")).alias(date)).join(landed.select(date).distinct(), date, "left_anti")


def tagged_union(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of all sources with their name in ``source``."""
    out = None
    for name, part in parts.items():
        rows = part.withColumn("source", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def archive_name(date: Column, switch: str) -> Column:
    """File name of a day's archive; the naming changes at the date ``switch``."""
    # The two name patterns of the exchange's files.
    old = F.concat(F.lit("fo"), F.upper(F.date_format(date, "ddMMMyyyy")), F.lit("bhav.csv.zip"))
    new = F.concat(F.lit("BhavCopy_NSE_FO_0_0_0_"), F.date_format(date, "yyyyMMdd"), F.lit("_F_0000.csv.zip"))
    return F.when(date < F.lit(switch).cast("date"), old).otherwise(new)


def rename_layout(df: DataFrame, layouts: tuple[dict[str, str], ...]) -> DataFrame:
    """Rename by the first layout whose columns are all there."""
    for layout in layouts:
        if set(layout) <= set(df.columns):
            return df.withColumnsRenamed(layout)
    raise ValueError(f"no known layout has the columns {df.columns}")


def write_sorted_parquet(df: DataFrame, path: str, *order: str) -> None:
    df.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def append_ledger(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines, fields in alphabetical order."""
    df.select(*sorted(df.columns)).write.mode("append").json(path)


def write_gzip_csv(df: DataFrame, path: str) -> None:
    """Gzipped CSV with a header; the commit protocol shows the folder's files only when all are written."""
    df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def append_snapshot(df: DataFrame, path: str, at: dt.datetime) -> None:
    """Add a snapshot in a folder of its day and time; the same snapshot written again replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/snapshot_date={at:%Y-%m-%d}/snapshot_time={at:%H%M%S}")


def land(path: Path, body: bytes) -> None:
    """Write a file whole or not at all: to a temporary name first, then renamed."""
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + f".part{os.getpid()}")
    part.write_bytes(body)
    os.replace(part, path)


def download_range(
    fetch_day: Callable[[dt.date], bytes | None], folder: str, start: dt.date, end: dt.date, today: dt.date, grace_days: int = 3
) -> dict[str, list[dt.date]]:
    """Land each day's file that is not there yet; what was done with each day asked for.

    ``fetch_day`` gives a day's bytes, or None if the source has no such file. Then an empty marker
    stands for the day, so that it isn't asked for again; the last ``grace_days`` days get none, as
    their files may still come. Days that are there or marked are left alone.
    """
    done: dict[str, list[dt.date]] = {"landed": [], "missing": [], "pending": []}
    for day in (start + dt.timedelta(n) for n in range((end - start).days + 1)):
        path, marker = Path(folder, f"{day}.bin"), Path(folder, f"{day}.missing")
        if path.exists() or marker.exists():
            continue
        body = fetch_day(day)
        if body is not None:
            land(path, body)
            done["landed"].append(day)
        elif (today - day).days > grace_days:
            land(marker, b"")
            done["missing"].append(day)
        else:
            done["pending"].append(day)
    return done


def fetch_years(fetch_years_rows: Callable[[str, str], DataFrame], start: int, end: int, key: str = "date") -> DataFrame:
    """Rows of a source that answers a year at a time, one per ``key``: the first of equal keys in year order."""
    parts = {f"{n:06d}": fetch_years_rows(a, b) for n, (a, b) in enumerate(chunked_years(start, end))}
    rows = tagged_union(parts)
    first = F.row_number().over(Window.partitionBy(key).orderBy("source"))
    return rows.withColumn("__first", first).where("__first = 1").drop("__first", "source")


# The first bytes of the file formats that sources send.
MAGIC = {"xlsx": b"PK\x03\x04", "xls": b"\xd0\xcf\x11\xe0", "pdf": b"%PDF", "gzip": b"\x1f\x8b"}


def checked_body(body: bytes, kind: str) -> bytes:
    """The body, if it begins as its format does; an error page sent in its place raises."""
    if not body.startswith(MAGIC[kind]):
        raise ValueError(f"not a {kind} file: {body[:40]!r}")
    return body


def fetch_sources(sources: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """Rows of all sources, tagged; a source without rows raises."""
    parts = {name: rows() for name, rows in sources.items()}
    empty = [name for name, part in parts.items() if not part.limit(1).count()]
    if empty:
        raise ValueError(f"no rows from {empty}")
    return tagged_union(parts)


def fetch(get, url: str, retries: int = 4, sleep=None) -> bytes | None:
    """Body of a URL by ``get(url) -> (status, body)``: 404 is None, 429, 5xx and lost connections are retried.

    Waits 2^n seconds between attempts; other statuses raise at once.
    """
    import time

    wait = time.sleep if sleep is None else sleep
    for n in range(retries):
        try:
            status, body = get(url)
        except ConnectionError:
            status, body = None, b""
        if status == 200:
            return body
        if status == 404:
            return None
        if status is not None and status != 429 and status < 500:
            raise OSError(f"{url}: status {status}")
        if n + 1 < retries:
            wait(2**n)
    raise OSError(f"{url}: no answer in {retries} attempts")


def chunked_years(start: int, end: int) -> Iterator[tuple[str, str]]:
    """(first, last) day of each year, for sources that answer a year at a time."""
    for y in range(start, end + 1):
        yield f"{y}-01-01", f"{y}-12-31"
