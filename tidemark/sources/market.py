"""Daily derivative files in two layouts to one panel; index, sheet and auction payloads to series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import parse_day_month_year
from tidemark.operators import rows as R
from tidemark.sources.readers import json_records, regex_records, sheet_records

PANEL = (
    "date date, instrument string, expiry date, strike double, opt_type string, open double, high double, low double, "
    "close double, settle double, volume double, oi double, underlying double"
)
COLUMNS = [c.split(" ")[0] for c in PANEL.split(", ")]
KEY = ["date", "instrument", "expiry", "strike", "opt_type"]

# Column names of the old and the new file layout, and their instrument codes.
OLD = {
    "TIMESTAMP": "date", "INSTRUMENT": "instrument", "EXPIRY_DT": "expiry", "STRIKE_PR": "strike", "OPTION_TYP": "opt_type", "OPEN": "open",
    "HIGH": "high", "LOW": "low", "CLOSE": "close", "SETTLE_PR": "settle", "CONTRACTS": "volume", "OPEN_INT": "oi",
}
OLD_SYNONYMS = {"OPTIONTYPE": "OPTION_TYP"}
NEW = {
    "TradDt": "date", "FinInstrmTp": "instrument", "FininstrmActlXpryDt": "expiry", "StrkPric": "strike", "OptnTp": "opt_type", "OpnPric": "open",
    "HghPric": "high", "LwPric": "low", "ClsPric": "close", "SttlmPric": "settle", "TtlTradgVol": "volume", "OpnIntrst": "oi", "UndrlygPric": "underlying",
}
INSTRUMENTS = {"FUTIDX": "FUT", "IDF": "FUT", "OPTIDX": "OPT", "IDO": "OPT"}


def keep_symbol(raw: DataFrame, symbol: str) -> DataFrame:
    """Trimmed rows of index futures and options on the symbol, in either layout."""
    rows = R.trim_all(raw).withColumnsRenamed(OLD_SYNONYMS)
    if "TckrSymb" in rows.columns:
        return rows.where((F.col("TckrSymb") == symbol) & F.col("FinInstrmTp").isin("IDF", "IDO"))
    return rows.where((F.col("SYMBOL") == symbol) & F.col("INSTRUMENT").isin("FUTIDX", "OPTIDX"))


def _date(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date")).otherwise(parse_day_month_year(c))


def normalize(raw: DataFrame, day: Column | None = None) -> DataFrame:
    """The panel columns of an all-string frame of one layout; contracts are unique, the row with most volume stays.

    Rows of another date than ``day`` raise. Futures have no strike or type; blank numbers are NULL and
    other text in a number column raises.
    """
    rows = R.trim_all(raw).withColumnsRenamed(OLD_SYNONYMS)
    layout = NEW if "TckrSymb" in rows.columns else OLD
    missing = [c for c in layout if c not in rows.columns]
    if missing:
        raise ValueError(f"the file lacks {missing}")
    rows = rows.select(*[F.col(c).alias(n) for c, n in layout.items()], *([] if "underlying" in layout.values() else [F.lit(None).cast("string").alias("underlying")]))
    rows = rows.withColumns({c: _date(F.col(c)) for c in ("date", "expiry")})
    if day is not None:
        rows = rows.withColumn("date", F.when(F.col("date") == day, F.col("date")).otherwise(F.raise_error(F.concat(F.lit("row of another date: "), F.col("date").cast("string"))).cast("date")))
    rows = rows.withColumn("instrument", R.map_values(F.col("instrument"), INSTRUMENTS))
    numbers = ["strike", "open", "high", "low", "close", "settle", "volume", "oi", "underlying"]
    rows = rows.withColumns({c: R.strict_double(F.col(c)) for c in numbers})
    option = F.col("instrument") != "FUT"
    rows = rows.withColumns({"strike": F.when(option, F.col("strike")), "opt_type": F.when(option, F.col("opt_type"))})
    return R.keep_first(rows, KEY, F.desc("volume"), *[F.col(c) for c in ("settle", "close", "oi")]).select(*COLUMNS)


def build_panel(spark: SparkSession, patterns: list[str], symbol: str) -> DataFrame:
    """One panel from the landed files of both layouts: one scan a layout, all strings, then a union."""
    parts = [normalize(keep_symbol(spark.read.option("header", True).csv(p), symbol)) for p in patterns]
    if not parts:
        return spark.createDataFrame([], PANEL)
    return reduce(DataFrame.unionByName, parts)


def index_series(df: DataFrame, column: str, date: str, value: str) -> DataFrame:
    """``(date, value)`` of index payloads; ``-`` is a missing value, a repeated date counts once."""
    rows = json_records(df, column, f"array<struct<`{date}`:string,`{value}`:string>>")
    out = rows.select(parse_day_month_year(F.col(f"record.`{date}`")).alias("date"), R.sentinel_double(F.col(f"record.`{value}`")).alias("value"))
    return R.keep_first(out, ["date"], F.col("value").isNull(), F.col("value"))


def auctions_from_sheets(cells: DataFrame, headers: dict[str, str]) -> DataFrame:
    """``(date, yield_pct)`` of sheets given as cells; rows that are no date or no number are notes and go."""
    rows = sheet_records(cells, headers)
    rows = rows.select(F.coalesce(F.col("date").try_cast("date"), parse_try(F.col("date"))).alias("date"), R.lenient_double(F.col("yield_pct")).alias("yield_pct"))
    return rows.na.drop("any")


def parse_try(c: Column) -> Column:
    """``dd-Mon-yyyy`` as a date, anything else NULL."""
    return F.when(c.rlike(r"^\d{1,2}[- ][A-Za-z]{3}[- ]\d{2,4}$"), parse_day_month_year(c))


def auctions_from_html(pages: DataFrame, column: str, tenor: str = "91") -> DataFrame:
    """``(date, yield_pct)`` of JSON objects embedded in a page, of one tenor in days."""
    pattern = r'"date"\s*:\s*"([^"]+)"[^{}]*"tenor"\s*:\s*"?(\d+)"?[^{}]*"yield"\s*:\s*"?([0-9.]+)"?'
    rows = regex_records(pages, column, pattern, ["d", "t", "y"]).where(F.col("t") == tenor)
    return rows.select(F.coalesce(F.col("d").try_cast("date"), parse_try(F.col("d"))).alias("date"), R.strict_double(F.col("y")).alias("yield_pct"))


def stitch(parts: dict[str, DataFrame]) -> DataFrame:
    """One yield a date from several sources, the first in the given order."""
    union = reduce(DataFrame.unionByName, [p.select("date", "yield_pct", F.lit(name).alias("source")) for name, p in parts.items()])
    return R.by_priority(union, ["date"], "source", list(parts))
