"""Data-quality checks, each a small table of offending rows, and one report of all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import weekdays_between
from tidemark.operators import joins as J
from tidemark.plans import adapters as A
from tidemark.plans.adapters import sql
from tidemark.registry import query

D = DataFrame
X = SparkSession


def calendar_mismatches(traded: D, reference: D, gaps: list[str] = ()) -> D:
    """Days that only one calendar has, within the traded calendar's range, minus documented gaps."""
    span = traded.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    known = reference.join(F.broadcast(span)).where(F.col("date").between(F.col("a"), F.col("b"))).select("date")
    out = J.mismatches(traded, known, "date")
    return out.where(~F.col("date").isin([F.lit(g).cast("date") for g in gaps])) if gaps else out


def settlement_gaps(settles: D, closes: D, tolerance: float = 0.05) -> D:
    """Expiry settlements that differ from the index close by more than the tolerance; a missing close fails."""
    rows = settles.join(closes, "date", "left")
    ok = F.abs(F.try_divide(F.col("settle"), F.col("close")) - 1) <= tolerance
    return rows.where(~F.coalesce(ok, F.lit(False))).select("date", "settle", "close")


def ratio_problems(rows: D, fall: float = 1e-4, band: tuple[float, float] = (0.003, 0.03), min_rows: int = 200) -> D:
    """``(kind, at, value)``: falls of the total-return to price ratio, and years whose growth leaves the band.

    A year counts if it has ``min_rows`` rows; its growth is from the first to the last day by date.
    """
    w = Window.partitionBy(F.lit(1)).orderBy("date")
    ratio = rows.withColumn("ratio", F.col("tri") / F.col("price")).withColumn("change", F.col("ratio") / F.lag("ratio").over(w) - 1)
    falls = ratio.where(F.col("change") < -fall).select(F.lit("fall").alias("kind"), "date", F.col("change").alias("value"))
    years = ratio.groupBy(F.trunc("date", "YYYY").alias("date")).agg(
        F.count("ratio").alias("n"), (F.max_by("ratio", "date") / F.min_by("ratio", "date") - 1).alias("value")
    )
    years = years.where((F.col("n") >= min_rows) & ~F.col("value").between(*band)).select(F.lit("year").alias("kind"), "date", "value")
    return falls.unionByName(years)


def parity_deviation(chain: D, forward: D) -> D:
    """Per day, at the traded strike nearest the forward: |call - put - (forward - strike)| over the forward."""
    rows = chain.where("vc > 0 and vp > 0").join(forward, "date")
    gap = F.abs(F.col("cc") - F.col("cp") - (F.col("fut") - F.col("strike"))) / F.col("fut")
    return rows.groupBy("date").agg(F.min_by(gap, J.nearest(F.col("strike"), F.col("fut"))).alias("deviation"))


def long_gaps(days: D, most: int = 4) -> D:
    """Gaps between consecutive dates of more than ``most`` weekdays."""
    rows = J.next_in_calendar(days, keys=[F.lit(1)]).where("next_date is not null")
    return rows.withColumn("n", weekdays_between(F.col("date"), F.col("next_date"))).where(F.col("n") > most)


def source_conflicts(rows: D, tolerance: float = 0.005) -> D:
    """Dates on which sources differ by more than the tolerance."""
    out = rows.groupBy("date").agg((F.max("yield_pct") - F.min("yield_pct")).alias("spread"), F.count(F.lit(1)).alias("n"))
    return out.where((F.col("n") > 1) & (F.col("spread") > tolerance))


def expiry_problems(expiries: D, days: D) -> D:
    """``(kind, date)``: months without exactly one expiry, and expiries that are no trading day."""
    months = days.agg(F.trunc(F.min("date"), "MM").alias("a"), F.trunc(F.max("date"), "MM").alias("b"))
    spine = months.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("date"))
    counts = expiries.groupBy(F.trunc("expiry", "MM").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    bad = spine.join(counts, "date", "left").where(F.coalesce("n", F.lit(0)) != 1).select(F.lit("month").alias("kind"), "date")
    off = expiries.select(F.col("expiry").alias("date")).join(days, "date", "left_anti").select(F.lit("holiday").alias("kind"), "date")
    return bad.unionByName(off)


def report(checks: dict[str, D]) -> D:
    """``(check, n_bad)`` of all checks, in one job."""
    parts = [c.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(k).alias("check"), "n_bad") for k, c in checks.items()]
    return reduce(DataFrame.unionByName, parts)


def passed(rows: D) -> bool:
    """Whether no check of a report has an offending row; the command line exits with an error otherwise."""
    return rows.where("n_bad > 0").limit(1).count() == 0


@query("chk1_calendar", sql("SELECT date, 'a' AS side FROM price WHERE date NOT IN (SELECT date FROM tri) UNION ALL SELECT date, 'b' FROM tri WHERE date NOT IN (SELECT date FROM price) AND date BETWEEN (SELECT min(date) FROM price) AND (SELECT max(date) FROM price)", "price", "tri"))
def chk1(s: X, d: str) -> D:
    return calendar_mismatches(A.price(s, d).select("date"), A.tri(s, d).select("date"))


@query("chk2_settlement", sql("SELECT p.date, round(p.price, 4) AS settle, round(t.tri, 4) AS close FROM price p LEFT JOIN tri t USING (date) WHERE p.date IN (SELECT expiry FROM expiries) AND NOT coalesce(abs(p.price / t.tri - 1) <= 0.3, false)", "price", "tri", "expiries"))
def chk2(s: X, d: str) -> D:
    ends = A.monthly_expiries(A.forward(s, d)).select(F.col("expiry").alias("date"))
    settles = A.price(s, d).join(ends, "date", "left_semi").select("date", F.col("price").alias("settle"))
    out = settlement_gaps(settles, A.tri(s, d).select("date", F.col("tri").alias("close")), 0.3)
    return out.select("date", F.round("settle", 4).alias("settle"), F.round("close", 4).alias("close"))


@query("chk3_ratio", sql("""SELECT 'fall' AS kind, date, round(c, 6) AS value FROM (SELECT date, x / lag(x) OVER (ORDER BY date) - 1 AS c FROM (SELECT p.date, t.tri / p.price AS x FROM price p JOIN tri t USING (date))) WHERE c < -0.5
  UNION ALL SELECT 'year', date_trunc('year', date)::DATE, round(arg_max(x, date) / arg_min(x, date) - 1, 6) AS v FROM (SELECT p.date, t.tri / p.price AS x FROM price p JOIN tri t USING (date)) GROUP BY 2 HAVING count(*) >= 200 AND NOT arg_max(x, date) / arg_min(x, date) - 1 BETWEEN 0.003 AND 0.03""", "price", "tri"))
def chk3(s: X, d: str) -> D:
    rows = A.price(s, d).select("date", "price").join(A.tri(s, d).select("date", "tri"), "date")
    return ratio_problems(rows, fall=0.5).select("kind", "date", F.round("value", 6).alias("value"))


@query("chk4_parity", sql("SELECT date, round(min_by(abs(cc - cp - (fut - strike)) / fut, (round(abs(strike - fut), 9), strike)) + 1e-9, 6) AS deviation FROM (SELECT p.date, p.strike, max(CASE WHEN opt_type = 'CE' THEN close END) AS cc, max(CASE WHEN opt_type = 'PE' THEN close END) AS cp FROM panel p GROUP BY ALL) JOIN forward USING (date) WHERE cc IS NOT NULL AND cp IS NOT NULL GROUP BY date", "forward"))
def chk4(s: X, d: str) -> D:
    from tidemark.plans.strategies import chain

    return parity_deviation(chain(A.panel(s, d)), A.forward(s, d)).select("date", F.round(F.col("deviation") + 1e-9, 6).alias("deviation"))


@query("chk5_long_gaps", "WITH c AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders WHERE o_orderpriority = '1-URGENT'), g AS (SELECT date, lead(date) OVER (ORDER BY date) AS next_date FROM c) SELECT date, next_date, n FROM (SELECT *, (SELECT count(*) FROM generate_series(date, next_date - INTERVAL 1 DAY, INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6)::INT AS n FROM g WHERE next_date IS NOT NULL) WHERE n > 2")
def chk5(s: X, d: str) -> D:
    from tidemark.session import table

    days = table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("date")).distinct()
    return long_gaps(days, 2)


@query("chk6_source_conflicts", sql("SELECT date, round(max(yield_pct) - min(yield_pct), 6) AS spread, count(*) AS n FROM auctions_by_source GROUP BY date HAVING count(*) > 1 AND max(yield_pct) - min(yield_pct) > 0.25", "auctions_by_source"))
def chk6(s: X, d: str) -> D:
    return source_conflicts(A.auctions_by_source(s, d), 0.25).select("date", F.round("spread", 6).alias("spread"), "n")


@query("chk7_expiries", sql("SELECT 'holiday' AS kind, last_day(expiry) AS date FROM expiries WHERE last_day(expiry) NOT IN (SELECT date FROM forward)", "expiries"))
def chk7(s: X, d: str) -> D:
    rows = A.forward(s, d)
    labels = A.monthly_expiries(rows).select(F.last_day("expiry").alias("expiry"))
    return expiry_problems(labels, rows.select("date"))


def _all_checks(s: X, d: str) -> dict[str, D]:
    """The offending rows of every check."""
    return {
        "calendar": chk1(s, d),
        "settlement": chk2(s, d),
        "ratio": chk3(s, d),
        "parity": chk4(s, d).where("deviation > 0.05"),
        "gaps": chk5(s, d),
        "sources": chk6(s, d),
        "expiries": chk7(s, d),
    }


def _report_sql() -> str:
    from tidemark.registry import SQL

    of = {"calendar": "chk1_calendar", "settlement": "chk2_settlement", "ratio": "chk3_ratio", "parity": "chk4_parity", "gaps": "chk5_long_gaps", "sources": "chk6_source_conflicts", "expiries": "chk7_expiries"}
    return " UNION ALL ".join(f"SELECT '{k}' AS \"check\", (SELECT count(*) FROM ({SQL[v]}){' WHERE deviation > 0.05' if k == 'parity' else ''}) AS n_bad" for k, v in of.items())


@query("chk8_report", _report_sql())
def chk8(s: X, d: str) -> D:
    return report(_all_checks(s, d))
