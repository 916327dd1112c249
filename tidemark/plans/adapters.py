"""Driver tables seen as daily series, panels, auctions and calendars, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import windows as W
from tidemark.operators.joins import asof
from tidemark.session import table

#: SQL of the same views, by name; a view may use those above it.
CTE: dict[str, tuple[str, list[str]]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTE[name] = (body, list(needs))


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` under WITH the named views and those that they need."""
    done: list[str] = []

    def add(name: str) -> None:
        for x in CTE[name][1]:
            add(x)
        if name not in done:
            done.append(name)

    for name in names:
        add(name)
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(f"{n} AS ({CTE[n][0]})" for n in done) + "\n" + body


cte("prices", "SELECT l_returnflag AS series_id, l_shipdate::DATE AS date, sum(l_extendedprice * (1 - l_discount)) AS price FROM lineitem GROUP BY ALL")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily price of three series (return flags)."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_returnflag").alias("series_id"), F.to_date("l_shipdate").alias("date")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price")
    )


cte("price", "SELECT 'ALL' AS series_id, l_shipdate::DATE AS date, sum(l_extendedprice * (1 - l_discount)) AS price FROM lineitem GROUP BY ALL")


def price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily price of the one series ALL."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.lit("ALL").alias("series_id"), F.to_date("l_shipdate").alias("date")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price")
    )


cte("tri", "SELECT 'ALL' AS series_id, o_orderdate::DATE AS date, sum(o_totalprice) AS tri FROM orders GROUP BY ALL")


def tri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily total-return index of the series ALL."""
    rows = table(spark, sf_dir, "orders")
    return rows.groupBy(F.lit("ALL").alias("series_id"), F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("tri"))


cte(
    "auctions_by_source",
    "SELECT date_trunc('month', l_shipdate)::DATE AS date, l_returnflag AS source, avg(l_tax) * 100 + 0.0 AS yield_pct FROM lineitem GROUP BY ALL",
)


def auctions_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly yields in percent from three sources."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.trunc(F.to_date("l_shipdate"), "MM").alias("date"), F.col("l_returnflag").alias("source")).agg(
        (F.avg("l_tax") * 100 + F.lit(0.0)).alias("yield_pct")
    )


cte(
    "auctions",
    "SELECT date, arg_min(yield_pct, CASE source WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS yield_pct FROM auctions_by_source GROUP BY date",
    "auctions_by_source",
)


def auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One yield a month, of the first source in the order R, A, N."""
    rank = F.when(F.col("source") == "R", 0).when(F.col("source") == "A", 1).otherwise(2)
    return auctions_by_source(spark, sf_dir).groupBy("date").agg(F.min_by("yield_pct", rank).alias("yield_pct"))


cte(
    "rf",
    """SELECT p.date, a.yield_pct / 100 * datediff('day', p.prev, p.date) / 365.0 AS rf
       FROM (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM price) p ASOF LEFT JOIN auctions a ON p.prev >= a.date""",
    "price",
    "auctions",
)


def cash_return(calendar: DataFrame, auction: DataFrame) -> DataFrame:
    """``(date, rf)``: the yield known on the previous trading day, for the days since, over 365.

    NULL on the first day and before the first auction.
    """
    days = calendar.select("date").distinct()
    prev = F.lag("date").over(Window.partitionBy(F.lit(1)).orderBy("date"))
    known = asof(days.withColumn("on", F.col("date")), auction.select(F.col("date").alias("on"), "yield_pct"), "on", "yield_pct")
    w = Window.partitionBy(F.lit(1)).orderBy("date")
    return known.select(
        "date", (F.lag("yield_pct").over(w) / 100 * F.datediff("date", prev) / 365.0).alias("rf")
    )


def rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cash_return(price(spark, sf_dir), auctions(spark, sf_dir))


cte("rets", "SELECT series_id, date, price, ln(price) - ln(lag(price) OVER (PARTITION BY series_id ORDER BY date)) AS r FROM prices", "prices")
cte("ret", "SELECT date, price, ln(price) - ln(lag(price) OVER (ORDER BY date)) AS r FROM price", "price")


def rets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices(spark, sf_dir).withColumn("r", W.log_return(F.col("price"), W.by_date("series_id")))


def ret(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price(spark, sf_dir).withColumn("r", W.log_return(F.col("price"), W.by_date("series_id")))


cte(
    "panel",
    """SELECT l_shipdate::DATE AS date, ceil(p_size / 10.0) * 10 AS strike, CASE WHEN l_linestatus = 'O' THEN 'CE' ELSE 'PE' END AS opt_type,
              sum(l_extendedprice) / sum(l_quantity) AS close, max(p_retailprice) AS settle, sum(l_quantity) AS volume
       FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option rows: one per date, strike and type."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(
        F.to_date("l_shipdate").alias("date"),
        (F.ceil(F.col("p_size") / 10.0) * 10).cast("double").alias("strike"),
        F.when(F.col("l_linestatus") == "O", "CE").otherwise("PE").alias("opt_type"),
    ).agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"),
        F.max("p_retailprice").alias("settle"),
        F.sum("l_quantity").alias("volume"),
    )


cte("forward", "SELECT date, avg(strike) AS fut FROM panel GROUP BY date", "panel")


def forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The future's price on each date: the mean strike."""
    return panel(spark, sf_dir).groupBy("date").agg(F.avg("strike").alias("fut"))


cte("expiries", "SELECT max(date) AS expiry FROM forward GROUP BY date_trunc('month', date)", "forward")


def monthly_expiries(calendar: DataFrame) -> DataFrame:
    """The last date of the calendar in each month."""
    return calendar.groupBy(F.trunc("date", "MM").alias("m")).agg(F.max("date").alias("expiry")).select("expiry")


cte(
    "cycles",
    """SELECT row_number() OVER (ORDER BY e.expiry) AS cycle, n.entry, e.next_expiry AS expiry
       FROM (SELECT expiry, lead(expiry) OVER (ORDER BY expiry) AS next_expiry FROM expiries) e
       JOIN (SELECT date, lead(date) OVER (ORDER BY date) AS entry FROM forward) n ON n.date = e.expiry
       WHERE e.next_expiry IS NOT NULL""",
    "expiries",
)


def cycles(forwards: DataFrame) -> DataFrame:
    """``(cycle, entry, expiry)``: from the trading day after an expiry to the next expiry."""
    one = Window.partitionBy(F.lit(1))
    nexts = forwards.select("date", F.lead("date").over(one.orderBy("date")).alias("entry"))
    ends = monthly_expiries(forwards).withColumn("next_expiry", F.lead("expiry").over(one.orderBy("expiry")))
    rows = ends.where("next_expiry is not null").join(nexts, F.col("expiry") == F.col("date"))
    return rows.select(F.row_number().over(one.orderBy("expiry")).cast("long").alias("cycle"), "entry", F.col("next_expiry").alias("expiry"))


cte("calendar", "SELECT DISTINCT l_shipdate::DATE AS date FROM lineitem")


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
