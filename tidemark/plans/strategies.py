"""Strategies: the index switch, the straddle plan and its account, implied volatility, costs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import straddle_iv_udf
from tidemark.operators import windows as W
from tidemark.operators.joins import asof, in_interval, nearest
from tidemark.plans.adapters import cycles, monthly_expiries

# Cost of selling and buying as shares of the premium.
SELL_COST, BUY_COST = 0.0019204, 0.0004504
TIERS = {"low": 0.5, "mid": 1.0, "high": 2.0}


def switch_returns(days: DataFrame, lag: int, buy: Column | float, sell: Column | float, keys: list[str] | None = None) -> DataFrame:
    """Returns of holding the index unless the gate, ``lag`` days ago, was 1; then cash.

    ``days`` has date, tri, rf and g by ``keys`` (default series_id). A missing gate means invested.
    """
    w = W.by_date(*(keys or ["series_id"]))
    # lag 0 reads the same day's gate at the close
    after = 1 - F.coalesce(F.lag(F.coalesce("g", F.lit(0.0)), lag).over(w), F.lit(0.0))
    rows = days.withColumn("ret", W.simple_return(F.col("tri"), w)).withColumn("after", after)
    rows = rows.withColumn("held", F.coalesce(F.lag("after").over(w), F.lit(1.0)))
    buy, sell = (c if isinstance(c, Column) else F.lit(c) for c in (buy, sell))
    cost = F.greatest(F.col("after") - F.col("held"), F.lit(0.0)) * buy + F.greatest(F.col("held") - F.col("after"), F.lit(0.0)) * sell
    r = F.col("held") * F.col("ret") + (1 - F.col("held")) * F.col("rf") - cost
    return rows.withColumn("r", r).drop("ret", "after", "held")


def switch_grid(days: DataFrame, grid: DataFrame) -> DataFrame:
    """``switch_returns`` for every row (lag, cost, ...) of a small parameter table, in one plan."""
    names = grid.columns
    lags = [r.lag for r in grid.select("lag").distinct().collect()]
    parts = []
    for lag in lags:
        rows = days.join(F.broadcast(grid.where(F.col("lag") == lag)))
        parts.append(switch_returns(rows, lag, F.col("cost"), F.col("cost"), ["series_id", *names]))
    return reduce(DataFrame.unionByName, parts)


def chain(panel: DataFrame) -> DataFrame:
    """``(date, strike, sc, sp, cc, cp, vc, vp)``: settle, close and volume of calls and puts."""

    def of(kind: str, column: str) -> Column:
        return F.max(F.when(F.col("opt_type") == kind, F.col(column)))

    return panel.groupBy("date", "strike").agg(
        of("CE", "settle").alias("sc"), of("PE", "settle").alias("sp"), of("CE", "close").alias("cc"), of("PE", "close").alias("cp"),
        F.coalesce(of("CE", "volume"), F.lit(0.0)).alias("vc"), F.coalesce(of("PE", "volume"), F.lit(0.0)).alias("vp"),
    )


def plan_cycles(panel: DataFrame, forward: DataFrame, max_gap: float = 0.02) -> DataFrame:
    """One row a cycle: entry, expiry, forward, the nearest strike with both legs traded, premium, payoff, status.

    Ties between strikes go to the lower one. The status is ``no liquid pair``, ``strike too far`` (beyond
    ``max_gap`` of the forward) or ``ok``. A missing settlement leaves the payoff NULL.
    """
    own = chain(panel).where("vc > 0 and vp > 0").join(forward, "date")
    near = nearest(F.col("strike"), F.col("fut"))
    atm = own.groupBy(F.col("date").alias("entry")).agg(
        F.min_by("strike", near).alias("strike"), F.min_by(F.col("cc") + F.col("cp"), near).alias("premium")
    )
    start = forward.select(F.col("date").alias("entry"), F.col("fut").alias("forward"))
    end = forward.select(F.col("date").alias("expiry"), F.col("fut").alias("__settle"))
    rows = cycles(forward).join(start, "entry", "left").join(end, "expiry", "left").join(atm, "entry", "left")
    gap = F.abs(F.col("strike") - F.col("forward"))
    status = F.when(F.col("strike").isNull(), "no liquid pair").when(gap > max_gap * F.col("forward"), "strike too far").otherwise("ok")
    return rows.select(
        "cycle", "entry", "expiry", "forward", "strike", "premium", F.abs(F.col("__settle") - F.col("strike")).alias("payoff"), status.alias("status")
    )


def plan_days(panel: DataFrame, forward: DataFrame, plan: DataFrame, rf: DataFrame) -> DataFrame:
    """The calendar with each day's cycle, mark and exit price.

    The mark is the two settles' sum, the exit price the traded close (else the settle) of each leg, a
    missing leg counting 0; both are carried over days without the leg, with the last day's traded status.
    """
    live = plan.where("status = 'ok'")
    days = in_interval(forward.select("date"), live, "date", "entry", "expiry")
    days = days.join(chain(panel), ["date", "strike"], "left")
    w = W.by_date("cycle")
    call = F.when(F.col("vc") > 0, F.col("cc")).otherwise(F.col("sc"))
    put = F.when(F.col("vp") > 0, F.col("cp")).otherwise(F.col("sp"))
    exit_px = F.coalesce(W.forward_fill(call, w), F.lit(0.0)) + F.coalesce(W.forward_fill(put, w), F.lit(0.0))
    days = days.select(
        "date", "cycle", (F.col("date") == F.col("entry")).alias("is_entry"), (F.col("date") == F.col("expiry")).alias("is_expiry"),
        "forward", "premium", "payoff", W.forward_fill(F.col("sc") + F.col("sp"), w).alias("mark"), exit_px.alias("exit_px"),
    )
    out = forward.select("date").join(days, "date", "left").join(rf, "date", "left")
    return out.withColumns({"rf": F.coalesce("rf", F.lit(0.0)), **{c: F.coalesce(c, F.lit(False)) for c in ("is_entry", "is_expiry")}})


def simulate(days: DataFrame, members: list[str], lag: int, buy: float, sell: float) -> DataFrame:
    """``(members..., date, value)``: the account of a seller of straddles, one fold over the days of each member.

    A day accrues cash, settles at expiry or buys back on the signal, then sells a new straddle on an entry
    day without position or signal. The signal is the gate ``lag`` days ago, 0 if missing.
    """
    w = W.by_date(*members)
    rows = days.withColumn("signal", F.coalesce(F.lag(F.coalesce("g", F.lit(0.0)), lag).over(w), F.lit(0.0)))
    fields = ["date", "is_entry", "is_expiry", "forward", "premium", "payoff", "mark", "exit_px", "rf", "signal"]
    path = rows.groupBy(*members).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("path"))
    zero = F.struct(F.lit(1.0).alias("cash"), F.lit(0.0).alias("units"), F.expr("cast(array() as array<struct<date:date,value:double>>)").alias("out"))

    def step(acc: Column, day: Column) -> Column:
        cash, units = acc["cash"] * (1 + day["rf"]), acc["units"]
        closes = (units > 0) & (day["is_expiry"] | (day["signal"] == 1))
        paid = F.when(day["is_expiry"], units * day["payoff"]).otherwise(units * day["exit_px"] * (1 + buy))
        cash2, units2 = F.when(closes, cash - paid).otherwise(cash), F.when(closes, F.lit(0.0)).otherwise(units)
        opens = day["is_entry"] & (units2 == 0) & (day["signal"] != 1)
        sold = cash2 / day["forward"]
        cash3 = F.when(opens, cash2 + sold * day["premium"] * (1 - sell)).otherwise(cash2)
        units3 = F.when(opens, sold).otherwise(units2)
        value = F.when(units3 > 0, cash3 - units3 * day["mark"]).otherwise(cash3)
        row = F.array(F.struct(day["date"].alias("date"), value.alias("value")))
        return F.struct(cash3.alias("cash"), units3.alias("units"), F.concat(acc["out"], row).alias("out"))

    folded = path.select(*members, F.aggregate("path", zero, step)["out"].alias("out"))
    return folded.select(*members, F.explode("out").alias("o")).select(*members, F.col("o.date").alias("date"), F.col("o.value").alias("value"))


def atm_iv(panel: DataFrame, forward: DataFrame, auctions: DataFrame, scale: float = 100.0) -> DataFrame:
    """``(date, target, strike, iv)``: Black-76 volatility of the nearest pair, for the first expiry 7 days ahead or later.

    Pairs of traded closes are preferred; days without one use settles. The yield is the latest known.
    """
    ends = monthly_expiries(forward).select(F.col("expiry").alias("at"), F.col("expiry").alias("target"))
    days = asof(forward.withColumn("at", F.date_add("date", 7)), ends, "at", "target", forward=True).where("target is not null")
    legs = chain(panel).where("sc is not null and sp is not null").join(days, "date")
    traded = F.col("vc").cast("double") * F.col("vp") > 0
    price = F.when(traded, F.col("cc") + F.col("cp")).otherwise(F.col("sc") + F.col("sp"))
    order = F.struct((~traded).alias("a"), nearest(F.col("strike"), F.col("fut")).alias("b"))
    atm = legs.groupBy("date", "target", "fut").agg(F.min_by("strike", order).alias("strike"), F.min_by(price, order).alias("price"))
    atm = asof(atm, auctions, "date", "yield_pct")
    t = F.datediff("target", "date") / 365.0
    iv = straddle_iv_udf(F.col("price") / scale, F.col("fut"), F.col("strike"), t, F.coalesce(F.col("yield_pct") / 100, F.lit(0.0)))
    return atm.select("date", "target", "strike", iv.alias("iv"))


def clip(rows: DataFrame, first: str, last: str) -> DataFrame:
    return rows.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def cost_table(spark: SparkSession) -> DataFrame:
    rows = [(t, side, base, base * k) for t, k in TIERS.items() for side, base in (("buy", BUY_COST), ("sell", SELL_COST))]
    return spark.createDataFrame(rows, "tier string, side string, base double, cost double")


def align_expiries(panel: DataFrame, futures: DataFrame) -> DataFrame:
    """Replace expiry labels by the last day on which the month's futures traded.

    ``futures`` has (date, expiry label). A month whose label lies after all data is open and stays as it is.
    """
    last = futures.agg(F.max("date").alias("last"))
    mapping = futures.groupBy("expiry").agg(F.max(F.when(F.trunc("date", "MM") == F.trunc("expiry", "MM"), F.col("date"))).alias("__to"))
    mapping = mapping.join(F.broadcast(last)).where("expiry <= last").select("expiry", "__to")
    return panel.join(mapping, "expiry", "left").withColumn("expiry", F.coalesce("__to", "expiry")).drop("__to")
