"""Queries on windows, features, gates, strategies, metrics and inference over daily series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import windows as W
from tidemark.plans import adapters as A
from tidemark.plans import gates as G
from tidemark.plans import inference as I
from tidemark.plans import strategies as T
from tidemark.plans.adapters import cte, sql
from tidemark.registry import query
from tidemark.session import table

D = DataFrame
X = SparkSession


def w3():
    return W.by_date("series_id")


V = "(PARTITION BY series_id ORDER BY date)"


def q6(c: Column | str) -> Column:
    return F.round(c, 6) + F.lit(0.0)


@query("win1_log_return", sql("SELECT series_id, date, round(r, 6) + 0.0 AS r FROM rets", "rets"))
def win1(s: X, d: str) -> D:
    return A.rets(s, d).select("series_id", "date", q6("r").alias("r"))


@query("win2_pct_change", sql(f"SELECT series_id, date, round(price / lag(price) OVER {V} - 1, 6) + 0.0 AS r FROM prices", "prices"))
def win2(s: X, d: str) -> D:
    return A.prices(s, d).select("series_id", "date", q6(W.simple_return(F.col("price"), w3())).alias("r"))


@query("win3_shift", sql(f"SELECT series_id, date, round(coalesce(lag(price, 2) OVER {V}, 0), 4) AS p2 FROM prices", "prices"))
def win3(s: X, d: str) -> D:
    return A.prices(s, d).select("series_id", "date", F.round(W.shifted(F.col("price"), 2, w3(), 0.0), 4).alias("p2"))


@query(
    "win4_rolling_mean",
    sql("SELECT series_id, date, round(CASE WHEN count(r) OVER w = 21 THEN avg(r) OVER w END, 6) + 0.0 AS m FROM rets WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS 20 PRECEDING)", "rets"),
)
def win4(s: X, d: str) -> D:
    return A.rets(s, d).select("series_id", "date", q6(W.rolling_mean(F.col("r"), 21, w3())).alias("m"))


@query(
    "win5_forward_fill",
    sql(f"SELECT series_id, date, round(last_value(CASE WHEN extract(dow FROM date) = 1 THEN price END IGNORE NULLS) OVER {V}, 4) AS p FROM prices", "prices"),
)
def win5(s: X, d: str) -> D:
    monday = F.when(F.dayofweek("date") == 2, F.col("price"))
    return A.prices(s, d).withColumn("m", monday).select("series_id", "date", F.round(W.forward_fill(F.col("m"), w3()), 4).alias("p"))


def ewm_sql(x: str, h: int, source: str = "i") -> str:
    return f"CASE WHEN i >= {h} THEN sum({x} * pow(2.0, i / {h}.0)) OVER w / sum(CASE WHEN {x} IS NOT NULL THEN pow(2.0, i / {h}.0) END) OVER w END"


cte("numbered", f"SELECT *, row_number() OVER {V} AS i FROM rets WHERE r IS NOT NULL", "rets")
_RUNNING = "WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING)"


@query("win6_ewm", sql(f"SELECT series_id, date, round({ewm_sql('r', 10)}, 6) + 0.0 AS e10, round({ewm_sql('r', 60)}, 6) + 0.0 AS e60 FROM numbered {_RUNNING}", "numbered"))
def win6(s: X, d: str) -> D:
    rows = A.rets(s, d).where("r is not null")
    rows = W.with_ewm(rows, {"e10": (F.col("r"), 10.0), "e60": (F.col("r"), 60.0)}, ["series_id"])
    return rows.select("series_id", "date", q6("e10").alias("e10"), q6("e60").alias("e60"))


cte("small", f"SELECT series_id, date, (CASE WHEN price > avg(price) OVER (PARTITION BY series_id) THEN 1 ELSE -1 END) * 0.001 + 0.0001 * (extract(day FROM date) - 15) / 15 AS r FROM prices", "prices")


def small_returns(s: X, d: str) -> D:
    """Bounded daily returns, so that compounding over years stays finite."""
    up = F.when(F.col("price") > F.avg("price").over(Window.partitionBy("series_id")), 1).otherwise(-1)
    return A.prices(s, d).select("series_id", "date", (up * 0.001 + 0.0001 * (F.dayofmonth("date") - 15) / 15).alias("r"))


cte("wealth", f"SELECT series_id, date, r, exp(sum(ln(1 + r)) OVER {V}) AS wealth FROM small", "small")


@query("win7_wealth", sql("SELECT series_id, date, round(wealth, 6) AS wealth FROM wealth", "wealth"))
def win7(s: X, d: str) -> D:
    return small_returns(s, d).select("series_id", "date", F.round(W.wealth(F.col("r"), w3()), 6).alias("wealth"))


@query("win8_drawdown", sql(f"SELECT series_id, date, round(wealth / max(wealth) OVER {V} - 1, 6) + 0.0 AS drawdown FROM wealth", "wealth"))
def win8(s: X, d: str) -> D:
    rows = small_returns(s, d).withColumn("wealth", W.wealth(F.col("r"), w3()))
    return rows.select("series_id", "date", q6(F.col("wealth") / W.running_max(F.col("wealth"), w3()) - 1).alias("drawdown"))


@query(
    "win9_holm",
    """WITH p AS (SELECT event_type, (count(*) % 97 + 1) / 300.0 AS p FROM events GROUP BY ALL), m AS (SELECT *, row_number() OVER (ORDER BY p, event_type) AS k, count(*) OVER () AS n FROM p)
    SELECT event_type, round(p, 6) AS p, round(max(least(1.0, (n - k + 1) * p)) OVER (ORDER BY k), 6) AS adjusted FROM m""",
)
def win9(s: X, d: str) -> D:
    p = table(s, d, "events").groupBy("event_type").agg(((F.count(F.lit(1)) % 97 + 1) / F.lit(300.0)).alias("p"))
    return I.holm(p, "p", "event_type").select("event_type", F.round("p", 6).alias("p"), F.round("adjusted", 6).alias("adjusted"))


@query("win11_gaps", sql("SELECT series_id, date, datediff('day', date, lead(date) OVER (PARTITION BY series_id ORDER BY date))::INT AS gap FROM prices", "prices"))
def win11(s: X, d: str) -> D:
    return A.prices(s, d).select("series_id", "date", F.datediff(F.lead("date").over(w3()), F.col("date")).alias("gap"))


@query(
    "win12_trailing_years",
    sql("SELECT e.expiry, count(*) AS n, round(avg(p.r), 6) + 0.0 AS mean FROM expiries e JOIN ret p ON p.date > e.expiry - INTERVAL 24 MONTH AND p.date <= e.expiry GROUP BY ALL", "expiries", "ret"),
)
def win12(s: X, d: str) -> D:
    ends = A.monthly_expiries(A.forward(s, d))
    rows = A.ret(s, d)
    # each day belongs to the expiries of the months ahead: explode those, not all pairs
    m = rows.withColumn("m", F.explode(F.sequence(F.trunc("date", "MM"), F.add_months(F.trunc("date", "MM"), 24), F.expr("interval 1 month"))))
    ends = ends.withColumn("m", F.trunc("expiry", "MM"))
    hit = m.join(ends, "m").where((F.col("date") <= F.col("expiry")) & (F.col("date") > F.add_months("expiry", -24)))
    return hit.groupBy("expiry").agg(F.count(F.lit(1)).alias("n"), q6(F.avg("r")).alias("mean"))


@query(
    "win13_trailing_rows",
    sql("""SELECT e.p AS pos, count(*) AS n, round(avg(r), 6) + 0.0 AS mean FROM (SELECT unnest(range(250, 2500, 250)) AS p) e JOIN (SELECT r, row_number() OVER (ORDER BY date) - 1 AS pos FROM ret) x ON x.pos BETWEEN e.p - 299 AND e.p GROUP BY ALL""", "ret"),
)
def win13(s: X, d: str) -> D:
    rows = A.ret(s, d).withColumn("pos", (F.row_number().over(w3()) - 1).cast("long"))
    refits = s.range(250, 2500, 250).select(F.col("id").alias("refit"))
    return G.trailing(rows, refits, 300).groupBy(F.col("refit").alias("pos")).agg(F.count(F.lit(1)).alias("n"), q6(F.avg("r")).alias("mean"))


@query("win14_expanding", sql(f"SELECT series_id, date, count(r) OVER {V} AS n, round(avg(r) OVER {V}, 6) + 0.0 AS mean FROM rets", "rets"))
def win14(s: X, d: str) -> D:
    frame = W.running(w3())
    return A.rets(s, d).select("series_id", "date", F.count("r").over(frame).alias("n"), q6(F.avg("r").over(frame)).alias("mean"))


cte("states", "SELECT series_id, date, (r > 0)::INT AS state FROM rets WHERE r IS NOT NULL", "rets")


def states(s: X, d: str) -> D:
    return A.rets(s, d).where("r is not null").select("series_id", "date", (F.col("r") > 0).cast("int").alias("state"))


@query(
    "win15_runs",
    sql(f"SELECT series_id, run, any_value(state) AS state, min(date) AS first, count(*) AS n FROM (SELECT *, sum(c) OVER {V} AS run FROM (SELECT *, CASE WHEN state IS NOT DISTINCT FROM lag(state) OVER {V} THEN 0 ELSE 1 END AS c FROM states)) GROUP BY ALL", "states").replace("sum(c) OVER", "(sum(c) OVER").replace("AS run FROM (SELECT *, CASE", ")::BIGINT AS run FROM (SELECT *, CASE"),
)
def win15(s: X, d: str) -> D:
    rows = states(s, d).withColumn("c", W.run_start(F.col("state"), w3())).withColumn("run", F.sum("c").over(W.running(w3())))
    return rows.groupBy("series_id", "run").agg(F.first("state").alias("state"), F.min("date").alias("first"), F.count(F.lit(1)).alias("n"))


@query("win16_switches", sql(f"SELECT series_id, sum(c)::BIGINT AS switches FROM (SELECT series_id, abs(state - lag(state) OVER {V}) AS c FROM states) GROUP BY ALL", "states"))
def win16(s: X, d: str) -> D:
    rows = states(s, d).withColumn("c", F.abs(F.col("state") - F.lag("state").over(w3())))
    return rows.groupBy("series_id").agg(F.sum("c").alias("switches"))


@query("win17_rotate", sql("SELECT a.series_id, a.date, b.state FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM states) a JOIN (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS pos FROM states) b ON a.series_id = b.series_id AND b.pos = (a.pos + a.n - 100) % a.n", "states"))
def win17(s: X, d: str) -> D:
    return I.rotate(states(s, d), "state", F.lit(100), ["series_id"]).select("series_id", "date", "state")


@query(
    "win18_autocovariance",
    sql(f"SELECT series_id, k, round(sum(x * y) / any_value(n), 6) + 0.0 AS gamma FROM (SELECT series_id, k, e AS x, lag(e, k::INT) OVER (PARTITION BY series_id, k ORDER BY date) AS y, n FROM (SELECT series_id, date, r - avg(r) OVER (PARTITION BY series_id) AS e, count(*) OVER (PARTITION BY series_id) AS n FROM numbered), range(1, 6) t(k)) GROUP BY ALL", "numbered"),
)
def win18(s: X, d: str) -> D:
    one = Window.partitionBy("series_id")
    rows = A.rets(s, d).where("r is not null").withColumn("e", F.col("r") - F.avg("r").over(one))
    lags = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), (F.col("e") * F.lag("e", k).over(w3())).alias("xy")) for k in range(1, 6)])
    rows = rows.withColumn("n", F.count(F.lit(1)).over(one)).withColumn("l", lags).select("series_id", "n", F.explode("l").alias("g"))
    return rows.groupBy("series_id", F.col("g.k").alias("k")).agg(q6(F.sum("g.xy") / F.first("n")).alias("gamma"))


@query("win19_half_yearly", sql("SELECT expiry FROM expiries WHERE month(expiry) IN (1, 7)", "expiries"))
def win19(s: X, d: str) -> D:
    return A.monthly_expiries(A.forward(s, d)).where(F.month("expiry").isin(1, 7))


@query("win20_every_kth", sql("SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM price) WHERE pos >= 500 AND (pos - 500) % 250 = 0", "price"))
def win20(s: X, d: str) -> D:
    return G.refit_positions(A.price(s, d), 500, 250).select("date")


# Features

cte(
    "features",
    """SELECT date, r, r - coalesce(rf, 0) AS x, CASE WHEN count(r) OVER w = 21 THEN sqrt(252 * avg(r * r) OVER w) END AS rv, row_number() OVER (ORDER BY date) AS i
       FROM ret LEFT JOIN rf USING (date) WHERE r IS NOT NULL WINDOW w AS (ORDER BY date ROWS 20 PRECEDING)""",
    "ret",
    "rf",
)


@query("fea2_realized_vol", sql("SELECT series_id, date, round(CASE WHEN count(r) OVER w = 21 THEN sqrt(252 * avg(r * r) OVER w) END, 6) AS rv FROM rets WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS 20 PRECEDING)", "rets"))
def fea2(s: X, d: str) -> D:
    return A.rets(s, d).select("series_id", "date", F.round(W.realized_vol(F.col("r"), w3()), 6).alias("rv"))


def _dd(h: int) -> str:
    return ewm_sql("(least(x, 0) * least(x, 0))", h)


_FEATURES = f"SELECT * FROM (SELECT date, rv, sqrt({_dd(10)}) AS dd10, ({ewm_sql('x', 20)}) / nullif(sqrt({_dd(20)}), 0) AS sortino20, ({ewm_sql('x', 60)}) / nullif(sqrt({_dd(60)}), 0) AS sortino60 FROM features WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)) WHERE dd10 IS NOT NULL AND sortino20 IS NOT NULL AND sortino60 IS NOT NULL AND rv IS NOT NULL"


@query("fea1_detector_inputs", sql(f"SELECT date, round(rv, 6) AS rv, round(dd10, 6) AS dd10, round(sortino20, 6) + 0.0 AS sortino20, round(sortino60, 6) + 0.0 AS sortino60 FROM ({_FEATURES})", "features"))
def fea1(s: X, d: str) -> D:
    rows = G.detector_inputs(A.ret(s, d), A.rf(s, d))
    return rows.select("date", *[q6(c).alias(c) for c in ("rv", "dd10", "sortino20", "sortino60")])


# Gates: refits every 250 days from day 500, 400 trailing rows

REFIT = {"first": 500, "step": 250, "window": 400, "min_history": 300}
cte("spine", "SELECT *, row_number() OVER (ORDER BY date) - 1 AS pos FROM features WHERE rv IS NOT NULL", "features")
cte("refits", "SELECT pos AS refit, lead(pos) OVER (ORDER BY pos) AS next FROM spine WHERE pos >= 500 AND (pos - 500) % 250 = 0", "spine")
cte("thresholds", "SELECT f.refit, any_value(f.next) AS next, quantile_cont(x.rv, 0.8) AS cut FROM refits f JOIN spine x ON x.pos BETWEEN f.refit - 399 AND f.refit GROUP BY f.refit HAVING count(*) >= 300", "refits")
cte("gate", "SELECT x.date, x.pos, t.refit, CASE WHEN t.refit IS NOT NULL THEN (x.rv > t.cut)::INT::DOUBLE END AS g FROM spine x LEFT JOIN thresholds t ON x.pos >= t.refit AND (t.next IS NULL OR x.pos < t.next)", "thresholds")


def spine(s: X, d: str) -> D:
    rows = A.ret(s, d).where("r is not null").join(A.rf(s, d), "date", "left")
    rows = rows.withColumn("x", F.col("r") - F.coalesce("rf", F.lit(0.0))).withColumn("rv", W.realized_vol(F.col("r"), w3()))
    return rows.where("rv is not null").withColumn("pos", (F.row_number().over(w3()) - 1).cast("long"))


def gate(s: X, d: str) -> D:
    return G.percentile_gate(spine(s, d), "rv", 0.8, **REFIT)


@query("det3_percentile_gate", sql("SELECT date, refit, g FROM gate", "gate"))
def det3(s: X, d: str) -> D:
    return gate(s, d).select("date", "refit", "g")


@query("det2_majority", sql("SELECT date, CASE WHEN count(g) OVER w = 20 THEN (avg(g) OVER w > 0.5)::INT::DOUBLE END AS g FROM gate WINDOW w AS (ORDER BY date ROWS 19 PRECEDING)", "gate"))
def det2(s: X, d: str) -> D:
    return gate(s, d).select("date", W.majority(F.col("g"), 20, w3()).alias("g"))


@query(
    "det13_percentile_sweep",
    sql("SELECT q, count(*) AS n, sum((x.rv > t.cut)::INT)::BIGINT AS flagged FROM (SELECT f.refit, any_value(f.next) AS next, q, quantile_cont(x.rv, q) AS cut FROM refits f JOIN spine x ON x.pos BETWEEN f.refit - 399 AND f.refit, (VALUES (0.5), (0.7), (0.9)) v(q) GROUP BY f.refit, q) t JOIN spine x ON x.pos >= t.refit AND (t.next IS NULL OR x.pos < t.next) GROUP BY ALL", "refits").replace("quantile_cont(x.rv, q)", "CASE q WHEN 0.5 THEN quantile_cont(x.rv, 0.5) WHEN 0.7 THEN quantile_cont(x.rv, 0.7) ELSE quantile_cont(x.rv, 0.9) END").replace("SELECT q, count", "SELECT q::DOUBLE AS q, count"),
)
def det13(s: X, d: str) -> D:
    return G.percentile_sweep(spine(s, d), "rv", [0.5, 0.7, 0.9], **REFIT).groupBy("q").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("g").cast("long")).alias("flagged")
    )


@query("det14_cut_sweep", sql("SELECT cut::DOUBLE AS cut, sum((p > cut)::INT)::BIGINT AS flagged FROM (SELECT percent_rank() OVER (ORDER BY rv) AS p FROM spine), (VALUES (0.3), (0.5), (0.7), (0.9)) v(cut) GROUP BY ALL", "spine"))
def det14(s: X, d: str) -> D:
    p = spine(s, d).select(F.percent_rank().over(Window.partitionBy(F.lit(1)).orderBy("rv")).alias("p"))
    return G.cut_sweep(p, "p", [0.3, 0.5, 0.7, 0.9]).groupBy("cut").agg(F.sum(F.col("g").cast("long")).alias("flagged"))


for _name, _kind in (("det4_hmm_gate", "hmm"), ("det7_jump_gate", "jump"), ("det11_bocpd_gate", "bocpd")):

    @query(_name)
    def det(s: X, d: str, kind: str = _kind) -> D:
        rows = G.with_pos(G.detector_inputs(A.ret(s, d), A.rf(s, d)))
        return G.gate_path(rows, kind, **REFIT).select("date", "refit", "g", F.round("score", 6).alias("score"))


@query("det6_in_sample_states")
def det6(s: X, d: str) -> D:
    rows = G.detector_inputs(A.ret(s, d), A.rf(s, d)).withColumn("pos", (F.row_number().over(w3()) - 1).cast("long"))
    return G.in_sample(rows, ["hmm", "hmm3", "jump"], **REFIT).drop("series_id")


@query(
    "det15_select_penalty",
    sql("""SELECT sel_date, arg_max(member, (score, -member)) AS member FROM (SELECT m.m AS sel_date, s.member, round(avg(s.x) / stddev_samp(s.x), 9) AS score FROM
        (SELECT DISTINCT date_trunc('month', date)::DATE AS m FROM features) m
        JOIN (SELECT date, k AS member, CASE WHEN i % (k + 2) = 0 THEN 0 ELSE x END AS x FROM features CROSS JOIN (SELECT unnest([1, 2, 3])::BIGINT AS k)) s
        ON s.date > m.m - INTERVAL 12 MONTH AND s.date <= m.m GROUP BY ALL HAVING count(*) >= 200) GROUP BY sel_date""", "features"),
)
def det15(s: X, d: str) -> D:
    rows = spine_all(s, d)
    members = rows.select("date", F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("member"), (F.col("x") * F.when(F.col("i") % (k + 2) == 0, 0).otherwise(1)).alias("x")) for k in (1, 2, 3)])).alias("m"))
    members = members.select("date", "m.member", "m.x")
    dates = rows.select(F.trunc("date", "MM").alias("at")).distinct()
    return G.select_member(members, dates, months=12, min_rows=200).withColumnRenamed("at", "sel_date")


def spine_all(s: X, d: str) -> D:
    rows = A.ret(s, d).where("r is not null").join(A.rf(s, d), "date", "left")
    return rows.withColumn("x", F.col("r") - F.coalesce("rf", F.lit(0.0))).withColumn("i", F.row_number().over(w3()))


# Strategies

cte("tri_days", "SELECT 'ALL' AS series_id, t.date, t.tri, coalesce(f.rf, 0) AS rf, g.g FROM tri t LEFT JOIN rf f USING (date) LEFT JOIN gate g USING (date)", "tri", "rf", "gate")


def tri_days(s: X, d: str) -> D:
    rows = A.tri(s, d).join(A.rf(s, d), "date", "left").join(gate(s, d).select("date", "g"), "date", "left")
    return rows.withColumn("rf", F.coalesce("rf", F.lit(0.0)))


def tri_sql(lag: int, buy: float, sell: float) -> str:
    return f"""SELECT date, rf, held * ret + (1 - held) * rf - greatest(after - held, 0) * {buy} - greatest(held - after, 0) * {sell} AS r FROM
      (SELECT date, rf, ret, after, coalesce(lag(after) OVER (ORDER BY date), 1) AS held FROM (SELECT date, rf, tri / lag(tri) OVER (ORDER BY date) - 1 AS ret,
       1 - coalesce(lag(coalesce(g, 0), {lag}) OVER (ORDER BY date), 0) AS after FROM tri_days))"""


cte("strategy", tri_sql(1, 0.001, 0.001), "tri_days")


@query("str1_switch_returns", sql(f"SELECT date, round(r, 6) + 0.0 AS r FROM strategy", "strategy"))
def str1(s: X, d: str) -> D:
    return T.switch_returns(tri_days(s, d), lag=1, buy=0.001, sell=0.001).select("date", q6("r").alias("r"))


@query("str7_all_members", sql(" UNION ALL ".join(f"SELECT {lag}::BIGINT AS lag, {c}::DOUBLE AS cost, count(r) AS n, round(sum(ln(1 + r)), 6) + 0.0 AS growth FROM ({tri_sql(lag, c, c)})" for lag in (0, 1) for c in (0.0, 0.001, 0.005)), "tri_days"))
def str7(s: X, d: str) -> D:
    grid = s.createDataFrame([(lag, c) for lag in (0, 1) for c in (0.0, 0.001, 0.005)], "lag long, cost double")
    return T.switch_grid(tri_days(s, d), grid).groupBy("lag", "cost").agg(F.count("r").alias("n"), q6(F.sum(F.log1p("r"))).alias("growth"))


cte("chain", "SELECT p.date, p.strike, max(CASE WHEN opt_type = 'CE' THEN settle END) AS sc, max(CASE WHEN opt_type = 'PE' THEN settle END) AS sp, max(CASE WHEN opt_type = 'CE' THEN close END) AS cc, max(CASE WHEN opt_type = 'PE' THEN close END) AS cp, coalesce(max(CASE WHEN opt_type = 'CE' THEN volume END), 0) AS vc, coalesce(max(CASE WHEN opt_type = 'PE' THEN volume END), 0) AS vp FROM panel p GROUP BY ALL", "panel")
cte(
    "plan_cycles",
    """SELECT c.cycle, c.entry, c.expiry, f.fut AS forward, e.strike, e.premium, abs(x.fut - e.strike) AS payoff,
       CASE WHEN e.strike IS NULL THEN 'no liquid pair' WHEN abs(e.strike - f.fut) > 0.25 * f.fut THEN 'strike too far' ELSE 'ok' END AS status
       FROM cycles c LEFT JOIN forward f ON f.date = c.entry LEFT JOIN forward x ON x.date = c.expiry
       LEFT JOIN (SELECT h.date, min_by(h.strike, (round(abs(h.strike - f.fut), 9), h.strike)) AS strike, min_by(h.cc + h.cp, (round(abs(h.strike - f.fut), 9), h.strike)) AS premium
                  FROM chain h JOIN forward f USING (date) WHERE vc > 0 AND vp > 0 GROUP BY h.date) e ON e.date = c.entry""",
    "cycles",
    "chain",
)


@query("str2_plan_cycles", sql("SELECT cycle, entry, expiry, round(forward, 6) AS forward, strike, round(premium + 1e-9, 6) AS premium, round(payoff, 6) AS payoff, status FROM plan_cycles", "plan_cycles"))
def str2(s: X, d: str) -> D:
    plan = T.plan_cycles(A.panel(s, d), A.forward(s, d), max_gap=0.25)
    return plan.select("cycle", "entry", "expiry", F.round("forward", 6).alias("forward"), "strike", F.round(F.col("premium") + 1e-9, 6).alias("premium"), F.round("payoff", 6).alias("payoff"), "status")


cte(
    "plan_days",
    """SELECT f.date, row_number() OVER (ORDER BY f.date) AS i, c.cycle, f.date = c.entry AS is_entry, f.date = c.expiry AS is_expiry, c.forward, c.premium, c.payoff,
       last_value(h.sc + h.sp IGNORE NULLS) OVER (PARTITION BY c.cycle ORDER BY f.date) AS mark, coalesce(last_value(CASE WHEN h.vc > 0 THEN h.cc ELSE h.sc END IGNORE NULLS) OVER (PARTITION BY c.cycle ORDER BY f.date), 0) + coalesce(last_value(CASE WHEN h.vp > 0 THEN h.cp ELSE h.sp END IGNORE NULLS) OVER (PARTITION BY c.cycle ORDER BY f.date), 0) AS exit_px,
       coalesce(r.rf, 0) AS rf FROM forward f LEFT JOIN (SELECT * FROM plan_cycles WHERE status = 'ok') c ON f.date BETWEEN c.entry AND c.expiry
       LEFT JOIN chain h ON h.date = f.date AND h.strike = c.strike LEFT JOIN rf r ON r.date = f.date""",
    "plan_cycles",
    "rf",
)


def plan_days(s: X, d: str) -> D:
    panel, forward = A.panel(s, d), A.forward(s, d)
    return T.plan_days(panel, forward, T.plan_cycles(panel, forward, max_gap=0.25), A.rf(s, d))


@query("str2_plan_days", sql("SELECT date, cycle, is_entry, is_expiry, round(mark, 6) AS mark, round(exit_px + 1e-9, 6) AS exit_px FROM plan_days WHERE cycle IS NOT NULL", "plan_days"))
def str2_days(s: X, d: str) -> D:
    return plan_days(s, d).where("cycle is not null").select("date", "cycle", "is_entry", "is_expiry", F.round("mark", 6).alias("mark"), F.round(F.col("exit_px") + 1e-9, 6).alias("exit_px"))


_FOLD = """, g AS (SELECT p.*, coalesce(lag(coalesce(x.g, 0), 1) OVER (ORDER BY p.date), 0) AS signal, p.premium / 1000 AS prem, p.payoff / 1000 AS pay, p.mark / 1000 AS mk, p.exit_px / 1000 AS ex FROM plan_days p LEFT JOIN gate x USING (date)),
 s AS (SELECT i, date, cash, units, value FROM (SELECT 0::BIGINT AS i, NULL::DATE AS date, 1.0::DOUBLE AS cash, 0.0::DOUBLE AS units, 1.0::DOUBLE AS value)
  UNION ALL SELECT i, date, c3, u3, CASE WHEN u3 > 0 THEN c3 - u3 * mk ELSE c3 END FROM (SELECT *, CASE WHEN enter THEN c2 + c2 / forward * prem * (1 - 0.002) ELSE c2 END AS c3, CASE WHEN enter THEN c2 / forward ELSE u2 END AS u3 FROM
   (SELECT *, is_entry AND u2 = 0 AND signal <> 1 AS enter FROM (SELECT *, CASE WHEN units > 0 AND is_expiry THEN c1 - units * pay WHEN units > 0 AND signal = 1 THEN c1 - units * ex * (1 + 0.002) ELSE c1 END AS c2,
     CASE WHEN units > 0 AND (is_expiry OR signal = 1) THEN 0 ELSE units END AS u2 FROM
     (SELECT g.i, g.date, s.cash * (1 + g.rf) AS c1, s.units, coalesce(g.is_expiry, false) AS is_expiry, coalesce(g.is_entry, false) AS is_entry, g.forward, g.prem, g.pay, g.mk, g.ex, g.signal FROM s JOIN g ON g.i = s.i + 1))))) """
_ACCOUNT = sql("", "plan_days", "gate", recursive=True).rstrip() + _FOLD + "SELECT date, round(value, 5) + 0.0 AS value FROM s WHERE i > 0"


@query("str3_account", _ACCOUNT)
def str3(s: X, d: str) -> D:
    days = plan_days(s, d).join(gate(s, d).select("date", "g"), "date", "left")
    scaled = days.withColumns({c: F.col(c) / 1000 for c in ("premium", "payoff", "mark", "exit_px")})
    out = T.simulate(scaled.withColumn("member", F.lit("g1")), ["member"], lag=1, buy=0.002, sell=0.002)
    return out.select("date", (F.round("value", 5) + F.lit(0.0)).alias("value"))


@query("str4_atm_iv")
def str4(s: X, d: str) -> D:
    return T.atm_iv(A.panel(s, d), A.forward(s, d), A.auctions(s, d)).select("date", "target", "strike", F.round("iv", 6).alias("iv"))


@query("str5_monthly_expiries", sql("SELECT expiry FROM expiries", "expiries"))
def str5(s: X, d: str) -> D:
    return A.monthly_expiries(A.forward(s, d))


@query("str6_period_plan", sql("SELECT count(*) AS n, min(date) AS first, max(date) AS last FROM forward WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'", "forward"))
def str6(s: X, d: str) -> D:
    return T.clip(A.forward(s, d), "1996-01-01", "1998-12-31").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("str8_reconcile", sql("SELECT p.cycle, round(p.premium - sum(x.close), 6) + 0.0 AS diff FROM plan_cycles p JOIN panel x ON x.date = p.entry AND x.strike = p.strike WHERE status = 'ok' GROUP BY p.cycle, p.premium", "plan_cycles", "panel"))
def str8(s: X, d: str) -> D:
    """Premium and payoff of each traded cycle by hand from raw rows, beside the plan's; diff is zero."""
    plan = T.plan_cycles(A.panel(s, d), A.forward(s, d), max_gap=0.25).where("status = 'ok'")
    raw = A.panel(s, d).select(F.col("date").alias("entry"), "strike", "close").groupBy("entry", "strike").agg(F.sum("close").alias("by_hand"))
    return plan.join(raw, ["entry", "strike"]).select("cycle", q6(F.col("premium") - F.col("by_hand")).alias("diff"))


@query("fin3_cash_return", sql("SELECT date, round(rf, 9) + 0.0 AS rf FROM rf", "rf"))
def fin3(s: X, d: str) -> D:
    return A.rf(s, d).select("date", (F.round("rf", 9) + F.lit(0.0)).alias("rf"))


@query("fin4_cost_tiers", "SELECT * FROM (VALUES ('low', 'buy', 0.00045, 0.0002252), ('low', 'sell', 0.00192, 0.0009602), ('mid', 'buy', 0.00045, 0.0004504), ('mid', 'sell', 0.00192, 0.0019204), ('high', 'buy', 0.00045, 0.0009008), ('high', 'sell', 0.00192, 0.0038408)) v(tier, side, base, cost)".replace("0.00045,", "0.0004504,").replace("0.00192,", "0.0019204,").replace("SELECT *", "SELECT tier, side, base::DOUBLE AS base, cost::DOUBLE AS cost"))
def fin4(s: X, d: str) -> D:
    return T.cost_table(s).select("tier", "side", "base", F.round("cost", 9).alias("cost"))


@query("fin5_align_expiries", sql("SELECT p.date, p.strike, p.opt_type, CASE WHEN last_day(p.date) > (SELECT max(date) FROM forward) THEN last_day(p.date) ELSE e.expiry END AS expiry FROM panel p JOIN expiries e ON date_trunc('month', p.date) = date_trunc('month', e.expiry)", "expiries"))
def fin5(s: X, d: str) -> D:
    rows = A.panel(s, d).withColumn("expiry", F.last_day("date"))
    futures = A.forward(s, d).select("date", F.last_day("date").alias("expiry"))
    return T.align_expiries(rows, futures).select("date", "strike", "opt_type", "expiry")


@query("fin1_straddle_value")
def fin1(s: X, d: str) -> D:
    v = S.straddle_value_udf(F.col("p_retailprice"), F.col("p_size") * 40.0 + 1, F.lit(0.25), F.lit(0.05), F.lit(0.2))
    return table(s, d, "part").select("p_partkey", F.round(v, 6).alias("value"))


@query("fin2_straddle_iv")
def fin2(s: X, d: str) -> D:
    k = F.col("p_size") * 10.0 + 600
    v = S.straddle_value_udf(F.col("p_retailprice"), k, F.lit(0.25), F.lit(0.05), F.lit(0.2))
    return table(s, d, "part").select("p_partkey", F.round(S.straddle_iv_udf(v, F.col("p_retailprice"), k, F.lit(0.25), F.lit(0.05)), 6).alias("iv"))


# Metrics and inference


_METRICS = """SELECT count(r) AS n, round(avg(x) / stddev_samp(x) * sqrt(252), 6) AS sharpe, round(ln(avg(pow((1 + r) / (1 + rf), -2))) / (-2 / 252.0), 6) AS mppm,
 round(exp(sum(ln(1 + r)) * 252 / count(r)) - 1, 6) AS ann_return, round(stddev_samp(r) * sqrt(252), 6) AS ann_vol"""


def small_members(s: X, d: str) -> D:
    return small_returns(s, d).withColumn("rf", F.lit(0.0001))


cte("members", "SELECT series_id, date, r, 0.0001 AS rf, r - 0.0001 AS x FROM small", "small")


@query(
    "met5_summary",
    sql(f"""SELECT a.*, round(d.dd, 6) + 0.0 AS max_drawdown, round(c.cvar, 6) AS cvar95, round(k.skew, 5) AS skew FROM (SELECT series_id, {_METRICS.removeprefix('SELECT ')} FROM members GROUP BY series_id) a
     JOIN (SELECT series_id, min(wealth / peak - 1) AS dd FROM (SELECT series_id, wealth, max(wealth) OVER {V} AS peak FROM wealth) GROUP BY ALL) d USING (series_id)
     JOIN (SELECT series_id, avg(r) AS cvar FROM (SELECT *, quantile_cont(r, 0.05) OVER (PARTITION BY series_id) AS q FROM members) WHERE r <= q GROUP BY ALL) c USING (series_id)
     JOIN (SELECT series_id, avg(pow(r - m, 3)) / pow(avg(pow(r - m, 2)), 1.5) AS skew FROM (SELECT *, avg(r) OVER (PARTITION BY series_id) AS m FROM members) GROUP BY ALL) k USING (series_id)""", "members", "wealth"),
)
def met5(s: X, d: str) -> D:
    out = I.summary(small_members(s, d), ["series_id"])
    return out.select("series_id", "n", *[q6(c).alias(c) for c in ("sharpe", "mppm", "ann_return", "ann_vol", "max_drawdown", "cvar95")], F.round("skew", 5).alias("skew"))


_DETECTION = """, l AS (SELECT g.date, g.g, (x.rv > quantile_cont(x.rv, 0.7) OVER ())::INT AS truth FROM gate g JOIN spine x USING (date) WHERE g.g IS NOT NULL),
 p AS (SELECT *, lag(g) OVER o AS pg, lag(truth) OVER o AS pt, row_number() OVER o AS pos FROM l WINDOW o AS (ORDER BY date)),
 e AS (SELECT *, sum((truth = 1 AND pt = 0)::INT) OVER (ORDER BY date) AS ep FROM p),
 per AS (SELECT min(CASE WHEN g = 1 THEN pos END) - min(pos) AS delay FROM e WHERE truth = 1 AND ep > 0 GROUP BY ep)
 SELECT 'ALL' AS series_id, round(avg(g), 6) AS flat_share, round(sum(abs(g - pg)) / (count(*) / 252.0), 6) AS switches_a_year,
  round(sum((g = 1 AND pg = 0 AND truth = 0)::INT) / (sum((truth = 0)::INT) / 252.0), 6) AS false_alarms_a_year, (SELECT count(*) FROM per) AS episodes,
  (SELECT round(avg((delay IS NULL)::INT), 6) FROM per) AS miss_rate, (SELECT quantile_cont(delay, 0.5) FROM per) AS median_delay FROM e"""


@query("met6_detection", sql("", "gate").rstrip() + _DETECTION)
def met6(s: X, d: str) -> D:
    rows = gate(s, d).where("g is not null")
    truth = (F.col("rv") > F.percentile("rv", 0.7).over(Window.partitionBy(F.lit(1)))).cast("int")
    return I.detection_stats(rows.withColumn("truth", truth).withColumn("series_id", F.lit("ALL")), ["series_id"])


_STABILITY = """, ws AS (SELECT f.refit, x.pos, (x.rv > quantile_cont(x.rv, 0.8) OVER (PARTITION BY f.refit))::INT AS s FROM refits f JOIN spine x ON x.pos BETWEEN f.refit - 399 AND f.refit),
 m AS (SELECT refit, lead(refit) OVER (ORDER BY refit) AS next FROM (SELECT DISTINCT refit FROM ws)),
 c AS (SELECT m.refit, a.s AS a, b.s AS b, count(*)::DOUBLE AS n FROM m JOIN ws a ON a.refit = m.refit JOIN ws b ON b.refit = m.next AND b.pos = a.pos GROUP BY ALL),
 k AS (SELECT refit, sum(n) AS o, coalesce(sum(n) FILTER (a <> b), 0) AS f, sum(n * (n - 1) / 2) AS same, coalesce(sum(n) FILTER (a = 0), 0) AS a0, coalesce(sum(n) FILTER (a = 1), 0) AS a1,
   coalesce(sum(n) FILTER (b = 0), 0) AS b0, coalesce(sum(n) FILTER (b = 1), 0) AS b1 FROM c GROUP BY refit),
 q AS (SELECT *, (a0 * (a0 - 1) + a1 * (a1 - 1)) / 2 AS ra, (b0 * (b0 - 1) + b1 * (b1 - 1)) / 2 AS rb, o * (o - 1) / 2 AS ro FROM k)
 SELECT refit, o::BIGINT AS overlap, round(f / o, 6) AS flip_rate, round(coalesce((same - ra * rb / ro) / nullif((ra + rb) / 2 - ra * rb / ro, 0), 1), 6) AS ari FROM q"""


@query("met7_refit_stability", sql("", "refits").rstrip() + _STABILITY)
def met7(s: X, d: str) -> D:
    return I.refit_stability(G.window_states(spine(s, d), "rv", 0.8, **REFIT).drop("series_id")).withColumns({c: F.round(c, 6) for c in ("flip_rate", "ari")})


@query("inf1_circular_blocks", "SELECT b.b AS block, k.k AS k, (b.b * 7919 + k.k) % 1000 AS pos FROM range(50) b(b), range(20) k(k)")
def inf1(s: X, d: str) -> D:
    starts = s.range(50).select(F.col("id").alias("block"), (F.col("id") * 7919).alias("start"))
    return I.circular_positions(starts, 20, 1000).select("block", "k", "pos")


@query("inf2_block_length")
def inf2(s: X, d: str) -> D:
    return I.block_lengths(A.rets(s, d).where("r is not null"), ["series_id"], "r")


@query("inf3_paired_difference")
def inf3(s: X, d: str) -> D:
    return I.paired_difference(*two_series(s, d), seed=7)


@query("inf5_sharpe_difference")
def inf5(s: X, d: str) -> D:
    return I.sharpe_difference_test(*two_series(s, d), seed=7)


def two_series(s: X, d: str) -> tuple[D, str, str]:
    rows = small_returns(s, d).where("series_id in ('A', 'N')").groupBy("date").pivot("series_id", ["A", "N"]).agg(F.first("r"))
    return rows.where("A is not null and N is not null").withColumn("rf", F.lit(0.0001)), "A", "N"


_HAC = """y AS (SELECT row_number() OVER (ORDER BY a.date) AS i, a.r - 0.0001 AS x1, b.r - 0.0001 AS x2 FROM small a JOIN small b ON a.date = b.date WHERE a.series_id = 'A' AND b.series_id = 'N'),
 m AS (SELECT count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(x1 * x1) AS g1, avg(x2 * x2) AS g2 FROM y),
 v AS (SELECT *, g1 - m1 * m1 AS v1, g2 - m2 * m2 AS v2, floor(4 * pow(n / 100.0, 2.0 / 9))::INT AS lags FROM m),
 u AS (SELECT i, n, lags, (x1 - m1) * g1 / pow(v1, 1.5) - (x2 - m2) * g2 / pow(v2, 1.5) - (x1 * x1 - g1) * m1 / (2 * pow(v1, 1.5)) + (x2 * x2 - g2) * m2 / (2 * pow(v2, 1.5)) AS z FROM y, v),
 k AS (SELECT a.i - b.i AS l, sum(a.z * b.z) / any_value(a.n) AS c, any_value(a.lags) AS lags FROM u a JOIN u b ON a.i - b.i BETWEEN 0 AND a.lags GROUP BY ALL)"""


@query(
    "inf4_hac_sharpe",
    sql("", "small").rstrip() + ", " + _HAC + " SELECT round(any_value(m1 / sqrt(v1) - m2 / sqrt(v2)), 6) + 0.0 AS diff, round(sqrt(sum(CASE WHEN l = 0 THEN c ELSE 2 * (1 - l / (k.lags + 1.0)) * c END) / any_value(n)), 6) AS se FROM k, v",
)
def inf4(s: X, d: str) -> D:
    rows, a, b = two_series(s, d)
    return I.hac_sharpe(rows, a, b).select(q6("diff").alias("diff"), F.round("se", 6).alias("se"))


@query("inf6_circular_shift")
def inf6(s: X, d: str) -> D:
    days = tri_days(s, d).where("tri is not null").orderBy("date").toPandas()  # one daily series
    live = int(days["g"].first_valid_index())
    tri, rf, g = (days[c].to_numpy(dtype=float) for c in ("tri", "rf", "g"))
    return I.circular_shift_test(s, g[live:], I.switch_score(tri, rf, live, 1, 0.001, 0.001), seed=7)


@query("inf8_deflated_sharpe")
def inf8(s: X, d: str) -> D:
    return I.deflated_sharpe(small_members(s, d), "series_id")


@query("inf9_effective_trials")
def inf9(s: X, d: str) -> D:
    return I.effective_trials(small_members(s, d), "series_id").withColumn("variance", F.round("variance", 9))


def members_long(s: X, d: str) -> D:
    """Daily mean discount of each line number: seven members."""
    rows = table(s, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("date"), F.col("l_linenumber").alias("member"))
    return rows.agg((F.avg("l_discount") - 0.05).alias("x"))


_PBO = """WITH x AS (SELECT l_shipdate::DATE AS date, l_linenumber AS member, avg(l_discount) - 0.05 AS x FROM lineitem GROUP BY ALL),
 days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM x)),
 b AS (SELECT x.member, (SELECT max(k) FROM range(16) t(k) WHERE days.pos >= floor(k * days.n / 16.0)) AS block, x.x FROM x JOIN days USING (date)),
 s AS (SELECT member, block, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx FROM b GROUP BY ALL),
 m AS (SELECT mask FROM range(65536) t(mask) WHERE bit_count(mask::USMALLINT) = 8),
 p AS (SELECT mask, member, round(ins, 9) AS ins, round(outs, 9) AS outs FROM (SELECT mask, member, (isx / im) / sqrt(isxx / im - pow(isx / im, 2)) AS ins, (osx / om) / sqrt(osxx / om - pow(osx / om, 2)) AS outs FROM
   (SELECT mask, member, sum(CASE WHEN (mask >> block) & 1 = 1 THEN n END) AS im, sum(CASE WHEN (mask >> block) & 1 = 1 THEN sx END) AS isx, sum(CASE WHEN (mask >> block) & 1 = 1 THEN sxx END) AS isxx,
     sum(CASE WHEN (mask >> block) & 1 = 0 THEN n END) AS om, sum(CASE WHEN (mask >> block) & 1 = 0 THEN sx END) AS osx, sum(CASE WHEN (mask >> block) & 1 = 0 THEN sxx END) AS osxx FROM s, m GROUP BY ALL))),
 w AS (SELECT mask, arg_max(outs, (ins, -member)) AS best, count(*) AS n FROM p GROUP BY mask)
 SELECT count(*) AS splits, round(avg((rank / (n + 1.0) <= 0.5)::INT), 6) AS pbo FROM (SELECT w.mask, any_value(w.n) AS n, 1 + sum((p.outs < w.best)::INT) AS rank FROM w JOIN p USING (mask) GROUP BY w.mask)"""


@query("inf10_pbo_blocks", _PBO)
def inf10(s: X, d: str) -> D:
    return I.pbo(members_long(s, d)).select("splits", F.round("pbo", 6).alias("pbo"))


@query("inf12_min_detectable", sql("SELECT round(2.8 * sqrt(2 * (1 - corr(a.r, b.r)) / (count(*) / 252.0)), 6) AS mde FROM small a JOIN small b USING (date) WHERE a.series_id = 'A' AND b.series_id = 'N'", "small"))
def inf12(s: X, d: str) -> D:
    rows, a, b = two_series(s, d)
    return rows.agg(F.round(2.8 * F.sqrt(2 * (1 - F.corr(a, b)) / (F.count(F.lit(1)) / 252.0)), 6).alias("mde"))


@query("inf13_confirmatory")
def inf13(s: X, d: str) -> D:
    """The confirmatory tests of both tracks of the walk-forward run."""
    from tidemark.plans import walkforward

    return walkforward.confirmatory_report(s, d)


@query("inf15_null_calibration")
def inf15(s: X, d: str) -> D:
    return I.null_calibration(s, n_paths=200, n_days=2500, rotations=999, seed=11)


# Generators


@query("gen1_generators")
def gen1(s: X, d: str) -> D:
    return G.generate(s, kinds=["hmm", "semi_markov", "garch"], seeds=4, n=1500)


@query("gen4_fit_dgps")
def gen4(s: X, d: str) -> D:
    return G.fit_dgps(A.rets(s, d).where("r is not null"), ["series_id"])


@query("gen5_path_scores")
def gen5(s: X, d: str) -> D:
    return G.path_scores(s, kinds=["hmm", "semi_markov"], seeds=2, n=1600)


@query("gen6_markov_gates")
def gen6(s: X, d: str) -> D:
    return G.markov_gates(s, seeds=8, n=1000)


# Spec-only extras


@query("ext_cost_curve", sql(" UNION ALL ".join(f"SELECT {bp}::BIGINT AS bp, round(sum(ln(1 + r)), 6) + 0.0 AS growth FROM ({tri_sql(1, bp / 10000, bp / 10000)})" for bp in range(0, 101, 5)), "tri_days"))
def ext_cost(s: X, d: str) -> D:
    grid = s.range(0, 101, 5).select(F.lit(1).cast("long").alias("lag"), F.col("id").alias("bp"), (F.col("id") / 10000).alias("cost"))
    return T.switch_grid(tri_days(s, d), grid).groupBy("bp").agg(q6(F.sum(F.log1p("r"))).alias("growth"))


@query("ext_member_activity", sql("SELECT round(avg(g), 6) AS flat_share, round(sum(abs(g - prev)) / (count(*) / 252.0), 6) AS switches_a_year FROM (SELECT g, lag(g) OVER (ORDER BY date) AS prev FROM gate WHERE g IS NOT NULL)", "gate"))
def ext_activity(s: X, d: str) -> D:
    rows = gate(s, d).where("g is not null").withColumn("prev", F.lag("g").over(w3()))
    return rows.agg(F.round(F.avg("g"), 6).alias("flat_share"), F.round(F.sum(F.abs(F.col("g") - F.col("prev"))) / (F.count(F.lit(1)) / 252.0), 6).alias("switches_a_year"))


@query("ext_orthogonal_gate", sql("SELECT f.refit, round(regr_slope(ln(abs(x.r) + 1e-6), ln(x.rv)), 6) AS slope, round(regr_intercept(ln(abs(x.r) + 1e-6), ln(x.rv)), 6) AS intercept FROM refits f JOIN spine x ON x.pos BETWEEN f.refit - 399 AND f.refit GROUP BY f.refit", "refits"))
def ext_orthogonal(s: X, d: str) -> D:
    rows = spine(s, d)
    refits = G.refit_positions(rows, REFIT["first"], REFIT["step"]).select("series_id", F.col("pos").alias("refit"))
    y, v = F.log(F.abs("r") + 1e-6), F.log("rv")
    out = G.trailing(rows, refits, REFIT["window"]).groupBy("refit")
    return out.agg(F.round(F.regr_slope(y, v), 6).alias("slope"), F.round(F.regr_intercept(y, v), 6).alias("intercept"))


cte("gate_days", "SELECT x.date, x.pos, x.r, g.g FROM spine x JOIN gate g USING (date)", "spine", "gate")


def gate_days(s: X, d: str) -> D:
    return spine(s, d).select("series_id", "date", "pos", "r").join(gate(s, d).select("series_id", "date", "g"), ["series_id", "date"])


_DURATIONS = """, n AS (SELECT g, row_number() OVER (ORDER BY date) AS i, lead(g) OVER (ORDER BY date) AS after FROM gate WHERE g IS NOT NULL),
  k AS (SELECT *, i - row_number() OVER (PARTITION BY g ORDER BY i) AS island FROM n),
  runs AS (SELECT g, island, count(*) AS n, count(after) AS seen, count(*) FILTER (WHERE after = g) AS stay FROM k GROUP BY ALL)
SELECT g, count(*) AS runs, round(avg(n), 6) AS realised, max(n) AS longest, round(sum(seen)::DOUBLE / nullif(sum(seen) - sum(stay), 0), 6) AS expected FROM runs GROUP BY g"""


@query("ext_regime_durations", sql("", "gate").rstrip() + _DURATIONS)
def ext_durations(s: X, d: str) -> D:
    out = G.regime_durations(gate(s, d).select("series_id", "date", "g"))
    return out.select("g", "runs", F.round("realised", 6).alias("realised"), "longest", F.round("expected", 6).alias("expected"))


_EVENTS = """, known AS (SELECT date, pos FROM gate_days QUALIFY row_number() OVER (PARTITION BY year(date) ORDER BY r, date) = 1)
SELECT k.date, min(x.pos) - k.pos AS delay, min(x.pos) IS NOT NULL AS caught FROM known k LEFT JOIN gate_days x ON x.g = 1 AND x.pos BETWEEN k.pos AND k.pos + 20 GROUP BY k.date, k.pos"""


@query("ext_event_table", sql("", "gate_days").rstrip() + _EVENTS)
def ext_events(s: X, d: str) -> D:
    """Known events are stood in for by the worst day of each year."""
    rows = gate_days(s, d)
    worst = Window.partitionBy("series_id", F.year("date")).orderBy("r", "date")
    events = rows.withColumn("n", F.row_number().over(worst)).where("n = 1")
    return G.event_table(rows, events).select("date", "delay", "caught")


_EPISODES = """, on_days AS (SELECT date, pos, coalesce(pos - lag(pos) OVER (ORDER BY pos) - 1 >= 21, true)::INT AS new FROM gate_days WHERE g = 1),
  e AS (SELECT *, sum(new) OVER (ORDER BY pos) AS k FROM on_days),
  spans AS (SELECT k, min(date) AS start, max(date) AS stop, min(pos) AS a, max(pos) AS b, count(*) AS signal_days FROM e GROUP BY k)
SELECT start, stop AS "end", count(*) AS days, signal_days, round(sum(x.r), 6) AS ret FROM spans JOIN gate_days x ON x.pos BETWEEN a AND b GROUP BY start, stop, signal_days"""


@query("ext_episodes", sql("", "gate_days").rstrip() + _EPISODES)
def ext_episodes(s: X, d: str) -> D:
    return G.episodes(gate_days(s, d)).select("start", "end", "days", "signal_days", q6("ret").alias("ret"))


@query("flagship_gated_index", sql(f"{_METRICS} FROM (SELECT *, r - rf AS x FROM strategy WHERE r IS NOT NULL)", "strategy"))
def flagship(s: X, d: str) -> D:
    out = I.summary(T.switch_returns(tri_days(s, d), lag=1, buy=0.001, sell=0.001).where("r is not null"), ["series_id"])
    return out.select("n", *[q6(c).alias(c) for c in ("sharpe", "mppm", "ann_return", "ann_vol")])

