"""The walk-forward run: all gates, all members under all lags and cost tiers, records and reports."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import canonical_json, sha256_text
from tidemark.operators import windows as W
from tidemark.operators.joins import asof
from tidemark.plans import adapters as A
from tidemark.plans import gates as G
from tidemark.plans import inference as I
from tidemark.plans import strategies as T
from tidemark.registry import query
from tidemark.session import scratch
from tidemark.sources import readers

# Members of the family and the kernels behind them.
FAMILY = {"HMM-2": "hmm", "HMM-3": "hmm3", "BOCPD": "bocpd", "RV": "rv"}
TESTED = ["HMM-2", "JM"]
COMPARATORS = {"T": ["ungated", "RV"], "S": ["ungated", "RV", "IV"]}
LAGS = [1, 2]


@dataclass(frozen=True)
class Run:
    """Settings of a run. ``min_history`` and ``min_validation`` are 1500 and 756 for decades of data."""

    refit_months: tuple[int, ...] = tuple(range(1, 13))
    window: int = 3000
    min_history: int = 1500
    iv_history: int = 250
    smooth: int = 20
    validation_months: int = 96
    min_validation: int = 756
    cost: float = 0.001
    n_boot: int = 10_000
    rotations: int = 999
    margin: int = 252
    seed: int = 0


def smoothed(gates: DataFrame, k: int, *keys: str) -> DataFrame:
    return gates.withColumn("g", W.majority(F.col("g"), k, W.by_date(*keys)))


def select_penalty(paths: DataFrame, days: DataFrame, dates: DataFrame, run: Run) -> DataFrame:
    """``(date, penalty, g)``: the gate of the penalty that had the best trailing Sharpe ratio at the last selection date.

    ``paths`` is (penalty, date, g), smoothed. The score is that of the index switched with one day's lag, over the
    validation months, from the day on which all penalties are live; ties go to the lowest penalty.
    """
    live = paths.where("g is not null").groupBy("penalty").agg(F.min("date").alias("d")).agg(F.max("d").alias("live"))
    penalties = paths.select("penalty").distinct()
    rows = days.join(F.broadcast(penalties)).join(paths, ["penalty", "date"], "left")  # a handful of penalties
    rows = T.switch_returns(rows, 1, run.cost, run.cost, ["penalty"]).join(F.broadcast(live)).where("date >= live and r is not null")
    members = rows.select("date", F.col("penalty").alias("member"), (F.col("r") - F.col("rf")).alias("x"))
    chosen = G.select_member(members, dates.select(F.col("date").alias("at")), run.validation_months, run.min_validation)
    spine = paths.select("date").distinct()
    found = asof(spine, chosen.select(F.col("at").alias("date"), F.col("member").alias("penalty")), "date", "penalty")
    return found.join(paths, ["date", "penalty"], "left")


def all_gates(rows: DataFrame, days: DataFrame, iv: DataFrame, expiries: DataFrame, run: Run = Run()) -> DataFrame:
    """``(gate, date, g)`` of every member, smoothed by majority; NULL before a gate is live.

    ``rows`` are the detector inputs with ``pos``, ``days`` the index (series_id, date, tri, rf), ``iv`` (date, iv) and
    ``expiries`` (date). Detectors are refitted at the expiries of ``refit_months``, the jump penalties at those of January and July;
    each (detector, refit) is a task of its own. The IV gate's window grows.
    """
    monthly, half = G.refits_at(rows, expiries.where(F.month("date").isin(*run.refit_months))), G.refits_at(rows, expiries.where(F.month("date").isin(1, 7)))
    names = F.create_map(*[F.lit(x) for name, kind in FAMILY.items() for x in (kind, name)])
    paths = G.gate_paths(rows, list(FAMILY.values()), monthly, run.window, run.min_history)
    parts = [smoothed(paths.select(names[F.col("kind")].alias("gate"), "date", "g"), run.smooth, "gate")]
    jumps = G.gate_paths(rows, [f"jump-{k:g}" for k in G.PENALTIES], half, run.window, run.min_history)
    jumps = jumps.select(F.split("kind", "-")[1].cast("double").alias("penalty"), "date", "g")
    path = scratch(rows.sparkSession, "jumps")  # read twice: for the choice and for the chosen gate
    smoothed(jumps, run.smooth, "penalty").write.parquet(path)
    jumps = rows.sparkSession.read.schema("penalty double, date date, g double").parquet(path)
    own = rows.select("date").distinct()
    best = select_penalty(jumps, days, expiries.join(own, "date", "left_semi"), run)
    parts.append(best.select(F.lit("JM").alias("gate"), "date", "g"))
    known = G.with_pos(iv.where("iv is not null").select("date", "iv"))
    whole = 1 << 20  # longer than any daily series: the window grows from its start
    percentile = G.percentile_gate(known, "iv", 0.8, window=whole, min_history=run.iv_history, refits=G.refits_at(known, expiries.join(own, "date", "left_semi")))
    parts.append(smoothed(percentile.select(F.lit("IV").alias("gate"), "date", "g"), run.smooth, "gate"))
    return reduce(DataFrame.unionByName, parts)


def period_returns(days: DataFrame, plan_days: DataFrame, gates: DataFrame, lags: list[int], tiers: dict[str, float], cost: float = 0.001) -> DataFrame:
    """``(track, gate, lag, tier, date, r, rf)`` of all members, from the first day on which every gate is live.

    Track T switches the index ``days`` (series_id, date, tri, rf) by every gate but IV; track S sells the straddles of
    ``plan_days`` unless a gate is up. The member ``ungated`` has no gate.
    """
    spark = days.sparkSession
    start = gates.where("g is not null").groupBy("gate").agg(F.min("date").alias("d")).agg(F.max("d").alias("start"))
    names = gates.select("gate").distinct().unionByName(spark.createDataFrame([("ungated",)], "gate string"))
    parts = []
    for lag in lags:
        for tier, k in tiers.items():
            t = days.join(F.broadcast(names.where("gate <> 'IV'"))).join(gates, ["gate", "date"], "left")  # a dozen members
            t = T.switch_returns(t, lag, k * cost, k * cost, ["gate"]).select("gate", "date", "r", "rf")
            s = plan_days.join(F.broadcast(names)).join(gates, ["gate", "date"], "left")
            value = T.simulate(s, ["gate"], lag, k * T.BUY_COST, k * T.SELL_COST)
            r = F.col("value") / F.coalesce(F.lag("value").over(W.by_date("gate")), F.lit(1.0)) - 1
            s = value.withColumn("r", r).join(plan_days.select("date", "rf"), "date").select("gate", "date", "r", "rf")
            own = t.withColumn("track", F.lit("T")).unionByName(s.withColumn("track", F.lit("S")))
            parts.append(own.withColumns({"lag": F.lit(lag).cast("long"), "tier": F.lit(tier)}))
    out = reduce(DataFrame.unionByName, parts).where("r is not null")
    return out.join(F.broadcast(start)).where(F.col("date") >= F.col("start")).select("track", "gate", "lag", "tier", "date", "r", "rf")


MEMBER = ["track", "gate", "lag", "tier"]


def record(returns: DataFrame, config: dict, path: str) -> DataFrame:
    """Save returns, append one ledger row a member (config hash, metrics), and return the summaries."""
    spark = returns.sparkSession
    returns.write.mode("overwrite").partitionBy("track", "gate").parquet(f"{path}/returns")
    saved = spark.read.schema(returns.schema).parquet(f"{path}/returns")
    summary = I.summary(saved, MEMBER)
    text = F.lit(json.dumps(config, sort_keys=True, separators=(",", ":")))
    ledger = summary.select(
        sha256_text(text).alias("config"),
        canonical_json(**{k: F.col(k) for k in MEMBER}).alias("member"),
        *[c for c in summary.columns if c not in MEMBER],
    )
    readers.append_ledger(ledger, f"{path}/ledger")
    return summary


def _headline(returns: DataFrame, track: str) -> DataFrame:
    return returns.where((F.col("track") == track) & (F.col("lag") == 1) & (F.col("tier") == "mid"))


def confirmatory(returns: DataFrame, days: DataFrame, plan_days: DataFrame, gates: DataFrame, run: Run = Run()) -> DataFrame:
    """``(track, detector, comparator, diff, p, mde_sharpe, adjusted)`` of the headline members of both tracks.

    Track T compares Sharpe ratios, track S the manipulation-proof measure; each detector is also tested against
    rotations of its own gate inside the evaluation days. p-values are adjusted within a track.
    """
    spark, out = returns.sparkSession, []
    marks = gates.where(F.col("gate").isin(TESTED)).select("gate", "date", "g")
    for track in ("T", "S"):
        own = _headline(returns, track)
        members = sorted({*TESTED, *COMPARATORS[track]})
        wide = own.groupBy("date", "rf").pivot("gate", members).agg(F.first("r")).na.drop("any")
        span = wide.agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("n")).first()
        rows = []
        for k, name in enumerate(TESTED):
            for j, other in enumerate(COMPARATORS[track]):
                seed = run.seed + 10 * k + j
                if track == "T":
                    test = I.sharpe_difference_test(wide, name, other, run.n_boot, seed=seed)
                else:
                    test = I.paired_difference(wide, name, other, "mppm", run.n_boot, seed=seed)
                found = test.first()
                rho = wide.agg(F.corr(name, other)).first()[0]
                rows.append((track, name, other, found.diff, found.p, 2.8 * math.sqrt(max(2 * (1 - rho), 0.0) / (span.n / I.YEAR))))
            whole = days if track == "T" else plan_days
            whole = whole.where(F.col("date") <= F.lit(span.last)).join(marks.where(F.col("gate") == name).select("date", "g"), "date", "left")
            pdf = whole.orderBy("date").toPandas()  # one daily series
            first = int((pdf["date"] < span.first).sum())
            own_gate = pdf["g"].to_numpy(dtype=float)[first:]
            if track == "T":
                score = I.switch_score(pdf["tri"].to_numpy(dtype=float), pdf["rf"].to_numpy(dtype=float), first, 1, run.cost, run.cost)
            else:
                held = {c: pdf[c].to_numpy(dtype=bool if c.startswith("is_") else float) for c in PLAN}
                score = I.straddle_score(held, first, len(pdf), 1, T.BUY_COST, T.SELL_COST)
            found = I.circular_shift_test(spark, own_gate, score, run.rotations, run.seed + k, run.margin).first()
            rows.append((track, name, "circular shift", found.observed - found.null_mean, found.p, None))
        table = spark.createDataFrame([tuple(x) for x in rows], "track string, detector string, comparator string, diff double, p double, mde_sharpe double")
        out.append(I.holm(table.withColumn("test", F.concat_ws(":", "detector", "comparator")), "p", "test").drop("test"))
    return reduce(DataFrame.unionByName, out)


PLAN = ["is_entry", "is_expiry", "forward", "premium", "payoff", "mark", "exit_px", "rf"]


def selection(returns: DataFrame) -> DataFrame:
    """``(track, gate, dsr, n_raw, n_eff, sr0_annual, pbo)``: Sharpe against the luck of the effective trials, and overfitting."""
    out = []
    for track, metric in (("T", "sharpe"), ("S", "mppm")):
        own = _headline(returns, track)
        trials = I.effective_trials(own, "gate").select("n_raw", "n_eff")
        ranks = own.select("gate").distinct().withColumn("member", F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy("gate")).cast("long"))
        x = F.col("r") - F.col("rf") if metric == "sharpe" else (1 + F.col("r")) / (1 + F.col("rf"))
        odds = I.pbo(own.join(F.broadcast(ranks), "gate").select("date", "member", x.alias("x")), metric=metric).select(F.round("pbo", 6).alias("pbo"))
        own = I.deflated_sharpe(own, "gate").select(F.lit(track).alias("track"), "gate", "dsr", F.round(F.col("sr0") * math.sqrt(I.YEAR), 6).alias("sr0_annual"))
        out.append(own.join(F.broadcast(trials)).join(F.broadcast(odds)))  # one row each
    return reduce(DataFrame.unionByName, out)


#: The stand-in series has seven years, so gates are live from 500 days on and penalties are chosen after one year. Refits
#: are quarterly, as each of the three-state models takes some ten seconds, and rotations are by half a year or more.
STAND_IN = Run(refit_months=(1, 4, 7, 10), min_history=500, min_validation=252, margin=126)
MAX_GAP = 0.25


@dataclass
class Inputs:
    days: DataFrame
    plan_days: DataFrame
    gates: DataFrame
    returns: DataFrame


_DONE: dict[tuple[str, str], Inputs] = {}


def _inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    """Gates and all members' returns, saved once a session so that the reports do not refit."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _DONE:
        return _DONE[key]
    rows = G.with_pos(G.detector_inputs(A.ret(spark, sf_dir), A.rf(spark, sf_dir)))
    days = A.tri(spark, sf_dir).join(A.rf(spark, sf_dir), "date", "left").withColumn("rf", F.coalesce("rf", F.lit(0.0)))
    panel, forward = A.panel(spark, sf_dir), A.forward(spark, sf_dir)
    iv = T.atm_iv(panel, forward, A.auctions(spark, sf_dir), scale=1000.0).select("date", "iv")  # as the plan below
    expiries = A.monthly_expiries(forward).select(F.col("expiry").alias("date"))
    plan = T.plan_days(panel, forward, T.plan_cycles(panel, forward, max_gap=MAX_GAP), A.rf(spark, sf_dir))
    plan = plan.withColumns({c: F.col(c) / 1000 for c in ("premium", "payoff", "mark", "exit_px")})

    def saved(df: DataFrame, name: str) -> DataFrame:
        path = scratch(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    rows, days, plan = saved(rows, "rows"), saved(days, "days"), saved(plan, "plan")
    gates = saved(all_gates(rows, days, saved(iv, "iv"), saved(expiries, "expiries"), STAND_IN), "gates")
    returns = saved(period_returns(days, plan, gates, LAGS, T.TIERS, STAND_IN.cost), "returns")
    _DONE.clear()
    _DONE[key] = Inputs(days, plan, gates, returns)
    return _DONE[key]


def confirmatory_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _inputs(spark, sf_dir)
    rows = confirmatory(own.returns, own.days, own.plan_days, own.gates, STAND_IN)
    return rows.withColumns({c: F.round(c, 6) for c in ("diff", "mde_sharpe")})


@query("orc2_all_gates")
def orc2(s: SparkSession, d: str) -> DataFrame:
    return _inputs(s, d).gates


@query("orc3_runner")
def orc3(s: SparkSession, d: str) -> DataFrame:
    summary = record(_inputs(s, d).returns, asdict(STAND_IN), scratch(s, "run"))
    return summary.select(*MEMBER, "n", *[F.round(c, 6).alias(c) for c in ("sharpe", "mppm", "ann_return", "max_drawdown")])


@query("inf14_selection")
def inf14(s: SparkSession, d: str) -> DataFrame:
    return selection(_inputs(s, d).returns)


@query("orc5_report")
def orc5(s: SparkSession, d: str) -> DataFrame:
    """Confirmatory tests and selection statistics of each tested member, side by side."""
    return confirmatory_report(s, d).join(selection(_inputs(s, d).returns).withColumnRenamed("gate", "detector"), ["track", "detector"])
