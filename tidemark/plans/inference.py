"""Metrics and inference: one aggregate per member, resampling in chunks of tasks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.kernels import accounts, paths, resample
from tidemark.operators import windows as W

YEAR = 252


def summary(rows: DataFrame, keys: list[str], rho: float = 3.0, tail: float = 0.05) -> DataFrame:
    """n, sharpe, mppm, ann_return, ann_vol, max_drawdown, cvar95, skew of ``rows`` (keys, date, r, rf).

    The drawdown's peak starts at the first day's wealth; the tail includes the interpolated quantile.
    """
    w = W.by_date(*keys)
    one = Window.partitionBy(*keys)
    rows = rows.withColumn("__w", W.wealth(F.col("r"), w)).withColumn("__q", F.percentile("r", tail).over(one))
    rows = rows.withColumn("__d", F.col("__w") / W.running_max(F.col("__w"), w) - 1)
    x = F.col("r") - F.col("rf")
    return rows.groupBy(*keys).agg(
        F.count("r").alias("n"),
        (F.try_divide(F.avg(x), F.stddev_samp(x)) * math.sqrt(YEAR)).alias("sharpe"),
        (F.log(F.avg(F.pow((1 + F.col("r")) / (1 + F.col("rf")), F.lit(1 - rho)))) / ((1 - rho) / YEAR)).alias("mppm"),
        (F.exp(F.sum(F.log1p("r")) * YEAR / F.count("r")) - 1).alias("ann_return"),
        (F.stddev_samp("r") * math.sqrt(YEAR)).alias("ann_vol"),
        F.min("__d").alias("max_drawdown"),
        F.avg(F.when(F.col("r") <= F.col("__q"), F.col("r"))).alias("cvar95"),
        F.skewness("r").alias("skew"),
    )


def holm(df: DataFrame, p: str, key: str) -> DataFrame:
    """Step-down adjusted p-values of one family of tests, as ``adjusted``."""
    one = Window.partitionBy(F.lit(1))
    order = one.orderBy(p, key)
    rows = df.withColumn("__k", F.row_number().over(order)).withColumn("__n", F.count(F.lit(1)).over(one))
    step = F.least(F.lit(1.0), (F.col("__n") - F.col("__k") + 1) * F.col(p))
    return rows.withColumn("__s", step).withColumn("adjusted", F.max("__s").over(W.running(order))).drop("__k", "__n", "__s")


def rotate(df: DataFrame, column: str, offset: Column, keys: list[str]) -> DataFrame:
    """The column moved on by ``offset`` places, wrapping at the end; an equi-join on the position."""
    one = Window.partitionBy(*keys)
    rows = df.withColumn("__p", F.row_number().over(one.orderBy("date")) - 1).withColumn("__n", F.count(F.lit(1)).over(one))
    moved = rows.select(*keys, ((F.col("__p") + offset) % F.col("__n")).alias("__p"), F.col(column).alias("__moved"))
    return rows.join(moved, [*keys, "__p"]).withColumn(column, F.col("__moved")).drop("__p", "__n", "__moved")


def circular_positions(starts: DataFrame, length: int, n: int) -> DataFrame:
    """Positions of circular blocks: each start and its ``length`` - 1 successors modulo n, as (k, pos)."""
    return starts.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long")))).withColumn(
        "pos", (F.col("start") + F.col("k")) % n
    )


def detection_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Flat share, switches a year, episodes, miss rate, median delay and false alarms a calm year.

    ``rows`` has date, g and truth; days without a gate are dropped. An episode is a run of truth that
    starts with an observed rise.
    """
    w = W.by_date(*keys)
    live = rows.where("g is not null")
    live = live.withColumn("pg", F.lag("g").over(w)).withColumn("pt", F.lag("truth").over(w))
    rise = (F.col("truth") == 1) & (F.col("pt") == 0)
    live = live.withColumn("pos", F.row_number().over(w)).withColumn("ep", F.sum(rise.cast("int")).over(W.running(w)))
    alarm = (F.col("g") == 1) & (F.col("pg") == 0) & (F.col("truth") == 0)
    base = live.groupBy(*keys).agg(
        F.avg("g").alias("flat_share"),
        (F.sum(F.abs(F.col("g") - F.col("pg"))) / (F.count(F.lit(1)) / YEAR)).alias("switches_a_year"),
        F.try_divide(F.sum(alarm.cast("int")), F.sum((F.col("truth") == 0).cast("int")) / YEAR).alias("false_alarms_a_year"),
    )
    inside = live.where((F.col("truth") == 1) & (F.col("ep") > 0))
    per = inside.groupBy(*keys, "ep").agg((F.min(F.when(F.col("g") == 1, F.col("pos"))) - F.min("pos")).alias("delay"))
    scores = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("episodes"), F.avg(F.col("delay").isNull().cast("int")).alias("miss_rate"), F.percentile("delay", 0.5).alias("median_delay")
    )
    out = base.join(scores, keys, "left")
    return out.withColumns({c: F.round(c, 6) for c in ("flat_share", "switches_a_year", "false_alarms_a_year", "miss_rate")})


def refit_stability(states: DataFrame) -> DataFrame:
    """``(refit, overlap, flip_rate, ari)`` of consecutive refits on the days that both windows cover.

    The adjusted Rand index comes from the counts of the 2 x 2 table.
    """
    marks = states.select("refit").distinct()
    marks = marks.withColumn("next", F.lead("refit").over(Window.partitionBy(F.lit(1)).orderBy("refit"))).where("next is not null")
    a = states.join(F.broadcast(marks), "refit").select("refit", "next", "pos", F.col("state").alias("a"))
    b = states.select(F.col("refit").alias("next"), "pos", F.col("state").alias("b"))
    cells = a.join(b, ["next", "pos"]).groupBy("refit", "a", "b").agg(F.count(F.lit(1)).alias("n"))

    def pairs(c: Column) -> Column:
        return c * (c - 1) / 2

    def of(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("double")

    out = cells.groupBy("refit").agg(
        F.sum("n").alias("overlap"),
        of(F.col("a") != F.col("b")).alias("flips"),
        F.sum(pairs(F.col("n"))).alias("both"),
        (pairs(of(F.col("a") == 0)) + pairs(of(F.col("a") == 1))).alias("rows"),
        (pairs(of(F.col("b") == 0)) + pairs(of(F.col("b") == 1))).alias("cols"),
    )
    chance = F.col("rows") * F.col("cols") / pairs(F.col("overlap"))
    ari = F.try_divide(F.col("both") - chance, (F.col("rows") + F.col("cols")) / 2 - chance)
    return out.select("refit", "overlap", (F.col("flips") / F.col("overlap")).alias("flip_rate"), F.coalesce(ari, F.lit(1.0)).alias("ari"))


def block_lengths(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("date")[column].to_numpy()
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "length": resample.block_length(x)}])

    return rows.groupBy(*keys).applyInPandas(run, ", ".join([f"{k} string" for k in keys] + ["length long"]))


def _arrays(rows: DataFrame, *columns: str) -> tuple[np.ndarray, ...]:
    """Daily columns in date order; a daily series of decades is a few thousand numbers."""
    pdf = rows.select("date", *columns).orderBy("date").toPandas()
    return tuple(pdf[c].to_numpy(dtype=float) for c in columns)


def _chunks(spark: SparkSession, n_boot: int, chunk: int, draw) -> np.ndarray:
    """Draws of all chunks, each a task with a seed of its own."""

    def run(batches):
        for pdf in batches:
            for k in pdf["id"]:
                yield pd.DataFrame({"v": draw(min(chunk, n_boot - int(k) * chunk), int(k))})

    n = -(-n_boot // chunk)
    return spark.range(0, n, 1, n).mapInPandas(run, "v double").toPandas()["v"].to_numpy()


def paired_difference(rows: DataFrame, a: str, b: str, metric: str = "sharpe", n_boot: int = 10_000, chunk: int = 250, seed: int = 0) -> DataFrame:
    """``(diff, low, high, p, length)``: circular-block bootstrap of the difference of a metric (``resample.METRICS``).

    The block length is that of the difference of the two series; p is the share of draws as far from the
    difference as it is from zero.
    """
    r1, r2, rf = _arrays(rows, a, b, "rf")
    score, length = resample.METRICS[metric], resample.block_length(r1 - r2)
    diff = float(score(r1, rf) - score(r2, rf))
    draws = _chunks(rows.sparkSession, n_boot, chunk, lambda m, k: resample.difference_draws(score, r1, r2, rf, length, m, [seed, k]))
    low, high = np.percentile(draws, [2.5, 97.5])
    p = float((np.abs(draws - diff) >= abs(diff)).mean()) if np.isfinite(diff) else float("nan")
    return rows.sparkSession.createDataFrame([(diff, float(low), float(high), p, length)], "diff double, low double, high double, p double, length long")


def sharpe_difference_test(rows: DataFrame, a: str, b: str, n_boot: int = 10_000, chunk: int = 250, seed: int = 0) -> DataFrame:
    """``(diff, se, low, high, p, length)``: studentised block bootstrap of the Sharpe difference, annualised."""
    r1, r2, rf = _arrays(rows, a, b, "rf")
    x1, x2, length = r1 - rf, r2 - rf, resample.block_length(r1 - r2)
    d, se = (float(v) for v in resample.sharpe_difference(x1, x2))
    draws = _chunks(rows.sparkSession, n_boot, chunk, lambda m, k: resample.studentised_draws(x1, x2, length, m, [seed, k]))
    reach, year = np.percentile(draws, 95) * se, math.sqrt(YEAR)
    p = float((draws >= abs(d / se)).mean()) if np.isfinite(d / se) else float("nan")
    row = (*map(float, (d * year, se * year, (d - reach) * year, (d + reach) * year, p)), length)
    return rows.sparkSession.createDataFrame([row], "diff double, se double, low double, high double, p double, length long")


def hac_sharpe(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``(diff, se)`` of daily Sharpe ratios: Newey-West with Bartlett weights, by the delta method, in SQL operators."""
    x = rows.select("date", (F.col(a) - F.col("rf")).alias("x1"), (F.col(b) - F.col("rf")).alias("x2"))
    m = x.agg(
        F.count(F.lit(1)).alias("n"), F.avg("x1").alias("m1"), F.avg("x2").alias("m2"), F.avg(F.col("x1") ** 2).alias("g1"), F.avg(F.col("x2") ** 2).alias("g2")
    ).first()
    v1, v2, n = m.g1 - m.m1**2, m.g2 - m.m2**2, m.n
    lags = int(4 * (n / 100) ** (2 / 9))
    z = (
        (F.col("x1") - m.m1) * (m.g1 / v1**1.5) - (F.col("x2") - m.m2) * (m.g2 / v2**1.5)
        - (F.col("x1") ** 2 - m.g1) * (m.m1 / (2 * v1**1.5)) + (F.col("x2") ** 2 - m.g2) * (m.m2 / (2 * v2**1.5))
    )
    w = W.by_date(F.lit(1))
    y = x.withColumn("z", z)
    terms = [F.sum(F.col("z") * F.col("z")) / n]
    for k in range(1, lags + 1):
        y = y.withColumn(f"l{k}", F.lag("z", k).over(w))
        terms.append(F.sum(F.col("z") * F.col(f"l{k}")) / n * (2 * (1 - k / (lags + 1))))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return y.agg(F.lit(m.m1 / math.sqrt(v1) - m.m2 / math.sqrt(v2)).alias("diff"), F.sqrt(total / n).alias("se"))


def switch_score(tri: np.ndarray, rf: np.ndarray, first: int, lag: int, buy: float, sell: float):
    """Sharpe ratios, from day ``first`` on, of the index switched by each of several gates of those days; before, invested."""

    def score(gates: np.ndarray) -> np.ndarray:
        whole = np.concatenate([np.zeros((len(gates), first)), gates], axis=1)
        r = accounts.switch_path(tri, rf, whole, lag, buy, sell)
        begin = max(first, 1)  # the first day of all has no return
        return resample.sharpe(r[:, begin:], rf[begin:])

    return score


def straddle_score(days: dict[str, np.ndarray], first: int, last: int, lag: int, buy: float, sell: float):
    """Manipulation-proof measures, from day ``first`` to before ``last``, of the straddle account under each gate of those days."""

    def score(gates: np.ndarray) -> np.ndarray:
        n = len(days["rf"])
        whole = np.concatenate([np.zeros((len(gates), first)), gates, np.zeros((len(gates), n - last))], axis=1)
        value = accounts.straddle_path(days, whole, lag, buy, sell)
        r = value / np.concatenate([np.ones((len(gates), 1)), value[:, :-1]], axis=1) - 1
        return resample.mppm(r[:, first:last], days["rf"][first:last])

    return score


def circular_shift_test(spark: SparkSession, gate: np.ndarray, score, n: int = 999, seed: int = 0, margin: int = 252, chunk: int = 50) -> DataFrame:
    """``(observed, null_mean, p, n)``: a gate's score against those of its rotations in time, one-sided.

    Offsets are uniform in [margin, days - margin]; ``score`` takes several gates, one a row, and each chunk of rotations
    is a task. Missing days of the gate count as 0. A series shorter than two margins raises.
    """
    gate = np.nan_to_num(gate)
    if len(gate) < 2 * margin:
        raise ValueError(f"{len(gate)} days leave no offset with a margin of {margin}")
    offsets = np.random.default_rng(seed).integers(margin, len(gate) - margin + 1, n)
    observed = float(score(gate[None])[0])
    null = _chunks(spark, n, chunk, lambda m, k: score(np.stack([np.roll(gate, o) for o in offsets[k * chunk : k * chunk + m]])))
    p = float((1 + (null >= observed).sum()) / (n + 1)) if np.isfinite(observed) else float("nan")
    row = (round(observed, 6), round(float(null.mean()), 6), p, n)
    return spark.createDataFrame([row], "observed double, null_mean double, p double, n long")


def effective_trials(rows: DataFrame, member: str) -> DataFrame:
    """``(n_raw, n_eff, variance)`` of the clusters of the members' excess returns, on the days that all have.

    Members and days of one family are a few dozen by a few thousand numbers, so a family is one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="date", columns=member, values="x").dropna()
        k, variance, _ = resample.effective_trials(wide.to_numpy())
        return pd.DataFrame([{"n_raw": wide.shape[1], "n_eff": k, "variance": variance}])

    one = rows.select("date", member, (F.col("r") - F.col("rf")).alias("x")).withColumn("__one", F.lit(1))
    return one.groupBy("__one").applyInPandas(lambda pdf: run(pdf), "n_raw long, n_eff long, variance double")


def deflated_sharpe(rows: DataFrame, member: str) -> DataFrame:
    """``(member, sr, sr0, psr, dsr)``: probability that a member's Sharpe beats 0, and the best of as many trials by luck.

    The trials are the effective ones: number and variance of the members' clusters.
    """
    trials = effective_trials(rows, member).first()
    sr0 = resample.expected_max_sharpe(trials.variance, trials.n_eff)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = (pdf["r"] - pdf["rf"]).to_numpy(dtype=float)
        out = {"sr": own.mean() / own.std(ddof=1), "sr0": sr0, "psr": resample.probabilistic_sharpe(own), "dsr": resample.probabilistic_sharpe(own, sr0)}
        return pd.DataFrame([{member: pdf[member].iloc[0], **{k: round(float(v), 6) for k, v in out.items()}}])

    return rows.groupBy(member).applyInPandas(run, f"{member} string, sr double, sr0 double, psr double, dsr double")


def pbo(rows: DataFrame, blocks: int = 16, metric: str = "sharpe", rho: float = 3.0) -> DataFrame:
    """``(splits, pbo)``: probability of backtest overfitting by combinatorially symmetric cross-validation.

    ``rows`` is (date, member, x), x the excess return; for the metric mppm it is the growth over cash,
    (1 + r) / (1 + rf). Only count, sum and sum of squares per block and member go on; a split is a
    bit mask of the blocks in sample. The best in sample is the first of the members with the highest ratio.
    """
    spark = rows.sparkSession
    if metric == "mppm":
        rows = rows.withColumn("x", F.pow("x", F.lit(1 - rho)))
    one = Window.partitionBy(F.lit(1))
    days = rows.select("date").distinct().withColumn("pos", F.row_number().over(one.orderBy("date")) - 1).withColumn("n", F.count(F.lit(1)).over(one))
    block = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.col("pos") >= F.floor(k * F.col("n") / float(blocks))))
    sums = rows.join(days.select("date", block.alias("block")), "date").groupBy("member", "block")
    sums = sums.agg(F.count("x").cast("double").alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    masks = spark.range(1 << blocks).where(F.bit_count("id") == blocks // 2).withColumnRenamed("id", "mask")
    inside = F.getbit("mask", F.col("block")) == 1

    def ratio(cond: Column) -> Column:
        n, sx, sxx = (F.sum(F.when(cond, F.col(c))) for c in ("n", "sx", "sxx"))
        if metric == "mppm":
            return F.round(F.log(sx / n) * (YEAR / (1 - rho)), 9)
        return F.round(F.try_divide(sx / n, F.sqrt(sxx / n - F.pow(sx / n, 2))), 9)

    perf = masks.join(F.broadcast(sums)).groupBy("mask", "member").agg(ratio(inside).alias("ins"), ratio(~inside).alias("outs"))
    split = perf.groupBy("mask").agg(
        F.max_by("outs", F.struct("ins", -F.col("member"))).alias("best"), F.count(F.lit(1)).alias("n"), F.collect_list("outs").alias("all")
    )
    best, rank = F.col("best"), 1 + F.size(F.filter("all", lambda o: o < F.col("best")))
    return split.where(best.isNotNull()).agg(F.count(F.lit(1)).alias("splits"), F.avg((rank / (F.col("n") + 1.0) <= 0.5).cast("int")).alias("pbo"))


def null_calibration(spark: SparkSession, n_paths: int, n_days: int, rotations: int, seed: int, margin: int = 252, cost: float = 0.001) -> DataFrame:
    """``(path, p)``: p-values of switching by gates that are independent of the returns; they should be uniform."""

    def run(batches):
        for pdf in batches:
            for k in pdf["id"]:
                draw = np.random.default_rng([seed, int(k)])
                r, g = draw.standard_normal(n_days) * 0.01, paths.markov_gate(n_days, seed=[seed, int(k), 1])
                score = switch_score(np.cumprod(1 + r), np.zeros(n_days), 0, 1, cost, cost)
                offsets = draw.integers(margin, n_days - margin + 1, rotations)
                null = score(np.stack([np.roll(g, o) for o in offsets]))
                p = (1 + (null >= score(g[None])[0]).sum()) / (rotations + 1)
                yield pd.DataFrame({"path": [k], "p": [round(float(p), 6)]})

    return spark.range(0, n_paths, 1, n_paths).mapInPandas(run, "path long, p double")
