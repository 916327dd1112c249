"""Walk-forward gates: refits, detector kernels as grouped tasks, sweeps and selection.

Inference restarts at each refit's window, so every (detector, refit) is an independent task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.kernels import bocpd, hmm, jump, paths
from tidemark.operators import windows as W
from tidemark.operators.joins import asof

FEATURES = ["rv", "dd10", "sortino20", "sortino60"]
BOCPD_QUANTILE = 80


def detector_inputs(returns: DataFrame, rf: DataFrame) -> DataFrame:
    """``(series_id, date, r, x, rv, dd10, sortino20, sortino60)``; warm-up days are dropped.

    x is the return over cash; dd10 the root of the weighted mean of squared losses; a Sortino ratio
    without losses is NULL and its day is dropped.
    """
    rows = returns.where("r is not null").join(rf, "date", "left").withColumn("x", F.col("r") - F.coalesce("rf", F.lit(0.0)))
    loss = F.pow(F.least(F.col("x"), F.lit(0.0)), 2)
    means = {"__d10": (loss, 10.0), "__d20": (loss, 20.0), "__d60": (loss, 60.0), "__m20": (F.col("x"), 20.0), "__m60": (F.col("x"), 60.0)}
    rows = W.with_ewm(rows, means, ["series_id"])
    return rows.select(
        "series_id",
        "date",
        "r",
        "x",
        W.realized_vol(F.col("r"), W.by_date("series_id")).alias("rv"),
        F.sqrt("__d10").alias("dd10"),
        F.try_divide(F.col("__m20"), F.sqrt("__d20")).alias("sortino20"),
        F.try_divide(F.col("__m60"), F.sqrt("__d60")).alias("sortino60"),
    ).na.drop("any")


def keys_of(rows: DataFrame) -> list[str]:
    """Series are told apart by ``series_id``; rows without it are one series."""
    return ["series_id"] if "series_id" in rows.columns else []


def with_pos(rows: DataFrame) -> DataFrame:
    """``rows`` with ``pos``, their place by date in their series from 0."""
    if "pos" in rows.columns:
        return rows
    return rows.withColumn("pos", (F.row_number().over(W.by_date(*(keys_of(rows) or [F.lit(1)]))) - 1).cast("long"))


def refit_positions(rows: DataFrame, first: int, step: int) -> DataFrame:
    """Rows (with ``pos``, their place by date from 0) at ``first`` and every ``step`` after it."""
    return with_pos(rows).where((F.col("pos") >= first) & ((F.col("pos") - first) % step == 0))


def trailing(rows: DataFrame, refits: DataFrame, window: int, ahead: str | None = None) -> DataFrame:
    """Rows of each refit's trailing window, up to the refit's own position or, with ``ahead``, to before that column.

    An equi-join on the series and position blocks as long as the window, so no pair outside neighbouring blocks is
    tried. Refits without ``series_id`` hold for every series.
    """
    last = F.col("refit") if ahead is None else F.col(ahead) - 1
    span = F.sequence(F.floor((F.col("refit") - window + 1) / window), F.floor(last / window))
    wanted = refits.withColumn("__b", F.explode(span))
    hit = rows.withColumn("__b", F.floor(F.col("pos") / window)).join(wanted, [*keys_of(refits), "__b"])
    return hit.where((F.col("pos") > F.col("refit") - window) & (F.col("pos") <= last)).drop("__b")


def _until_next(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``marks`` (series, refit) with ``next``, the refit after it or the end of the series."""
    keys = keys_of(rows)
    end = rows.groupBy(*keys).agg((F.max("pos") + 1).alias("end"))
    nexts = F.lead("refit").over(Window.partitionBy(*(keys or [F.lit(1)])).orderBy("refit"))
    marks = marks.withColumn("next", nexts)
    marks = marks.join(end, keys) if keys else marks.join(F.broadcast(end))  # without keys the end is one row
    return marks.select(*keys, "refit", F.coalesce("next", "end").alias("next"))


def _refits(rows: DataFrame, first: int, step: int) -> DataFrame:
    return _until_next(rows, refit_positions(rows, first, step).select(*keys_of(rows), F.col("pos").alias("refit")))


def refits_at(rows: DataFrame, dates: DataFrame) -> DataFrame:
    """Refits at the rows of the given ``date``s, each up to the next."""
    own = with_pos(rows)
    return _until_next(own, own.join(dates.select("date").distinct(), "date", "left_semi").select(*keys_of(own), F.col("pos").alias("refit")))


def segments(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """Rows with the fitted columns of the refit whose segment [refit, next) they lie in, NULL outside."""
    keys = keys_of(fitted)
    struct = F.struct(*[F.col(c) for c in fitted.columns])
    found = asof(rows, fitted.select(*keys, F.col("refit").alias("pos"), struct.alias("__f")), "pos", "__f", keys)
    live = F.col("pos") < F.col("__f.next")
    return found.select(*rows.columns, *[F.when(live, F.col(f"__f.{c}")).alias(c) for c in fitted.columns if c not in ("next", *keys)])


def percentile_gate(
    rows: DataFrame, column: str, q: float, first: int = 0, step: int = 1, window: int = 3000, min_history: int = 1500, refits: DataFrame | None = None
) -> DataFrame:
    """``rows`` with ``refit`` and ``g``: 1 where the column is above its q-quantile in the refit's window."""
    refits, keys = _refits(rows, first, step) if refits is None else refits, keys_of(rows)
    fitted = (
        trailing(rows.select(*keys, "pos", column), refits, window)
        .groupBy(*keys, "refit", "next")
        .agg(F.percentile(column, q).alias("cut"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_history)
        .select(*keys, "refit", "next", "cut")
    )
    return segments(rows, fitted).withColumn("g", (F.col(column) > F.col("cut")).cast("double")).drop("cut")


def percentile_sweep(rows: DataFrame, column: str, qs: list[float], first: int, step: int, window: int, min_history: int) -> DataFrame:
    """``(series_id, q, pos, g)``: one pass over the windows gives the cuts of all quantiles."""
    refits, keys = _refits(rows, first, step), keys_of(rows)
    cuts = (
        trailing(rows.select(*keys, "pos", column), refits, window)
        .groupBy(*keys, "refit", "next")
        .agg(F.percentile(column, F.array(*map(F.lit, qs))).alias("cuts"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_history)
        .select(*keys, "refit", "next", F.arrays_zip(F.array(*map(F.lit, qs)).alias("q"), F.col("cuts").alias("cut")).alias("c"))
    )
    live = segments(rows.select(*keys, "pos", column), cuts).where("refit is not null")
    return live.select(*keys, "pos", column, F.explode("c").alias("c")).select(*keys, F.col("c.q").alias("q"), "pos", (F.col(column) > F.col("c.cut")).alias("g"))


def cut_sweep(df: DataFrame, column: str, cuts: list[float]) -> DataFrame:
    """Each row once per cut, with ``cut`` and ``g``."""
    return df.withColumn("cut", F.explode(F.array(*map(F.lit, cuts)))).withColumn("g", F.col(column) > F.col("cut"))


# Kernels: fit on the window's rows, infer on all rows given; return (gate, score)


def _hmm(fit: pd.DataFrame, rows: pd.DataFrame, states: int = 2) -> tuple[np.ndarray, np.ndarray]:
    model = hmm.fit_hmm(fit["r"].to_numpy(), states=states)
    p, _ = hmm.filter_prob(model, rows["r"].to_numpy())
    return (p > 0.5).astype(float), p


def _jump(fit: pd.DataFrame, rows: pd.DataFrame, penalty: float = 50.0) -> tuple[np.ndarray, np.ndarray]:
    model = jump.fit_jump(fit[FEATURES[1:]].to_numpy(), fit["x"].to_numpy(), penalty=penalty)
    g = jump.online_states(model, rows[FEATURES[1:]].to_numpy())
    return g, g


def _bocpd(fit: pd.DataFrame, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    y, beta0 = fit["r"].to_numpy(), float(fit["r"].var(ddof=0))
    cut = np.percentile(bocpd.variance_path(y, beta0), BOCPD_QUANTILE)
    score = bocpd.variance_path(rows["r"].to_numpy(), beta0)
    return (score > cut).astype(float), score


def _rv(fit: pd.DataFrame, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    score = rows["rv"].to_numpy()
    return (score > np.percentile(fit["rv"].to_numpy(), BOCPD_QUANTILE)).astype(float), score


# Penalties per switch among which the walk-forward run selects.
PENALTIES = [1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0]
DETECTORS: dict[str, Callable] = {
    "hmm": _hmm,
    "hmm3": partial(_hmm, states=3),
    "jump": _jump,
    "bocpd": _bocpd,
    "rv": _rv,
    **{f"jump-{k:g}": partial(_jump, penalty=k) for k in PENALTIES},
}


def _fan_out(tasks: DataFrame, *keys: str) -> DataFrame:
    """Partition by task with a number that adaptive execution keeps: the rows are few but each group is long work."""
    return tasks.repartition(max(8, 2 * tasks.sparkSession.sparkContext.defaultParallelism), *keys)


def gate_paths(rows: DataFrame, kinds: list[str], refits: DataFrame, window: int = 3000, min_history: int = 1500) -> DataFrame:
    """``(series_id, kind, date, pos, refit, g, score)`` of detectors refitted at each of ``refits`` (refit, next).

    A task is one detector and refit: it fits on the refit's trailing window and infers from the window's start to
    the day before the next refit, but reports only the days from the refit on, so no output uses later rows.
    Missing inputs raise. Refits with fewer than ``min_history`` rows are skipped.
    """
    keys = keys_of(rows)
    columns = [*keys, "kind", "date", "pos", "refit", "g", "score"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        kind, refit = pdf["kind"].iloc[0], int(pdf["refit"].iloc[0])
        fit = pdf[pdf["pos"] <= refit]
        if len(fit) < min_history:
            return pdf.assign(g=0.0, score=0.0).iloc[:0][columns]
        if pdf[["r", "x", *FEATURES]].isna().any().any():
            raise ValueError("detector input has missing values")
        g, score = DETECTORS[kind](fit, pdf)
        out = pdf.assign(g=g, score=score)
        return out.loc[out["pos"] >= refit, columns]

    schema = "".join(f"{k} string, " for k in keys) + "kind string, date date, pos long, refit long, g double, score double"
    tasks = trailing(rows, refits, window, ahead="next").withColumn("kind", F.explode(F.array(*map(F.lit, kinds))))
    return _fan_out(tasks, *keys, "kind", "refit").groupBy(*keys, "kind", "refit").applyInPandas(run, schema)


def gate_path(rows: DataFrame, kind: str, first: int, step: int, window: int, min_history: int) -> DataFrame:
    """``(series_id, date, pos, refit, g, score)`` of one detector refitted every ``step`` rows from ``first`` on."""
    return gate_paths(rows, [kind], _refits(rows, first, step), window, min_history).drop("kind")


def in_sample(rows: DataFrame, kinds: list[str], first: int, step: int, window: int, min_history: int) -> DataFrame:
    """``(series_id, kind, refit, pos, state)``: most likely path within each fit window (Viterbi, jump path)."""
    keys = keys_of(rows)
    columns = [*keys, "kind", "refit", "pos", "state"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        kind = pdf["kind"].iloc[0]
        if len(pdf) < min_history:
            return pdf.assign(state=0.0).iloc[:0][columns]
        if kind.startswith("hmm"):
            model = hmm.fit_hmm(pdf["r"].to_numpy(), states=3 if kind == "hmm3" else 2)
            state = (hmm.viterbi(model, pdf["r"].to_numpy()) == model.stressed).astype(float)
        else:
            f = pdf[FEATURES[1:]].to_numpy()
            state = jump.in_sample_states(jump.fit_jump(f, pdf["x"].to_numpy(), penalty=50.0), f)
        return pdf.assign(state=state)[columns]

    schema = "".join(f"{k} string, " for k in keys) + "kind string, refit long, pos long, state double"
    tasks = trailing(rows, _refits(rows, first, step), window).withColumn("kind", F.explode(F.array(*map(F.lit, kinds))))
    return _fan_out(tasks, *keys, "kind", "refit").groupBy(*keys, "kind", "refit").applyInPandas(run, schema)


def window_states(rows: DataFrame, column: str, q: float, first: int, step: int, window: int, min_history: int) -> DataFrame:
    """``(series_id, refit, pos, state)``: the percentile state of each day of each fit window."""
    keys = keys_of(rows)
    own = trailing(rows.select(*keys, "pos", column), _refits(rows, first, step), window)
    w = Window.partitionBy(*keys, "refit")
    cut, n = F.percentile(column, q).over(w), F.count(F.lit(1)).over(w)
    return own.withColumn("n", n).withColumn("state", (F.col(column) > cut).cast("int")).where(F.col("n") >= min_history).select(*keys, "refit", "pos", "state")


def select_member(members: DataFrame, dates: DataFrame, months: int, min_rows: int) -> DataFrame:
    """``(at, member)``: of ``members`` (date, member, x) the one with the best trailing mean over deviation.

    Each day is sent to the selection dates of the months ahead, so the join is on the month.
    """
    ahead = F.sequence(F.trunc("date", "MM"), F.add_months(F.trunc("date", "MM"), months), F.expr("interval 1 month"))
    hit = members.withColumn("m", F.explode(ahead)).join(dates.withColumn("m", F.trunc("at", "MM")), "m")
    hit = hit.where((F.col("date") <= F.col("at")) & (F.col("date") > F.add_months("at", -months)))
    scores = hit.groupBy("at", "member").agg(F.round(F.try_divide(F.avg("x"), F.stddev_samp("x")), 9).alias("score"), F.count(F.lit(1)).alias("n"))
    return scores.where(F.col("n") >= min_rows).groupBy("at").agg(F.max_by("member", F.struct("score", -F.col("member"))).alias("member"))


# Generators, one task a path


def _tasks(spark: SparkSession, kinds: list[str], seeds: int) -> DataFrame:
    rows = spark.createDataFrame([(k, i) for k in kinds for i in range(seeds)], "kind string, seed long")
    return rows.repartition(len(kinds) * seeds, "kind", "seed")


def make_path(kind: str, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    if kind == "hmm":
        return paths.hmm_path(n, [0.0005, -0.001], [0.006, 0.02], [[0.99, 0.01], [0.03, 0.97]], [1, seed])
    if kind == "semi_markov":
        return paths.semi_markov_path(n, [0.0005, -0.001], [0.006, 0.02], [100, 33], 2.0, 5.0, [2, seed])
    r = paths.garch_path(n, 0.05, 0.02, 0.1, 0.88, 6.0, [3, seed])
    return r, (np.abs(r) > r.std()).astype(int)


def generate(spark: SparkSession, kinds: list[str], seeds: int, n: int) -> DataFrame:
    """``(kind, seed, pos, r, state)`` of simulated paths; the same seed gives the same path anywhere."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, seed in zip(pdf["kind"], pdf["seed"]):
            r, state = make_path(kind, n, int(seed))
            out.append(pd.DataFrame({"kind": kind, "seed": seed, "pos": np.arange(n), "r": r, "state": state}))
        return pd.concat(out)

    return _tasks(spark, kinds, seeds).groupBy("kind", "seed").applyInPandas(run, "kind string, seed long, pos long, r double, state long")


def fit_dgps(returns: DataFrame, keys: list[str]) -> DataFrame:
    """Per series: two-state HMM (calm first), mean durations, and GARCH-t parameters, of all its returns."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values("date")["r"].to_numpy()
        model = hmm.fit_hmm(r, states=2)
        order = np.argsort(model.var)
        stay = np.diag(model.trans)[order]
        found = {f"sd{k}": float(np.sqrt(model.var[order][k]) / 100) for k in range(2)}
        found |= {f"duration{k}": float(1 / max(1 - stay[k], 1e-6)) for k in range(2)}
        found |= paths.fit_garch(r)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, **{k: round(float(v), 6) for k, v in found.items()}}])

    schema = ", ".join([f"{k} string" for k in keys] + [f"{c} double" for c in ("sd0", "sd1", "duration0", "duration1", "mu", "omega", "alpha", "beta", "df")])
    return returns.groupBy(*keys).applyInPandas(run, schema)


def score_gate(gate: np.ndarray, truth: np.ndarray) -> dict[str, float]:
    """Accuracy, missed episodes and median delay of a gate against known states."""
    rises = np.flatnonzero((truth[1:] == 1) & (truth[:-1] == 0)) + 1
    delays, missed = [], 0
    for a in rises:
        falls = np.flatnonzero(truth[a:] == 0)
        b = a + (falls[0] if len(falls) else len(truth) - a)
        hit = np.flatnonzero(gate[a:b] == 1)
        missed += not len(hit)
        delays += [int(hit[0])] if len(hit) else []
    return {
        "accuracy": float((gate == truth).mean()),
        "episodes": float(len(rises)),
        "miss_rate": missed / len(rises) if len(rises) else 0.0,
        "median_delay": float(np.median(delays)) if delays else -1.0,
    }


def path_scores(spark: SparkSession, kinds: list[str], seeds: int, n: int, window: int = 800) -> DataFrame:
    """``(kind, seed, detector, accuracy, episodes, miss_rate, median_delay)`` of simulated paths."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, seed in zip(pdf["kind"], pdf["seed"]):
            r, state = make_path(kind, n, int(seed))
            rows = pd.DataFrame({"r": r, "x": r})
            rows["rv"] = np.sqrt(252 * pd.Series(r * r).rolling(21, min_periods=1).mean())
            for name in ("hmm", "rv", "bocpd"):
                g, _ = DETECTORS[name](rows.iloc[:window], rows)
                out.append({"kind": kind, "seed": seed, "detector": name} | {k: round(v, 6) for k, v in score_gate(g[window:], state[window:]).items()})
        return pd.DataFrame(out)

    schema = "kind string, seed long, detector string, accuracy double, episodes double, miss_rate double, median_delay double"
    return _tasks(spark, kinds, seeds).groupBy("kind", "seed").applyInPandas(run, schema)


def markov_gates(spark: SparkSession, seeds: int, n: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([pd.DataFrame({"seed": s, "pos": np.arange(n), "g": paths.markov_gate(n, seed=[4, int(s)])}) for s in pdf["seed"]])

    return _tasks(spark, ["gate"], seeds).groupBy("seed").applyInPandas(run, "seed long, pos long, g double")


def regime_durations(rows: DataFrame) -> DataFrame:
    """Per series and state of ``g``: ``runs, realised, expected, longest`` days.

    realised is the mean length of the runs; expected is 1 / (1 - p), p being the share of the
    state's days that the same state follows (the last day has no follower). It is null if no run
    ever ended. Days without a state are left out.
    """
    days = rows.where("g is not null")
    days = days.withColumn("pos", F.row_number().over(W.by_date("series_id"))).withColumn("after", F.lead("g").over(W.by_date("series_id")))
    days = days.withColumn("run", F.col("pos") - F.row_number().over(W.by_date("series_id", "g")))
    runs = days.groupBy("series_id", "g", "run").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("after") == F.col("g")).alias("stay"), F.count("after").alias("seen")
    )
    out = runs.groupBy("series_id", "g").agg(
        F.count(F.lit(1)).alias("runs"), F.avg("n").alias("realised"), F.max("n").alias("longest"), F.sum("seen").alias("seen"), F.sum("stay").alias("stay")
    )
    return out.withColumn("expected", F.try_divide(F.col("seen").cast("double"), F.col("seen") - F.col("stay"))).drop("seen", "stay")


def event_table(rows: DataFrame, events: DataFrame, within: int = 20) -> DataFrame:
    """``series_id, date, delay, caught`` per known event (series_id, date).

    delay is the number of trading days from the event to the first stressed day, at most
    ``within``; null and not caught without one. Events on days without a row are left out.
    """
    ahead = W.by_date("series_id").rowsBetween(0, within)
    first = F.min(F.when(F.col("g") == 1, F.col("pos"))).over(ahead)
    found = rows.withColumn("delay", first - F.col("pos")).select("series_id", "date", "delay")
    return found.join(events.select("series_id", "date"), ["series_id", "date"]).withColumn("caught", F.col("delay").isNotNull())


def episodes(rows: DataFrame, gap: int = 21) -> DataFrame:
    """``series_id, start, end, days, signal_days, ret`` per episode: stressed runs merged across gaps under ``gap`` days.

    days and ret, the sum of ``r``, cover every day from the first to the last stressed one.
    """
    w = W.by_date("series_id")
    last = F.last(F.when(F.col("g") == 1, F.col("pos")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (F.col("g") == 1) & (last.isNull() | (F.col("pos") - last - 1 >= gap))
    days = rows.withColumn("episode", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(w)).where("episode > 0")
    days = days.withColumn("stop", F.max(F.when(F.col("g") == 1, F.col("pos"))).over(Window.partitionBy("series_id", "episode"))).where("pos <= stop")
    out = days.groupBy("series_id", "episode").agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("days"), F.count_if(F.col("g") == 1).alias("signal_days"), F.sum("r").alias("ret")
    )
    return out.drop("episode")
