"""Structured Streaming operators. Each has a batch twin that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.kernels import bocpd
from tidemark.kernels.hmm import Hmm, filter_prob

#: A fixed calm / stressed model for the online filter; callers pass a fitted one.
MODEL = Hmm(np.array([0.8, 0.2]), np.array([[0.97, 0.03], [0.06, 0.94]]), np.zeros(2), np.array([900.0, 6000.0]))


def dedupe_events(stream: DataFrame) -> DataFrame:
    """Events once each, with state for an hour of event time."""
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    return rows.dropDuplicatesWithinWatermark(["event_id"])


def daily_totals(stream: DataFrame) -> DataFrame:
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    out = rows.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding_counts(stream: DataFrame) -> DataFrame:
    """Events of each seven days, day by day."""
    rows = stream.select(F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "1 day")
    out = rows.groupBy(F.window("ts", "7 days", "1 day")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), "n")


def session_counts(stream: DataFrame) -> DataFrame:
    """Events of each user's sessions; a pause of half an hour ends one."""
    rows = stream.select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "1 day")
    out = rows.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), "n")


def hmm_filter(stream: DataFrame, model: Hmm = MODEL) -> DataFrame:
    """``(series_id, date, p)``: the forward filter per series; the state is the filter's distribution.

    Rows of a micro-batch are taken in date order; later batches must hold later dates.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("date")
        alpha = np.array(state.get[0]) if state.exists else None
        p, alpha = filter_prob(model, rows["r"].to_numpy(), alpha)
        state.update((alpha.tolist(),))
        yield pd.DataFrame({"series_id": key[0], "date": rows["date"], "p": np.round(p, 9)})

    return stream.groupBy("series_id").applyInPandasWithState(
        run, "series_id string, date date, p double", "alpha array<double>", "append", GroupStateTimeout.NoTimeout
    )


def bocpd_variance(stream: DataFrame, beta0: float, hazard: float = bocpd.HAZARD, longest: int = bocpd.LONGEST) -> DataFrame:
    """``(series_id, date, variance)``: changepoint detection per series; the state is the run lengths' posteriors.

    Rows of a micro-batch are taken in date order; later batches must hold later dates. The state
    is bounded by ``longest`` run lengths a series.
    """
    parts_of_state = ["w", "mu", "kappa", "alpha", "beta"]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("date")
        own = bocpd.State(beta0, hazard, longest)
        if state.exists:
            for name, values in zip(parts_of_state, state.get):
                setattr(own, name, np.array(values))
        variance = [own.step(r) for r in rows["r"].to_numpy()]
        state.update(tuple(getattr(own, name).tolist() for name in parts_of_state))
        yield pd.DataFrame({"series_id": key[0], "date": rows["date"], "variance": variance})

    return stream.groupBy("series_id").applyInPandasWithState(
        run,
        "series_id string, date date, variance double",
        ", ".join(f"{name} array<double>" for name in parts_of_state),
        "append",
        GroupStateTimeout.NoTimeout,
    )


def run_batch_of_stream(spark: SparkSession, rows: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, mode: str = "append") -> DataFrame:
    """Land rows as files, stream them through ``transform`` until all are read, and return the sink's rows."""
    rows.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).parquet(f"{path}/in")
    out = transform(stream)
    if mode == "append":
        sink = out.writeStream.format("parquet").option("path", f"{path}/out").outputMode("append")
    else:  # the whole result of each trigger replaces the last one

        def replace(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/out")

        sink = out.writeStream.foreachBatch(replace).outputMode(mode)
    sink.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def append_stream(spark: SparkSession, rows: DataFrame, ledger: str, path: str) -> None:
    """Append a stream's rows to a JSON ledger; a batch that is retried replaces its own folder."""
    rows.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")

    def write(batch: DataFrame, number: int) -> None:
        batch.select(*sorted(batch.columns)).write.mode("overwrite").json(f"{ledger}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
