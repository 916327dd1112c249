"""Integrity, live quotes and streaming: manifest, ledger, lock, instruments, order rows, online filters."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import subprocess
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import newline_neutral_digest, round_to_tick
from tidemark.operators import joins as J
from tidemark.plans import adapters as A
from tidemark.plans.adapters import sql
from tidemark.registry import query
from tidemark.session import scratch, table
from tidemark.streaming import online

D = DataFrame
X = SparkSession


def manifest(spark: X, pattern: str, date: str) -> D:
    """``(file, sha256, rows, first, last)`` of each Parquet file; the bytes are hashed where they are read."""
    blobs = spark.read.format("binaryFile").load(pattern).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))
    rows = spark.read.parquet(pattern).select(F.col("_metadata.file_name").alias("file"), F.to_date(date).alias("d"))
    spans = rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min("d").alias("first"), F.max("d").alias("last"))
    return blobs.join(spans, "file")


def lock_digests(spark: X, pattern: str) -> dict[str, str]:
    """Line-end-neutral digest of each text file."""
    blobs = spark.read.format("binaryFile").load(pattern)
    rows = blobs.select(F.element_at(F.split("path", "/"), -1).alias("f"), newline_neutral_digest(F.col("content")).alias("h")).collect()
    return {r.f: r.h for r in rows}


def create_lock(spark: X, pattern: str, path: str) -> None:
    Path(path).write_text(json.dumps(lock_digests(spark, pattern), sort_keys=True, indent=1))


def verify_lock(spark: X, pattern: str, path: str) -> None:
    """Raise if a file changed, came or went since the lock was made."""
    held, now = json.loads(Path(path).read_text()), lock_digests(spark, pattern)
    changed = sorted(k for k in held.keys() | now.keys() if held.get(k) != now.get(k))
    if changed:
        raise ValueError(f"files differ from the lock: {changed}")


def vcs_state(folder: str) -> dict[str, str | bool]:
    """Commit and whether the tree is clean."""

    def run(*args: str) -> str:
        return subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True).stdout.strip()

    return {"commit": run("rev-parse", "HEAD"), "clean": not run("status", "--porcelain")}


def config_hash(config: dict) -> str:
    """SHA-256 of canonical JSON: independent of the order of keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


# Live quotes


def flatten_quotes(quotes: D, levels: int = 5) -> D:
    """bid1.., ask1.. with quantities, mid and half spread of quotes with depth arrays; missing levels are NULL."""
    cols = []
    for side, name in (("buy", "bid"), ("sell", "ask")):
        for k in range(1, levels + 1):
            level = F.try_element_at(F.col(f"depth.{side}"), F.lit(k))
            cols += [level["price"].alias(f"{name}{k}"), level["quantity"].alias(f"{name}{k}_qty")]
    out = quotes.select(*[c for c in quotes.columns if c != "depth"], *cols)
    mid = F.when((F.col("bid1") > 0) & (F.col("ask1") > 0), (F.col("bid1") + F.col("ask1")) / 2)
    return out.withColumn("mid", mid).withColumn("half_spread_pct", F.try_divide((F.col("ask1") - F.col("bid1")) / 2, F.col("mid")))


def snapshot(spark: X, get_quotes: Callable[[list[str]], list[dict]], instruments: D, schema: str, at: dt.datetime, pause: Callable[[], None], size: int = 250) -> D:
    """Flat quotes of all instruments, with their metadata and the time ``at``, which must have a zone.

    The source is asked for ``size`` symbols at a time, with a pause between calls. Symbols it leaves out
    have NULL quotes. The symbols of one snapshot, not the data, come to the driver.
    """
    if at.tzinfo is None:
        raise ValueError("the time of a snapshot needs a zone")
    symbols = sorted(r.symbol for r in instruments.select("symbol").distinct().collect())
    found: list[dict] = []
    for n in range(0, len(symbols), size):
        if n:
            pause()
        found += get_quotes(symbols[n : n + size])
    quoted = flatten_quotes(spark.createDataFrame(found, schema))
    return instruments.join(quoted, "symbol", "left").withColumn("at", F.lit(at.isoformat()).cast("timestamp"))


def strikes_around(instruments: D, forward: float, n: int) -> D:
    """Instruments whose strike is among the n either side of the one nearest to the forward."""
    w = Window.partitionBy("expiry")
    near = J.nearest(F.col("strike"), F.lit(float(forward)))
    ranked = instruments.withColumn("__k", F.dense_rank().over(w.orderBy("strike"))).withColumn("__c", F.min_by("__k", near).over(w))
    return ranked.where(F.col("__k").between(F.col("__c") - n, F.col("__c") + n)).drop("__k", "__c")


def straddle_legs(quotes: D, side: str, tick: float, lots: int, max_half_spread: float = 0.05) -> D:
    """Dry-run order rows priced at the touch, rounded to the tick toward a fill; wide markets raise."""
    buy = F.lit(side == "BUY")
    touch = F.when(buy, F.col("ask1")).otherwise(F.col("bid1"))
    wide = F.coalesce(F.col("half_spread_pct") > max_half_spread, F.lit(True))
    price = F.when(wide, F.raise_error(F.concat(F.lit("market too wide: "), F.col("symbol"))).cast("double")).otherwise(round_to_tick(touch, F.lit(tick), buy))
    return quotes.select("symbol", F.lit(side).alias("side"), (F.col("lot_size") * lots).alias("quantity"), price.alias("price"))


def blocked(flags: dict[str, bool]) -> list[str]:
    """Names of the guards that stand against an order; no order is ever placed by this library."""
    return [name for name, ok in flags.items() if not ok] + ["dry run only"]


def order_guards(enabled: Column, lots: Column, most: Column, hour: Column) -> Column:
    """Array of the reasons that block each row."""
    reasons = [
        F.when(~enabled, F.lit("not enabled")),
        F.when(lots > most, F.lit("too many lots")),
        F.when(~hour.between(9, 15), F.lit("market closed")),
    ]
    return F.filter(F.array(*reasons), lambda x: x.isNotNull())


# Queries


@query("int1_manifest", "SELECT 'orders.parquet' AS file, true AS sha_known, count(*) AS rows, min(o_orderdate)::DATE AS first, max(o_orderdate)::DATE AS last FROM orders")
def int1(s: X, d: str) -> D:
    """The manifest of the table's own file; SQL cannot read bytes, so the digest is compared with hashlib's in a test."""
    rows = manifest(s, f"{d}/orders.parquet", "o_orderdate")
    return rows.select("file", F.col("sha256").rlike("^[0-9a-f]{64}$").alias("sha_known"), "rows", "first", "last")


@query("liv1_instruments", "SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS k, p_brand FROM part) JOIN (SELECT p_brand AS b, arg_min(k, (abs(p_size - 25), p_size)) AS c FROM (SELECT p_brand, p_size, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS k FROM part) GROUP BY 1) ON p_brand = b WHERE k BETWEEN c - 2 AND c + 2")
def liv1(s: X, d: str) -> D:
    rows = table(s, d, "part").select("p_partkey", "p_size", F.col("p_brand").alias("expiry"), F.col("p_size").cast("double").alias("strike"))
    return strikes_around(rows, 25.0, 2).select("p_partkey", "p_size")


def quotes(s: X, d: str) -> D:
    """One quote per supplier, from its cheapest lines: five levels a side."""
    rows = table(s, d, "lineitem").select(F.col("l_suppkey").alias("symbol_key"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))
    level = F.row_number().over(Window.partitionBy("symbol_key").orderBy("price", "quantity"))
    rows = rows.withColumn("level", level).where("level <= 5").groupBy("symbol_key").agg(F.sort_array(F.collect_list(F.struct("price", "quantity"))).alias("sell"))
    buy = F.transform("sell", lambda x: F.struct((x["price"] * 0.99).alias("price"), x["quantity"].alias("quantity")))
    return rows.select("symbol_key", F.struct(buy.alias("buy"), F.col("sell")).alias("depth"))


@query("liv2_flatten_depth", "SELECT l_suppkey AS symbol_key, round(a * 0.99, 4) AS bid1, a AS ask1, round((a + a * 0.99) / 2 + 1e-9, 4) AS mid, round((a - a * 0.99) / 2 / ((a + a * 0.99) / 2), 6) AS half_spread_pct FROM (SELECT l_suppkey, min(l_extendedprice) AS a FROM lineitem GROUP BY ALL)")
def liv2(s: X, d: str) -> D:
    return flatten_quotes(quotes(s, d)).select(
        "symbol_key", F.round("bid1", 4).alias("bid1"), "ask1", F.round(F.col("mid") + 1e-9, 4).alias("mid"), F.round("half_spread_pct", 6).alias("half_spread_pct")
    )


@query("liv4_ticks", "SELECT p_partkey, round(ceil(p_retailprice / 0.05 - 1e-9) * 0.05, 10) AS buy, round(floor(p_retailprice / 0.05 + 1e-9) * 0.05, 10) AS sell FROM part")
def liv4(s: X, d: str) -> D:
    p, tick = F.col("p_retailprice"), F.lit(0.05)
    return table(s, d, "part").select("p_partkey", round_to_tick(p, tick, F.lit(True)).alias("buy"), round_to_tick(p, tick, F.lit(False)).alias("sell"))


@query("liv5_resolve", "SELECT p_brand, arg_min(p_size, (abs(p_size - 20), p_size)) AS strike FROM part GROUP BY ALL")
def liv5(s: X, d: str) -> D:
    return table(s, d, "part").groupBy("p_brand").agg(F.min_by("p_size", F.struct(F.abs(F.col("p_size") - 20), F.col("p_size"))).alias("strike"))


@query("liv6_leg_prices", "SELECT l_suppkey::VARCHAR AS symbol, 'SELL' AS side, 100 AS quantity, round(floor(min(l_extendedprice) * 0.99 / 0.05 + 1e-9) * 0.05, 10) AS price FROM lineitem GROUP BY l_suppkey")
def liv6(s: X, d: str) -> D:
    rows = flatten_quotes(quotes(s, d)).withColumn("symbol", F.col("symbol_key").cast("string")).withColumn("lot_size", F.lit(50))
    return straddle_legs(rows, "SELL", 0.05, 2)


@query("liv7_guards", "SELECT o_orderkey, len(list_filter([CASE WHEN o_orderstatus <> 'O' THEN 'a' END, CASE WHEN o_totalprice > 200000 THEN 'b' END, CASE WHEN NOT month(o_orderdate) BETWEEN 9 AND 15 THEN 'c' END], lambda x: x IS NOT NULL))::INT AS n FROM orders")
def liv7(s: X, d: str) -> D:
    guards = order_guards(F.col("o_orderstatus") == "O", F.col("o_totalprice"), F.lit(200000), F.month("o_orderdate"))
    return table(s, d, "orders").select("o_orderkey", F.size(guards).alias("n"))


# Streaming, beside batch twins


@query("stm1_dedupe_stream", "SELECT DISTINCT event_id, user_id FROM events")
def stm1(s: X, d: str) -> D:
    return online.run_batch_of_stream(s, table(s, d, "events"), online.dedupe_events, scratch(s, "stream")).select("event_id", "user_id")


@query("stm2_tumbling", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stm2(s: X, d: str) -> D:
    out = online.run_batch_of_stream(s, table(s, d, "events"), online.daily_totals, scratch(s, "stream"), mode="complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stm2_sliding", "SELECT start, count(*) AS n FROM (SELECT date_trunc('day', ts) - k * INTERVAL 1 DAY AS start FROM events, range(0, 7) t(k)) GROUP BY ALL")
def stm2_sliding(s: X, d: str) -> D:
    out = online.run_batch_of_stream(s, table(s, d, "events"), online.sliding_counts, scratch(s, "stream"), mode="complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("stm2_session", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, k")
def stm2_session(s: X, d: str) -> D:
    out = online.run_batch_of_stream(s, table(s, d, "events"), online.session_counts, scratch(s, "stream"), mode="complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("stm3_online_filter")
def stm3(s: X, d: str) -> D:
    """Filtered stress probability per series by a stateful stream; equals the batch filter."""
    return online.run_batch_of_stream(s, A.rets(s, d).where("r is not null").select("series_id", "date", "r"), online.hmm_filter, scratch(s, "stream"), mode="append")


@query("stm3_online_bocpd")
def stm3_bocpd(s: X, d: str) -> D:
    """Posterior mean variance per series by a stateful stream; equals the batch detector."""
    rows = A.rets(s, d).where("r is not null").select("series_id", "date", "r")
    return online.run_batch_of_stream(s, rows, lambda x: online.bocpd_variance(x, 1e-4), scratch(s, "stream"), mode="append")


@query("stm4_ledger_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def stm4(s: X, d: str) -> D:
    path = scratch(s, "ledger")
    online.append_stream(s, table(s, d, "events").select("event_id", "event_type"), path, scratch(s, "stream"))
    return s.read.schema("event_id long, event_type string").json(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("orc1_bounded_load", sql("SELECT count(*) AS n, max(date) AS last FROM price WHERE date <= DATE '1999-12-31'", "price"))
def orc1(s: X, d: str) -> D:
    rows = table(s, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1999-12-31").cast("timestamp_ntz"))
    days = rows.select(F.to_date("l_shipdate").alias("date")).distinct()
    return days.agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("last"))
