"""Queries on sources, projections, joins, aggregates, sorts and sets."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import joins as J
from tidemark.operators import rows as R
from tidemark.operators import windows as W
from tidemark.plans import adapters as A
from tidemark.plans.adapters import sql
from tidemark.registry import query
from tidemark.session import scratch, table
from tidemark.sources import readers

D = DataFrame
X = SparkSession


@query("src1_parquet_scan", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def src1(s: X, d: str) -> D:
    return table(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@query(
    "src2_pushdown_scan",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate <= TIMESTAMP '1997-06-30' AND l_linenumber IN (1, 2)",
)
def src2(s: X, d: str) -> D:
    rows = table(s, d, "lineitem")
    hit = (F.col("l_returnflag") == "R") & (F.col("l_shipdate") <= F.lit("1997-06-30").cast("timestamp_ntz")) & F.col("l_linenumber").isin(1, 2)
    return rows.where(hit).select("l_orderkey", "l_linenumber", "l_quantity")


@query("src3_column_scan", "SELECT min(l_shipdate)::DATE AS first, max(l_shipdate)::DATE AS last, count(*) AS n FROM lineitem")
def src3(s: X, d: str) -> D:
    return table(s, d, "lineitem").select("l_shipdate").agg(
        F.to_date(F.min("l_shipdate")).alias("first"), F.to_date(F.max("l_shipdate")).alias("last"), F.count(F.lit(1)).alias("n")
    )


@query("src4_zip_csv", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def src4(s: X, d: str) -> D:
    rows = table(s, d, "nation").collect()
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        lines = [" n_nationkey ,n_name,n_regionkey,", *(f"{r.n_nationkey}, {r.n_name} ,{r.n_regionkey}," for r in rows)]
        z.writestr("day.csv", "\n".join(lines))
    blobs = s.createDataFrame([("day.zip", held.getvalue())], "path string, content binary")
    return readers.records_from_zips(blobs, ["n_nationkey", "n_name", "n_regionkey"])


@query(
    "src5_gz_csv_by_name",
    "SELECT o_orderdate::DATE AS date, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate < TIMESTAMP '1995-04-01' GROUP BY ALL",
)
def src5(s: X, d: str) -> D:
    rows = table(s, d, "orders").where("o_orderdate < timestamp_ntz'1995-04-01'")
    path = scratch(s, "csv")
    out = rows.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderkey", "o_totalprice")
    out.repartition("day").write.partitionBy("day").option("header", True).option("compression", "gzip").csv(path)
    found = readers.gz_csv(s, path + "/*/*.csv.gz", "o_orderkey string, o_totalprice string", r"day=(\d{4}-\d{2}-\d{2})")
    return found.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("total"))


@query(
    "src6_json_envelope",
    "SELECT user_id, count(*) AS n, sum((props::JSON ->> 'k')::BIGINT)::BIGINT AS k FROM events GROUP BY ALL",
)
def src6(s: X, d: str) -> D:
    own = F.to_json(F.collect_list(F.struct(F.col("event_id"), F.col("props"))))
    lists = table(s, d, "events").groupBy("user_id").agg(own.alias("payload"))
    both = lists.withColumn("payload", F.when(F.col("user_id") % 2 == 0, F.to_json(F.struct(F.col("payload").alias("d")))).otherwise(F.col("payload")))
    rows = readers.json_records(both, "payload", "array<struct<event_id:long,props:string>>")
    return rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("record.props", "$.k").cast("long")).alias("k")
    )


@query("src7_sheet_header", "SELECT r_name AS sheet, n_name AS name, n_nationkey::DOUBLE AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def src7(s: X, d: str) -> D:
    rows = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = F.row_number().over(Window.partitionBy("r_name").orderBy("n_nationkey")) + F.lit(2)
    body = rows.select(F.col("r_name").alias("sheet"), place.alias("row"), F.col("n_name").alias("a"), F.col("n_nationkey").cast("string").alias("b"))
    notes = rows.select(F.col("r_name").alias("sheet")).distinct()
    head = notes.select("sheet", F.lit(1).alias("row"), F.lit("notes").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(
        notes.select("sheet", F.lit(2).alias("row"), F.lit("Nation Name").alias("a"), F.lit("Key Value").alias("b"))
    )
    cells = head.unionByName(body).select("sheet", "row", F.posexplode(F.array("a", "b")).alias("col", "val"))
    return readers.sheet_records(cells, {"name": "nation name", "value": "key value"}).select(
        "sheet", "name", F.col("value").cast("double").alias("value")
    )


@query(
    "src8_html_records",
    r"""SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)">([^<]*)<', 1)) AS href, unnest(regexp_extract_all(html, 'href="(/[^"]*)">([^<]*)<', 2)) AS label FROM pages""",
)
def src8(s: X, d: str) -> D:
    return readers.regex_records(table(s, d, "pages"), "html", r'href="(/[^"]*)">([^<]*)<', ["href", "label"]).select("page_id", "href", "label")


@query(
    "src10_missing_days",
    """WITH c AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders WHERE o_orderpriority = '1-URGENT')
       SELECT d::DATE AS date FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM c) WHERE d::DATE NOT IN (SELECT date FROM c)""",
)
def src10(s: X, d: str) -> D:
    return readers.missing_days(table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("date")))


@query(
    "src12_multi_source",
    sql("SELECT date, source, round(yield_pct, 6) AS yield_pct FROM auctions_by_source", "auctions_by_source"),
)
def src12(s: X, d: str) -> D:
    rows = A.auctions_by_source(s, d)
    parts = {x: rows.where(F.col("source") == x).drop("source") for x in ("A", "N", "R")}
    return readers.tagged_union(parts).select("date", "source", F.round("yield_pct", 6).alias("yield_pct"))


@query(
    "src13_dated_names",
    """SELECT DISTINCT o_orderdate::DATE AS date, CASE WHEN o_orderdate < TIMESTAMP '1997-07-08' THEN 'fo' || strftime(o_orderdate, '%d') || upper(strftime(o_orderdate, '%b')) || strftime(o_orderdate, '%Y') || 'bhav.csv.zip'
       ELSE 'BhavCopy_NSE_FO_0_0_0_' || strftime(o_orderdate, '%Y%m%d') || '_F_0000.csv.zip' END AS name FROM orders""",
)
def src13(s: X, d: str) -> D:
    days = table(s, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return days.select("date", readers.archive_name(F.col("date"), "1997-07-08").alias("name"))


@query("snk_roundtrip", "SELECT r_regionkey AS k, r_name AS name FROM region")
def snk(s: X, d: str) -> D:
    rows = table(s, d, "region").select(F.col("r_regionkey").cast("int").alias("k"), F.col("r_name").alias("name"))
    path = scratch(s, "sink")
    readers.write_sorted_parquet(rows, path, "k")
    return s.read.parquet(path)


@query("snk4_ledger", "SELECT c_custkey AS id, sha256('{\"nation\":' || c_nationkey || ',\"segment\":\"' || c_mktsegment || '\"}') AS config FROM customer")
def snk4(s: X, d: str) -> D:
    path = scratch(s, "ledger")
    rows = table(s, d, "customer").select("c_custkey", S.canonical_json(nation=F.col("c_nationkey"), segment=F.col("c_mktsegment")).alias("config"))
    half = rows.where("c_custkey % 2 = 0"), rows.where("c_custkey % 2 = 1")
    for part in half:
        readers.append_ledger(part.select(F.col("c_custkey").alias("id"), S.sha256_text(F.col("config")).alias("config")), path)
    return s.read.schema("config string, id long").json(path).select("id", "config")


# Projections, filters, cleaning


@query("prj1_rename_dispatch", "SELECT o_orderkey AS id, o_totalprice AS value FROM orders")
def prj1(s: X, d: str) -> D:
    layouts = {"o_orderkey": "id", "o_totalprice": "value"}, {"l_orderkey": "id", "l_tax": "value"}
    return readers.rename_layout(table(s, d, "orders"), layouts).select("id", "value")


@query("prj2_trim_all", "SELECT trim(c_name) AS name, trim(c_mktsegment) AS segment FROM customer")
def prj2(s: X, d: str) -> D:
    rows = table(s, d, "customer").select(
        F.concat(F.lit("  "), "c_name").alias(" name "), F.concat("c_mktsegment", F.lit(" ")).alias("segment"), F.lit("x").alias("Unnamed: 3")
    )
    return R.trim_all(rows)


@query("prj5_map_values", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'FUT' WHEN 'O' THEN 'OPT' END AS kind FROM orders")
def prj5(s: X, d: str) -> D:
    return table(s, d, "orders").select("o_orderkey", R.map_values(F.col("o_orderstatus"), {"F": "FUT", "O": "OPT"}).alias("kind"))


@query("prj6_strict_cast", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS q FROM lineitem")
def prj6(s: X, d: str) -> D:
    text = F.when(F.col("l_linenumber") == 3, "  ").otherwise(F.concat(F.lit(" "), F.col("l_quantity").cast("string")))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", R.strict_double(text).alias("q"))


@query("prj7_lenient_cast", "SELECT event_id, value FROM events WHERE event_type <> 'click'")
def prj7(s: X, d: str) -> D:
    text = F.when(F.col("event_type") == "click", "n/a").otherwise(F.col("value").cast("string"))
    return table(s, d, "events").select("event_id", R.lenient_double(text).alias("value")).where("value is not null")


@query("prj8_sentinel", "SELECT event_id, CASE WHEN event_type <> 'view' THEN value END AS value FROM events")
def prj8(s: X, d: str) -> D:
    text = F.when(F.col("event_type") == "view", " - ").otherwise(F.col("value").cast("string"))
    return table(s, d, "events").select("event_id", R.sentinel_double(text).alias("value"))


@query("prj9_overwrite", sql("SELECT date, opt_type, CASE WHEN opt_type = 'CE' THEN strike END AS strike, volume FROM panel", "panel"))
def prj9(s: X, d: str) -> D:
    return A.panel(s, d).select("date", "opt_type", F.when(F.col("opt_type") == "CE", F.col("strike")).alias("strike"), "volume")


@query("prj11_type_test", "SELECT event_id, try_cast(substr(props, 1, 10) AS DATE) IS NOT NULL AS is_date FROM events")
def prj11(s: X, d: str) -> D:
    return table(s, d, "events").select("event_id", F.substring("props", 1, 10).try_cast("date").isNotNull().alias("is_date"))


@query("fil1_equality_in", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey = 7")
def fil1(s: X, d: str) -> D:
    return table(s, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.col("c_nationkey") == 7)).select("c_custkey")


@query("fil2_range", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'")
def fil2(s: X, d: str) -> D:
    low, high = (F.lit(x).cast("timestamp_ntz") for x in ("1996-01-01", "1996-12-31"))
    return table(s, d, "orders").where(F.col("o_orderdate").between(low, high)).select("o_orderkey")


@query("fil3_dynamic_in", sql("SELECT date, strike, opt_type, volume FROM panel WHERE date IN (SELECT expiry FROM expiries)", "expiries"))
def fil3(s: X, d: str) -> D:
    ends = A.monthly_expiries(A.forward(s, d))
    return A.panel(s, d).join(ends, F.col("date") == F.col("expiry"), "left_semi").select("date", "strike", "opt_type", "volume")


@query("fil4_horizon", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE datediff('day', o_orderdate, l_shipdate) BETWEEN 0 AND 70")
def fil4(s: X, d: str) -> D:
    rows = table(s, d, "orders").join(table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.where(F.datediff("l_shipdate", "o_orderdate").between(0, 70)).select("o_orderkey", "l_linenumber")


@query("fil5_liquidity", sql("SELECT date, strike, opt_type FROM panel WHERE volume > 40", "panel"))
def fil5(s: X, d: str) -> D:
    return A.panel(s, d).where("volume > 40").select("date", "strike", "opt_type")


@query("fil6_assert_dates", "SELECT count(*) AS n FROM orders")
def fil6(s: X, d: str) -> D:
    """Files named by month; every row must be of its file's month."""
    path = scratch(s, "by-month")
    own = table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"), F.date_format("o_orderdate", "yyyy-MM").alias("file_month"))
    own.repartition("file_month").write.partitionBy("file_month").parquet(path)
    rows = s.read.schema("o_orderkey long, date date").parquet(path)
    file_month = F.regexp_extract(F.col("_metadata.file_path"), "file_month=([0-9-]+)", 1)
    return readers.assert_rows(rows, F.date_format("date", "yyyy-MM") == file_month, "rows of another month").agg(F.count("o_orderkey").alias("n"))


@query("fil7_drop_missing", sql("SELECT series_id, date, round(r, 6) AS r FROM rets WHERE r IS NOT NULL", "rets"))
def fil7(s: X, d: str) -> D:
    return A.rets(s, d).na.drop("any").select("series_id", "date", F.round("r", 6).alias("r"))


@query("fil8_where_other", sql("SELECT date, strike, opt_type, round(CASE WHEN volume > 40 THEN close ELSE settle END + 1e-9, 6) AS px FROM panel", "panel"))
def fil8(s: X, d: str) -> D:
    px = F.when(F.col("volume") > 40, F.col("close")).otherwise(F.col("settle"))
    return A.panel(s, d).select("date", "strike", "opt_type", F.round(px + 1e-9, 6).alias("px"))


@query("cln1_glued_records", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def cln1(s: X, d: str) -> D:
    one = F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string"))
    lines = table(s, d, "nation").groupBy(F.floor(F.col("n_nationkey") / 2).alias("g")).agg(F.array_join(F.sort_array(F.collect_list(one)), ",").alias("value"))
    blank = s.createDataFrame([("",), ("  ",)], "value string")
    rows = R.repair_lines(lines.select("value").unionByName(blank), 3)
    return rows.select(F.col("record")[0].cast("int").alias("n_nationkey"), F.col("record")[1].alias("n_name"), F.col("record")[2].cast("int").alias("n_regionkey"))


@query("cln2_empty_schema", "SELECT n_nationkey, n_name FROM nation WHERE false")
def cln2(s: X, d: str) -> D:
    return s.createDataFrame([], table(s, d, "nation").select("n_nationkey", "n_name").schema)


# Joins


@query(
    "jn1_left_equi",
    sql("SELECT p.date, round(p.price, 4) AS price, round(t.tri, 4) AS tri FROM price p LEFT JOIN tri t ON p.date = t.date", "price", "tri"),
)
def jn1(s: X, d: str) -> D:
    return A.price(s, d).select("date", "price").join(A.tri(s, d).select("date", "tri"), "date", "left").select(
        "date", F.round("price", 4).alias("price"), F.round("tri", 4).alias("tri")
    )


@query("jn2_inner_multi_key", sql("SELECT a.date, a.strike, a.volume AS call_volume, b.volume AS put_volume FROM panel a JOIN panel b ON a.date = b.date AND a.strike = b.strike WHERE a.opt_type = 'CE' AND b.opt_type = 'PE'", "panel"))
def jn2(s: X, d: str) -> D:
    rows = A.panel(s, d)
    calls = rows.where("opt_type = 'CE'").select("date", "strike", F.col("volume").alias("call_volume"))
    puts = rows.where("opt_type = 'PE'").select("date", "strike", F.col("volume").alias("put_volume"))
    return calls.join(puts, ["date", "strike"])


@query("jn3_metadata", "SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def jn3(s: X, d: str) -> D:
    return table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name", "c_mktsegment")


@query("jn4_asof_rate", sql("SELECT p.date, round(a.yield_pct, 6) AS yield_pct FROM price p ASOF LEFT JOIN auctions a ON p.date >= a.date", "price", "auctions"))
def jn4(s: X, d: str) -> D:
    return J.asof(A.price(s, d).select("date"), A.auctions(s, d), "date", "yield_pct").select("date", F.round("yield_pct", 6).alias("yield_pct"))


@query("jn5_asof_forward", sql("SELECT f.date, (SELECT min(expiry) FROM expiries WHERE expiry >= f.date + INTERVAL 7 DAY) AS target FROM forward f", "expiries"))
def jn5(s: X, d: str) -> D:
    rows = A.forward(s, d)
    ends = A.monthly_expiries(rows).select(F.col("expiry").alias("at"), F.col("expiry").alias("target"))
    probes = rows.select("date", F.date_add("date", 7).alias("at"))
    return J.asof(probes, ends, "at", "target", forward=True).select("date", "target")


@query("jn6_next_day", sql("SELECT expiry, (SELECT min(date) FROM forward WHERE date > expiry) AS next_date FROM expiries", "expiries"))
def jn6(s: X, d: str) -> D:
    days = A.forward(s, d).select("date")
    nexts = J.next_in_calendar(days, keys=[F.lit(1)])
    return A.monthly_expiries(days).join(nexts, F.col("expiry") == F.col("date"), "left").select("expiry", "next_date")


@query("jn7_lookup_default", sql("SELECT e.expiry, round(t.tri, 4) AS settle FROM expiries e LEFT JOIN tri t ON t.date = e.expiry", "expiries", "tri"))
def jn7(s: X, d: str) -> D:
    ends = A.monthly_expiries(A.forward(s, d))
    return ends.join(A.tri(s, d), F.col("expiry") == F.col("date"), "left").select("expiry", F.round("tri", 4).alias("settle"))


@query(
    "jn8_align_spine",
    sql("SELECT c.d::DATE AS date, round(p.price, 4) AS price FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM price) c LEFT JOIN price p ON p.date = c.d::DATE", "price"),
)
def jn8(s: X, d: str) -> D:
    rows = A.price(s, d)
    spine = rows.agg(F.explode(F.sequence(F.min("date"), F.max("date"))).alias("date"))
    return J.align(spine, rows.select("date", F.round("price", 4).alias("price")), "date")


@query("jn9_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def jn9(s: X, d: str) -> D:
    return table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query(
    "jn10_mismatches",
    sql("SELECT date, 'a' AS side FROM price WHERE date NOT IN (SELECT date FROM tri) UNION ALL SELECT date, 'b' FROM tri WHERE date NOT IN (SELECT date FROM price)", "price", "tri"),
)
def jn10(s: X, d: str) -> D:
    return J.mismatches(A.price(s, d), A.tri(s, d), "date")


@query("jn11_map_fallback", "SELECT o_orderkey, coalesce(c_name, o_custkey::VARCHAR) AS who FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def jn11(s: X, d: str) -> D:
    names = table(s, d, "customer").where("c_acctbal > 0")
    return table(s, d, "orders").join(names, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        "o_orderkey", F.coalesce("c_name", F.col("o_custkey").cast("string")).alias("who")
    )


@query(
    "jn12_target_rows",
    sql("SELECT p.date, p.strike, p.opt_type FROM panel p JOIN (SELECT date_trunc('month', expiry)::DATE AS m, expiry FROM expiries) e ON date_trunc('month', p.date)::DATE = e.m AND p.date = e.expiry", "expiries"),
)
def jn12(s: X, d: str) -> D:
    target = A.monthly_expiries(A.forward(s, d)).select(F.trunc("expiry", "MM").alias("m"), "expiry")
    rows = A.panel(s, d).withColumn("m", F.trunc("date", "MM"))
    return rows.join(target, (rows["m"] == target["m"]) & (F.col("date") == F.col("expiry"))).select("date", "strike", "opt_type")


@query("jn13_interval", sql("SELECT c.cycle, f.date, round(f.fut, 6) AS fut FROM forward f JOIN cycles c ON f.date BETWEEN c.entry AND c.expiry", "cycles"))
def jn13(s: X, d: str) -> D:
    rows = A.forward(s, d)
    return J.in_interval(rows, A.cycles(rows), "date", "entry", "expiry").select("cycle", "date", F.round("fut", 6).alias("fut"))


@query("jn14_positions", sql("SELECT e.expiry, p.pos FROM expiries e JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM forward) p ON p.date = e.expiry", "expiries"))
def jn14(s: X, d: str) -> D:
    days = A.forward(s, d).select("date", (F.row_number().over(W.by_date(F.lit(1))) - 1).cast("long").alias("pos"))
    found = A.monthly_expiries(days).join(days, F.col("expiry") == F.col("date"), "left")
    found = found.withColumn("pos", F.when(F.col("pos").isNull(), F.raise_error(F.lit("date is not in the calendar")).cast("long")).otherwise(F.col("pos")))
    return found.select("expiry", "pos")


@query(
    "jn15_refit_overlap",
    sql("""SELECT a.refit, count(*) AS overlap FROM (SELECT g AS refit, date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM price), range(1, 9) t(g) WHERE pos BETWEEN g * 250 - 400 AND g * 250) a
     JOIN (SELECT g AS refit, date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM price), range(1, 9) t(g) WHERE pos BETWEEN g * 250 - 400 AND g * 250) b ON a.date = b.date AND a.refit = b.refit - 1 GROUP BY ALL""", "price"),
)
def jn15(s: X, d: str) -> D:
    days = A.price(s, d).select("date", (F.row_number().over(W.by_date(F.lit(1))) - 1).alias("pos"))
    first, last = F.ceil(F.col("pos") / 250), F.floor((F.col("pos") + 400) / 250)
    rows = days.withColumn("refit", F.explode(F.sequence(F.greatest(first, F.lit(1)), F.greatest(F.least(last, F.lit(8)), first, F.lit(1)))))
    rows = rows.where((F.col("refit") <= 8) & F.col("pos").between(F.col("refit") * 250 - 400, F.col("refit") * 250))
    a, b = rows.select("refit", "date"), rows.select((F.col("refit") - 1).alias("refit"), "date")
    return a.join(b, ["refit", "date"]).groupBy("refit").agg(F.count(F.lit(1)).alias("overlap"))


@query(
    "jn16_gather",
    sql("SELECT i, round(price, 4) AS v FROM (SELECT i, (i * 37 + 11) % (SELECT count(*) FROM price) AS pos FROM range(5000) t(i)) JOIN (SELECT price, row_number() OVER (ORDER BY date) - 1 AS pos FROM price) USING (pos)", "price"),
)
def jn16(s: X, d: str) -> D:
    one = Window.partitionBy(F.lit(1))
    rows = A.price(s, d).select("price", (F.row_number().over(one.orderBy("date")) - 1).cast("long").alias("pos"), F.count(F.lit(1)).over(one).alias("n"))
    n = rows.select(F.max("n").alias("total"))
    picks = s.range(5000).join(F.broadcast(n)).select(F.col("id").alias("i"), ((F.col("id") * 37 + 11) % F.col("total")).alias("pos"))
    return picks.join(rows, "pos").select("i", F.round("price", 4).alias("v"))


# Aggregates


@query("agg1_first_last", sql("SELECT series_id, min(date) AS first_date, max(date) AS last_date, count(*) AS n, round(arg_min(price, date), 4) AS first_price, round(arg_max(price, date), 4) AS last_price FROM prices GROUP BY ALL", "prices"))
def agg1(s: X, d: str) -> D:
    return A.prices(s, d).groupBy("series_id").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n"),
        F.round(F.min_by("price", "date"), 4).alias("first_price"), F.round(F.max_by("price", "date"), 4).alias("last_price"),
    )


@query("agg2_transform_max", sql("SELECT series_id, date, max(date) OVER (PARTITION BY series_id, date_trunc('month', date)) AS month_last FROM prices", "prices"))
def agg2(s: X, d: str) -> D:
    return A.prices(s, d).select("series_id", "date", F.max("date").over(Window.partitionBy("series_id", F.trunc("date", "MM"))).alias("month_last"))


@query("agg3_group_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) <> 10")
def agg3(s: X, d: str) -> D:
    return table(s, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n <> 10")


@query("agg4_pivot_mean", sql("SELECT date, strike, round(avg(settle) FILTER (opt_type = 'CE'), 6) AS settle_ce, round(avg(settle) FILTER (opt_type = 'PE'), 6) AS settle_pe FROM panel GROUP BY ALL HAVING count(*) FILTER (opt_type = 'CE') > 0 AND count(*) FILTER (opt_type = 'PE') > 0", "panel"))
def agg4(s: X, d: str) -> D:
    out = R.pivot_mean(A.panel(s, d), ["date", "strike"], "opt_type", ["CE", "PE"], ["settle"]).na.drop("any")
    return out.withColumns({c: F.round(c, 6) for c in ("settle_ce", "settle_pe")})


@query(
    "agg5_pivot_multi",
    sql("SELECT date, strike, " + ", ".join(f"round(avg({m}) FILTER (opt_type = '{o}') + 1e-9, 6) AS {m}_{o.lower()}" for m in ("close", "settle", "volume") for o in ("CE", "PE")) + " FROM panel GROUP BY ALL", "panel"),
)
def agg5(s: X, d: str) -> D:
    out = R.pivot_mean(A.panel(s, d), ["date", "strike"], "opt_type", ["CE", "PE"], ["close", "settle", "volume"])
    return out.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in out.columns[2:]})


@query("agg6_group_means", "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 6) AS l_extendedprice, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) + 0.0 AS l_tax FROM lineitem GROUP BY ALL")
def agg6(s: X, d: str) -> D:
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(*[(F.round(F.avg(c), 6) + F.lit(0.0)).alias(c) for c in names])


@query("agg7_multi", "SELECT event_type, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY ALL")
def agg7(s: X, d: str) -> D:
    return table(s, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("agg8_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def agg8(s: X, d: str) -> D:
    return table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("agg9_distinct", "SELECT DISTINCT p_size FROM part")
def agg9(s: X, d: str) -> D:
    return table(s, d, "part").select("p_size").distinct()


@query("agg10_quantiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.8), 6) AS q80, round(quantile_cont(value, 0.05), 6) AS q05 FROM events GROUP BY ALL")
def agg10(s: X, d: str) -> D:
    return table(s, d, "events").groupBy("event_type").agg(*[F.round(F.percentile("value", p), 6).alias(n) for n, p in (("median", 0.5), ("q80", 0.8), ("q05", 0.05))])


@query("agg11_share_true", "SELECT event_type, round(avg((value > 10)::INT), 6) AS share FROM events GROUP BY ALL")
def agg11(s: X, d: str) -> D:
    return table(s, d, "events").groupBy("event_type").agg(F.round(F.avg((F.col("value") > 10).cast("int")), 6).alias("share"))


_MOMENTS = """SELECT event_type, round(m, 6) AS mean, round(sqrt(s2 * n / (n - 1)), 6) AS sd1, round(sqrt(s2), 6) AS sd0, round(s3 / pow(s2, 1.5), 5) AS skew, round(s4 / (s2 * s2), 5) AS kurt FROM
 (SELECT event_type, any_value(m) AS m, count(*) AS n, avg(pow(value - m, 2)) AS s2, avg(pow(value - m, 3)) AS s3, avg(pow(value - m, 4)) AS s4
  FROM (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY event_type)"""


@query("agg12_moments", _MOMENTS)
def agg12(s: X, d: str) -> D:
    v = F.col("value")
    return table(s, d, "events").groupBy("event_type").agg(
        F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("sd1"), F.round(F.stddev_pop(v), 6).alias("sd0"),
        F.round(F.skewness(v), 5).alias("skew"), F.round(F.kurtosis(v) + 3, 5).alias("kurt"),
    )


@query("agg13_product", "SELECT l_returnflag, round(exp(sum(ln(1 + l_discount * 0.001))), 6) AS growth FROM lineitem GROUP BY ALL")
def agg13(s: X, d: str) -> D:
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.product(1 + F.col("l_discount") * 0.001), 6).alias("growth"))


@query("agg14_correlations", sql("SELECT a.series_id AS a, b.series_id AS b, round(corr(a.r, b.r), 6) AS rho FROM rets a JOIN rets b ON a.date = b.date AND a.series_id < b.series_id GROUP BY ALL", "rets"))
def agg14(s: X, d: str) -> D:
    rows = A.rets(s, d)
    a = rows.select("date", F.col("series_id").alias("a"), F.col("r").alias("ra"))
    b = rows.select("date", F.col("series_id").alias("b"), F.col("r").alias("rb"))
    return a.join(b, "date").where("a < b").groupBy("a", "b").agg(F.round(F.corr("ra", "rb"), 6).alias("rho"))


@query("agg15_arg_min_tie", sql("SELECT p.date, arg_min(p.strike, (round(abs(p.strike - f.fut), 9), p.strike)) AS strike FROM panel p JOIN forward f USING (date) GROUP BY ALL", "forward"))
def agg15(s: X, d: str) -> D:
    rows = A.panel(s, d).join(A.forward(s, d), "date")
    return rows.groupBy("date").agg(F.min_by("strike", J.nearest(F.col("strike"), F.col("fut"))).alias("strike"))


@query("agg16_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def agg16(s: X, d: str) -> D:
    return R.duplicates(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "agg17_weekdays",
    sql("SELECT a AS date, b AS next_date, (SELECT count(*) FROM generate_series(a, b - INTERVAL 1 DAY, INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6)::INT AS n FROM (SELECT date AS a, lead(date) OVER (ORDER BY date) AS b FROM price) WHERE b IS NOT NULL", "price"),
)
def agg17(s: X, d: str) -> D:
    rows = J.next_in_calendar(A.price(s, d).select("date"), keys=[F.lit(1)]).where("next_date is not null")
    return rows.select("date", "next_date", S.weekdays_between(F.col("date"), F.col("next_date")).alias("n"))


@query("agg18_block_sums", sql("SELECT series_id, floor((row_number() OVER (PARTITION BY series_id ORDER BY date) - 1) / 100)::BIGINT AS block, r FROM rets", "rets").replace("WITH ", "SELECT series_id, block, count(r) AS n, round(sum(r), 6) AS sx, round(sum(r * r), 6) AS sxx FROM (WITH ", 1) + ") GROUP BY ALL")
def agg18(s: X, d: str) -> D:
    rows = A.rets(s, d).withColumn("block", F.floor((F.row_number().over(W.by_date("series_id")) - 1) / 100))
    return rows.groupBy("series_id", "block").agg(
        F.count("r").alias("n"), F.round(F.sum("r"), 6).alias("sx"), F.round(F.sum(F.col("r") * F.col("r")), 6).alias("sxx")
    )


# Sorts, limits, sets


@query("srt1_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def srt1(s: X, d: str) -> D:
    """A total order with places: range partitions are sorted side by side, and a place is the partition's offset plus its own."""
    rows = table(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")
    path = scratch(s, "sorted")  # one file a range, named in the ranges' order
    rows.write.parquet(path)
    part = F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)", 1).cast("int")
    saved = s.read.schema(rows.schema).parquet(path).withColumn("part", part)
    sizes = saved.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("part")) - F.col("n")  # one row a partition
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return saved.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").select("o_orderkey", (F.col("before") + own).alias("place"))


@query(
    "srt2_keep_highest",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) WHERE n = 1",
)
def srt2(s: X, d: str) -> D:
    order = [F.desc("l_quantity"), *map(F.col, ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"))]
    return R.keep_first(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], *order).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("srt3_priority", sql("SELECT date, arg_min(source, CASE source WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS source FROM auctions_by_source GROUP BY ALL", "auctions_by_source"))
def srt3(s: X, d: str) -> D:
    return R.by_priority(A.auctions_by_source(s, d), ["date"], "source", ["R", "A", "N"]).select("date", "source")


@query("srt4_first_per_group", sql("SELECT date, strike FROM (SELECT date, strike, row_number() OVER (PARTITION BY date ORDER BY volume DESC, strike, opt_type) AS n FROM panel) WHERE n = 1", "panel"))
def srt4(s: X, d: str) -> D:
    return R.keep_first(A.panel(s, d), ["date"], F.desc("volume"), F.col("strike"), F.col("opt_type")).select("date", "strike")


@query(
    "srt6_neighbours",
    sql("""SELECT date, strike FROM (SELECT *, max(CASE WHEN strike = atm THEN k END) OVER (PARTITION BY date) AS c FROM (SELECT *, dense_rank() OVER (PARTITION BY date ORDER BY strike) AS k FROM
     (SELECT DISTINCT p.date, p.strike, f.atm FROM panel p JOIN (SELECT p.date, arg_min(p.strike, (round(abs(p.strike - f.fut), 9), p.strike)) AS atm FROM panel p JOIN forward f USING (date) GROUP BY ALL) f USING (date)))) WHERE k BETWEEN c - 1 AND c + 1""", "forward"),
)
def srt6(s: X, d: str) -> D:
    rows = A.panel(s, d).join(A.forward(s, d), "date").select("date", "strike", "fut").distinct()
    w = Window.partitionBy("date")
    rows = rows.withColumn("k", F.dense_rank().over(w.orderBy("strike"))).withColumn("c", F.min_by("k", J.nearest(F.col("strike"), F.col("fut"))).over(w))
    return rows.where(F.col("k").between(F.col("c") - 1, F.col("c") + 1)).select("date", "strike")


@query("srt7_first_second", sql("SELECT min(expiry) AS near, (SELECT expiry FROM expiries ORDER BY expiry OFFSET 1 LIMIT 1) AS next FROM expiries", "expiries"))
def srt7(s: X, d: str) -> D:
    first = F.slice(F.sort_array(F.collect_list("expiry")), 1, 2)
    ends = A.monthly_expiries(A.forward(s, d)).orderBy("expiry").limit(2)
    return ends.agg(first.alias("e")).select(F.col("e")[0].alias("near"), F.col("e")[1].alias("next"))


@query("srt8_first_on_date", "SELECT date, o_orderkey FROM (SELECT o_orderdate::DATE AS date, o_orderkey, row_number() OVER (PARTITION BY o_orderdate::DATE ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1")
def srt8(s: X, d: str) -> D:
    return R.keep_first(table(s, d, "orders").withColumn("date", F.to_date("o_orderdate")), ["date"], F.col("o_orderkey")).select("date", "o_orderkey")


@query("lim1_head", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def lim1(s: X, d: str) -> D:
    return table(s, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(10).select("c_custkey", "c_acctbal")


@query("set1_union_all", "SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def set1(s: X, d: str) -> D:
    a = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)


@query("set2_index_union", sql("SELECT date FROM price UNION SELECT date FROM tri", "price", "tri"))
def set2(s: X, d: str) -> D:
    return A.price(s, d).select("date").union(A.tri(s, d).select("date")).distinct()


@query("set3_difference", sql("SELECT date FROM price EXCEPT SELECT date FROM tri", "price", "tri"))
def set3(s: X, d: str) -> D:
    return A.price(s, d).select("date").subtract(A.tri(s, d).select("date"))


@query("set4_both_legs", sql("SELECT date, strike FROM panel WHERE opt_type = 'CE' INTERSECT SELECT date, strike FROM panel WHERE opt_type = 'PE'", "panel"))
def set4(s: X, d: str) -> D:
    rows = A.panel(s, d).groupBy("date", "strike").agg(F.collect_set("opt_type").alias("t"))
    return rows.where(F.size("t") == 2).select("date", "strike")


# Scalars


@query("sca1_parse_dates", "SELECT o_orderkey, o_orderdate::DATE AS date FROM orders")
def sca1(s: X, d: str) -> D:
    day = F.to_date("o_orderdate")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.upper(S.format_day_month_year(day))).when(
        F.col("o_orderkey") % 3 == 1, F.replace(S.format_day_month_year(day), F.lit("-"), F.lit(" "))
    ).otherwise(F.lower(S.format_day_month_year(day)))
    return table(s, d, "orders").select("o_orderkey", S.parse_day_month_year(text).alias("date"))


@query("sca2_format_dates", "SELECT o_orderkey, strftime(o_orderdate, '%d-%b-%Y') AS text FROM orders")
def sca2(s: X, d: str) -> D:
    return table(s, d, "orders").select("o_orderkey", S.format_day_month_year(F.to_date("o_orderdate")).alias("text"))


@query("sca4_canonical_hash", "SELECT n_nationkey, sha256('{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}') AS digest FROM nation")
def sca4(s: X, d: str) -> D:
    return table(s, d, "nation").select("n_nationkey", S.sha256_text(S.canonical_json(region=F.col("n_regionkey"), name=F.col("n_name"))).alias("digest"))


@query("sca5_newline_digest", "SELECT item_id, sha256(text) AS digest FROM benchmark")
def sca5(s: X, d: str) -> D:
    text = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    return table(s, d, "benchmark").select("item_id", S.newline_neutral_digest(text.cast("binary")).alias("digest"))
