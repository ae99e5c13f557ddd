"""Queries over readers, writers, contracts and look-ups, on tables that Spark derives from the given ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nature as NA
from ..functions import numbers as N
from ..functions import text as TX
from ..operators import change, contracts, gold, lakehouse, lookup
from ..schema import ContractError
from ..sources import readers, sinks
from ..sources.scratch import folder
from . import fixtures as X
from .registry import query
from .series_queries import rounded


@query("SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS day, round(o_totalprice, 2) AS price FROM orders")
def long_csv(spark, d):
    path = folder(spark, "csv")
    orders = X.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("day"), F.round("o_totalprice", 2).alias("price"))
    orders.write.option("header", True).csv(path)
    return readers.long_csv(spark, path, "o_orderkey long, o_orderstatus string, day date, price double")


@query("SELECT 'ORDERS:year' AS series_id, make_date(y, 1, 1) AS period_start, make_date(y, 12, 31) AS date, v AS value FROM (SELECT year(CAST(o_orderdate AS DATE)) AS y, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1)")
def annual_csv(spark, d):
    path = folder(spark, "annual")
    X.table(spark, d, "orders").groupBy(F.year(F.to_date("o_orderdate")).alias("year")).agg(F.count("*").alias("value")).write.option("header", True).csv(path)
    return readers.annual_csv(spark, path, "ORDERS:year", "ORDERS", "pieces").select("series_id", "period_start", "date", "value")


@query(X.sql("SELECT series_id, dims, date, round(value, 2) AS value FROM flow_m UNION ALL SELECT series_id, dims, date, round(value, 2) FROM year_y", "flow_m", "year_y"))
def discovered_sources(spark, d):
    columns = ["series_id", "dims", "date", "value"]
    pairs = {}
    for name, rows in (("monthly", X.flow_m(spark, d)), ("yearly", X.year_y(spark, d))):
        pairs[name] = (sinks.write_table(rows, folder(spark, f"{name}-facts")), sinks.write_table(X.metadata(spark), folder(spark, f"{name}-series")))
    return rounded(readers.discover(spark, pairs, columns, ["series_id"])[0], 2)


@query("SELECT last_day(CAST(o_orderdate AS DATE)) AS date, round(sum(o_totalprice), 0) AS value FROM orders GROUP BY 1")
def inline_series(spark, d):
    months = X.table(spark, d, "orders").groupBy(F.last_day(F.to_date("o_orderdate")).alias("m")).agg(F.sum("o_totalprice").alias("v"))
    rows = months.select(F.date_format("m", "dd.MM.yyyy").alias("Tarih"), F.translate(F.format_number("v", 2), ",.", ".,").alias("Değer"))
    return rounded(readers.inline_series(rows), 0)


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1")
def table_versions(spark, d):
    """A second version of a table while the first one is read; readers of either see it whole."""
    root, orders = folder(spark, "versions"), X.table(spark, d, "orders")
    first = spark.read.parquet(sinks.write_table(orders, root))
    second = spark.read.parquet(sinks.write_table(first.where("o_orderpriority <> '5-LOW'"), root))
    return rounded(second.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), 2)


@query("SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def sorted_table(spark, d):
    orders = X.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    return spark.read.parquet(sinks.write_sorted(orders, folder(spark, "sorted"), ["o_custkey", "o_orderkey"], 4))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-02-01' AND DATE '1998-02-03' ORDER BY o_orderkey LIMIT 2000")
def date_range_query(spark, d):
    orders = X.table(spark, d, "orders").withColumn("date", F.to_date("o_orderdate"))
    return rounded(lookup.table_query(spark, orders, ["o_orderkey", "o_totalprice"], start="1998-02-01", end="1998-02-03", order_by="o_orderkey", limit=2000), 2)


@query("SELECT event_type, 'half_range' AS half, 'unknown_column' AS unknown, 'not_read_only' AS writes, count(*) AS n FROM events GROUP BY 1")
def refused_requests(spark, d):
    """What requests that a table look-up refuses are told, by the kinds of events that it was asked for."""
    events = X.table(spark, d, "events").withColumnRenamed("props", "dims")

    def told(request):
        try:
            request()
        except ContractError as e:
            return e.code
        return "accepted"

    half = told(lambda: lookup.table_query(spark, events, start="2001-01-01"))
    unknown = told(lambda: lookup.table_query(spark, events.drop("dims"), ["no_such_column"]))
    writes = told(lambda: lookup.read_only("SELECT 1; DROP TABLE events"))
    return events.groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", F.lit(half).alias("half"), F.lit(unknown).alias("unknown"), F.lit(writes).alias("writes"), "n")


@query(
    """SELECT 'bad_accumulation' AS rule, count(*) FILTER (WHERE c_custkey % 5 = 0) AS n_rows FROM customer UNION ALL SELECT 'bad_nature', count(*) FILTER (WHERE c_mktsegment = 'BUILDING') FROM customer
 UNION ALL SELECT 'null_series_id', count(*) FILTER (WHERE c_custkey % 11 = 0) FROM customer"""
)
def metadata_violations(spark, d):
    c = X.table(spark, d, "customer")
    meta = c.select(
        F.when(F.col("c_custkey") % 11 == 0, " ").otherwise(F.col("c_name")).alias("series_id"), F.when(F.col("c_custkey") % 5 == 0, "sometimes").otherwise("none").alias("accumulation"), F.lit(False).alias("is_cumulative"),
        F.when(F.col("c_mktsegment") == "BUILDING", "odd").otherwise("flow").alias("nature"), F.lit(None).cast("string").alias("alignment_override"),
    )
    return contracts.series_violations(meta).where("rule in ('bad_accumulation', 'bad_nature', 'null_series_id')")


@query(X.sql("SELECT rule, n_rows FROM (SELECT 'not_monthly' AS rule, count(*) FILTER (WHERE dims LIKE '%ASIA%') AS n_rows FROM flow_m UNION ALL SELECT 'not_month_end', 0 FROM flow_m UNION ALL SELECT 'duplicate_key', 0 UNION ALL SELECT 'cumulative_leak', (SELECT count(*) FROM ytd_m)) GROUP BY ALL", "flow_m", "ytd_m"))
def aligned_violations(spark, d):
    freq = F.when(F.contains("dims", F.lit("ASIA")), "Q").otherwise("M")
    rows = X.flow_m(spark, d).unionByName(X.ytd_m(spark, d)).withColumn("aligned_freq", freq)
    return contracts.aligned_violations(rows, X.metadata(spark))


@query(X.sql("SELECT series_id || ':' || (year(date) % 3) AS series_id, count(DISTINCT CASE WHEN year(date) % 3 = 0 AND month(date) = 1 THEN 'eur' ELSE 'usd' END) AS n_variants FROM flow_m GROUP BY 1 HAVING n_variants > 1", "flow_m"))
def inconsistent_series(spark, d):
    y = F.year("date") % 3
    rows = X.flow_m(spark, d).withColumn("series_id", F.concat_ws(":", "series_id", y.cast("string"))).withColumn("unit", F.when((y == 0) & (F.month("date") == 1), "eur").otherwise("usd"))
    return contracts.inconsistent_series(rows).select("series_id", "n_variants")


@query("SELECT c_custkey, CAST(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE round(c_acctbal, 2) END AS DOUBLE) AS mostly, c_name AS never FROM customer")
def coerced_columns(spark, d):
    said = F.translate(F.format_number("c_acctbal", 2), ",.", ".,")
    c = X.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "").otherwise(said).alias("mostly"), F.col("c_name").alias("never"))
    return rounded(N.coerce_columns(c, ["mostly", "never"]), 2)


@query("SELECT p_partkey, ['Q', 'D', 'M', 'W', 'Y', 'D'][p_size % 6 + 1] AS freq FROM part")
def source_frequencies(spark, d):
    texts = F.array(*[F.lit(x) for x in ("3 Aylık veri", "GÜNLÜK", "Aylık ortalama", "haftalık", "yıllık", "başka")])
    p = X.table(spark, d, "part")
    return p.select("p_partkey", TX.frequency(F.concat(texts[F.col("p_size") % 6], F.lit(" "))).alias("freq"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'ffill' WHEN c_mktsegment = 'BUILDING' THEN 'sum' WHEN c_mktsegment = 'MACHINERY' THEN 'mean' ELSE 'last' END AS policy FROM customer")
def shown_policies(spark, d):
    nature = F.when(F.col("c_mktsegment") == "BUILDING", "flow").when(F.col("c_mktsegment") == "MACHINERY", "rate").otherwise("stock")
    return X.table(spark, d, "customer").select("c_custkey", NA.display_policy(F.when(F.col("c_custkey") % 3 == 0, "ffill").otherwise(""), nature).alias("policy"))


@query(
    X.sql(
        """SELECT date, dims, round(value, 2) AS value, round((value - m) / NULLIF(abs(m), 0), 6) AS mom_pct FROM (SELECT *, CASE WHEN date_diff('month', lag(date) OVER w, date) = 1 THEN lag(value) OVER w END AS m FROM gap_m WINDOW w AS (PARTITION BY series_id, dims ORDER BY date))""",
        "gap_m",
    )
)
def gold_with_change(spark, d):
    """Gold rows with their own periodic changes, by series, dims and date."""
    rows = X.gap_m(spark, d)
    out = gold.with_change(rows, change.periodic(rows))
    return rounded(out.select("date", "dims", "value", "mom_pct"), 2, mom_pct=6)


@query(X.sql("SELECT 'gold_geo' AS table_name, count(*) AS n FROM (SELECT date, json_extract_string(dims, '$.province') FROM geo_rows GROUP BY 1, 2) UNION ALL SELECT 'gold_change', count(*) FROM flow_m UNION ALL SELECT 'gold_worst', count(DISTINCT date) FROM geo_rows", "geo_rows", "flow_m"))
def gold_build(spark, d):
    """Three gold tables in order; the third is made of the first."""
    meta = X.metadata(spark)
    steps = {
        "gold_geo": lambda t: gold.geo_quality(X.geo_rows(spark, d), {"province": "province"}, "GEO:good", "GEO:bad"),
        "gold_change": lambda t: gold.periodic_change(X.flow_m(spark, d), meta),
        "gold_worst": lambda t: t["gold_geo"].groupBy("date").agg(F.max("bad_ratio").alias("worst")),
    }
    built = gold.build_all(steps, {})
    out = None
    for name in steps:
        one = built[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 'EVDS:' || 'TP.C' || c_custkey AS series_id, DATE '2001-03-31' AS date, CAST(c_custkey + 1 AS DOUBLE) AS value FROM customer")
def api_silver(spark, d):
    """Two readings of one month: the later one stays, wherever its row stands."""
    c = X.table(spark, d, "customer").select(F.concat(F.lit("TP.C"), F.col("c_custkey").cast("string")).alias("code"), F.col("c_custkey").cast("double").alias("v"))
    rows = c.select("code", F.lit("2001-03-01").cast("date").alias("date"), F.col("v").alias("value")).unionByName(c.select("code", F.lit("2001-03-15").cast("date").alias("date"), (F.col("v") + 1).alias("value")))
    kinds = c.select("code", F.lit("AYLIK").alias("freq_text"), F.lit("tl").alias("unit"))
    return lakehouse.api_silver(rows, kinds, "EVDS").select("series_id", "date", "value")
