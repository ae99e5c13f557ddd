"""Queries over the lakehouse builders: each takes tables of orders for a source's bulletins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims as D
from ..functions import nature as NA
from ..operators import align, change, gold, health, lakehouse
from ..operators import search as S
from ..sources import catalog, readers, sinks
from ..sources.scratch import folder, written
from . import fixtures as X
from .registry import query
from .series_queries import _CHANGE, _MDIFF, rounded

_PRIORITY = "regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g')"


def _weekly(spark, d):
    """A weekly bulletin: total price by priority and status on Fridays."""
    day = F.to_date("o_orderdate")
    rows = X.table(spark, d, "orders").groupBy(F.date_add(day, 4 - F.weekday(day)).alias("date"), "o_orderpriority", "o_orderstatus").agg(F.sum("o_totalprice").alias("total"))
    return rows.select("date", F.lit("Orders").alias("category"), F.lit("1.0").alias("row_no"), F.col("o_orderpriority").alias("item"), F.col("o_orderstatus").alias("variable"), F.translate(F.format_number("total", 2), ",.", ".,").alias("value_raw"), F.lit(None).cast("double").alias("value"), F.lit("w.csv").alias("source_file"))


@query(
    f"""WITH b AS (SELECT CAST(CAST(o_orderdate AS DATE) + CAST(5 - isodow(CAST(o_orderdate AS DATE)) AS INTEGER) AS DATE) AS date, {_PRIORITY} AS item, o_orderstatus, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2, 3)
 SELECT 'WEEKLY:orders:r1:' || item AS series_id, date, date - 4 AS period_start, '{{"para_cinsi":"' || o_orderstatus || '"}}' AS dims, round(v, 2) AS value, 'W' AS freq, 'usd' AS unit FROM b"""
)
def silver_weekly(spark, d):
    out = lakehouse.weekly_silver(_weekly(spark, d), "WEEKLY", "usd")
    return rounded(out.select("series_id", "date", "period_start", "dims", "value", "freq", "unit"), 2)


def _monthly(spark, d):
    """A monthly bulletin with header rows, roots and lettered items that accumulate within the year."""
    from pyspark.sql import Window as W

    o = X.table(spark, d, "orders").withColumn("m", F.last_day(F.to_date("o_orderdate"))).groupBy("m", "o_orderstatus").agg(F.sum("o_totalprice").alias("v"))
    run = F.sum("v").over(W.partitionBy("o_orderstatus", F.year("m")).orderBy("m"))
    rank = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    item = F.when(F.col("o_orderstatus") == "F", "Total").otherwise(F.concat(F.lit("a) "), "o_orderstatus"))
    rows = o.select(F.year("m").alias("year"), F.month("m").alias("month"), F.lit("Income").alias("category"), rank.alias("row_index"), item.alias("item"), F.lit("TL").alias("variable"), F.lit(None).cast("string").alias("value_raw"), run.alias("value"), F.lit("m.csv").alias("source_file"))
    head = o.select("m").distinct().select(F.year("m").alias("year"), F.month("m").alias("month"), F.lit("Income").alias("category"), F.lit(0).alias("row_index"), F.lit("header").alias("item"), F.lit("Dönem: (milyon TL)").alias("variable"), F.lit(None).cast("string").alias("value_raw"), F.lit(None).cast("double").alias("value"), F.lit("m.csv").alias("source_file"))
    return head.unionByName(rows)


_MONTHLY = """m AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS date, o_orderstatus AS s, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2),
 o AS (SELECT 'MONTHLY:income:' || CASE s WHEN 'F' THEN 'total' ELSE 'total:a_' || lower(s) END AS series_id, date, sum(v) OVER (PARTITION BY s, year(date) ORDER BY date) AS value, s FROM m),
 kept AS (SELECT o.* FROM o WHERE s = 'F' OR EXISTS (SELECT 1 FROM o r WHERE r.s = 'F' AND r.date = o.date))"""


def _with_roots(spark, d):
    """The bulletins of months that have a root."""
    rows = _monthly(spark, d)
    roots = rows.where("item = 'Total'").select("year", "month").distinct()
    return rows.join(roots, ["year", "month"], "left_semi")


@query(f"WITH {_MONTHLY} SELECT series_id, date, round(value, 2) AS value, 'milyon_tl' AS unit FROM kept UNION ALL SELECT series_id || '_periodic', date, round(CASE WHEN row_number() OVER w = 1 THEN value ELSE value - lag(value) OVER w END, 2), 'milyon_tl' FROM kept WHERE s = 'F' WINDOW w AS (PARTITION BY series_id, year(date) ORDER BY date)")
def silver_monthly(spark, d):
    out = lakehouse.monthly_silver(_with_roots(spark, d), "MONTHLY", {})
    ytd = spark.createDataFrame([("MONTHLY:income:total", "ytd")], "series_id string, accumulation string")
    return rounded(change.with_periodic(out, ytd).select("series_id", "date", "value", "unit"), 2)


@query(
    """WITH g AS (SELECT n_regionkey, n_nationkey, n_name, sum(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)
 SELECT 'GRID:t1:balance' AS series_id, DATE '2024-03-31' AS date, DATE '2024-01-01' AS period_start, round(v, 2) AS value, 'usd' AS unit,
 CASE n_nationkey % 3 WHEN 0 THEN '{"geo_level":"province","group":"' || n_name || '","plate_code":"06","province":"Ankara"}' WHEN 1 THEN '{"geo_level":"international","group":"' || n_name || '","province":"Yurt Dışı"}' ELSE '{"geo_level":"province","group":"' || n_name || '","plate_code":"34","province":"İstanbul"}' END AS dims FROM g"""
)
def silver_regional(spark, d):
    c = X.table(spark, d, "customer").join(X.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey", "n_name").agg(F.sum("c_acctbal").alias("value"))
    city = F.when(F.col("n_nationkey") % 3 == 0, "ANKARA").when(F.col("n_nationkey") % 3 == 1, lakehouse.ABROAD).otherwise("İSTANBUL")
    cells = c.select(F.lit(2024).alias("year"), F.lit(3).alias("month"), F.lit(1).alias("table_no"), city.alias("sehir"), F.col("n_name").alias("grup"), F.lit("Balance").alias("metric"), "value", F.lit("g.json").alias("source_file"))
    units = spark.createDataFrame([(1, None, "usd")], "table_no int, metric string, unit string")
    out = lakehouse.geo_dims(lakehouse.regional_silver(cells, "GRID", units), lakehouse.provinces(spark))
    return rounded(out.select("series_id", "date", "period_start", "value", "unit", "dims"), 2)


def _layers(spark, d):
    """Canonical facts and series of the derived tables."""
    rows = X.flow_d(spark, d).unionByName(X.price_d(spark, d)).unionByName(X.geo_rows(spark, d)).unionByName(X.flow_m(spark, d))
    rows = written(rows, "source_silver")
    facts = rows.withColumns({"period_start": F.col("date"), "period_end": F.col("date"), "source_file": F.lit("orders")})
    meta = X.metadata(spark).join(rows.select("series_id", "source").distinct(), "series_id")
    return lakehouse.canonical([facts], [meta])


@query(
    X.sql(
        "WITH al AS (SELECT series_id, dims, last_day(date) AS date, sum(value) AS value FROM flow_d GROUP BY 1, 2, 3 UNION ALL SELECT series_id, dims, last_day(date), avg(value) FROM price_d GROUP BY 1, 2, 3"
        " UNION ALL SELECT series_id, dims, date, value FROM geo_rows WHERE series_id = 'GEO:good' UNION ALL SELECT series_id, dims, date, value FROM flow_m) " + _CHANGE.format(view="al", m1=_MDIFF.format(n=1), m12=_MDIFF.format(n=12)),
        "flow_d", "price_d", "geo_rows", "flow_m",
    )
)
def gold_periodic_change(spark, d):
    """Canonical to aligned to gold in one go."""
    facts, meta = _layers(spark, d)
    aligned, subset, _ = align.build(facts, meta)
    out = gold.periodic_change(aligned, subset).select("series_id", "dims", "date", "value", "mom_abs", "mom_pct", "yoy_abs", "yoy_pct")
    return rounded(out, 2, mom_pct=6, yoy_pct=6)


@query(X.sql("SELECT source, 'D' AS source_freq, 'sum' AS alignment_method, count(*) AS n_rows, 1::BIGINT AS n_series FROM (SELECT DISTINCT source, dims, last_day(date) FROM flow_d) GROUP BY 1 UNION ALL SELECT source, 'D', 'mean', count(*), 1 FROM (SELECT DISTINCT source, dims, last_day(date) FROM price_d) GROUP BY 1 UNION ALL SELECT source, 'Q', 'quarter_end_sparse', count(*), 1 FROM geo_rows WHERE series_id = 'GEO:good' GROUP BY 1 UNION ALL SELECT source, 'M', 'native', count(*), 1 FROM flow_m GROUP BY 1", "flow_d", "price_d", "geo_rows", "flow_m"))
def aligned_audit(spark, d):
    return align.build(*_layers(spark, d))[2]


@query("SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN '{\"currency\":\"USD\"}' WHEN 'SMALL' THEN '{\"commodity\":\"silver\",\"commodity_group\":\"precious_metals\"}' ELSE '{\"indicator\":\"sales_volume\",\"market\":\"housing\",\"plate_code\":\"06\",\"province\":\"Ankara\",\"sales_type\":\"mortgaged\"}' END AS dims FROM part")
def code_dimensions(spark, d):
    code = F.when(F.col("p_type") == "ECONOMY", "TP.DK.USD.A").when(F.col("p_type") == "SMALL", "TP.GUMUS.1").otherwise("TP.AKONUTSAT2.510")
    return X.table(spark, d, "part").select("p_partkey", lakehouse.code_dims(code).alias("dims"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'flow' WHEN o_orderpriority = '1-URGENT' THEN 'rate' ELSE 'stock' END AS nature, CASE WHEN o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT' THEN 'mean' END AS alignment_override FROM orders")
def nature_rules(spark, d):
    rules = spark.createDataFrame(
        [(1, "ORDERS", "F", None, None, None, "flow", None), (2, "ORDERS", None, None, "1-URGENT", None, "rate", "mean"), (3, "ORDERS", None, None, None, None, "stock", None)],
        "priority int, source string, category string, series_id string, id_suffix string, accumulates boolean, nature string, override string",
    )
    s = X.table(spark, d, "orders").select("o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit(":"), "o_orderpriority").alias("series_id"), F.lit("ORDERS").alias("source"), F.col("o_orderstatus").alias("category"), F.lit("none").alias("accumulation"))
    return NA.classified(s, rules).select("o_orderkey", "nature", "alignment_override")


@query(X.sql("SELECT 'orders_monthly' AS table_name, 'silver' AS layer, count(*) AS n_rows FROM flow_m UNION ALL SELECT 'geo', 'gold', count(*) FROM (SELECT DISTINCT date, dims FROM geo_rows)", "flow_m", "geo_rows"))
def catalog_views(spark, d):
    tables = {"orders_monthly": X.flow_m(spark, d), "geo": gold.geo_quality(X.geo_rows(spark, d), {"province": "province"}, "GEO:good", "GEO:bad")}
    views = catalog.register(spark, tables, "lake")
    listed = catalog.catalog_table(spark, [catalog.Entry("orders_monthly", "silver", None, "monthly revenue"), catalog.Entry("geo", "gold", None, "credit quality")])
    counts = None
    for view, name in zip(views, tables):
        one = spark.table(view).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        counts = one if counts is None else counts.unionByName(one)
    return listed.join(counts, F.col("table_name") == F.col("name")).select("table_name", "layer", "n_rows")


@query()
def embedded_catalog(spark, d):
    obs = X.flow_m(spark, d).unionByName(X.price_d(spark, d))
    meta = X.metadata(spark).join(obs.select("series_id").distinct(), "series_id", "left_semi").withColumns({"name": F.col("series_id"), "category": F.lit("orders"), "unit": F.lit("usd"), "freq": F.lit("M")})
    out = lakehouse.embed_catalog(meta, obs)
    return out.select("series_id", "semantic_text", F.transform("embedding", lambda x: F.round(x, 5)).alias("embedding"), S.cosine(F.col("embedding"), F.col("embedding")).alias("norm"))


@query(X.sql("SELECT dims, count(*) AS n FROM flow_m WHERE json_extract_string(dims, '$.region') <> 'ASIA' GROUP BY 1", "flow_m"))
def loaded_series(spark, d):
    """A series replaced in all layers, which then holds what was loaded."""
    rows = X.flow_m(spark, d).withColumns({"period_start": F.col("date"), "period_end": F.col("date"), "source_file": F.lit("x")})
    meta = X.metadata(spark).where("series_id = 'ORDERS:revenue_m'")
    layers = {"facts": rows, "series": X.metadata(spark), "aligned": align.monthly(rows, meta)}
    out, _ = lakehouse.load_series(rows.where(D.get(F.col("dims"), "region") != "ASIA"), meta, layers)
    return out["aligned"].groupBy("dims").agg(F.count("*").alias("n"))


@query("SELECT c_custkey::VARCHAR AS series_id, c_mktsegment AS group_code, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'D' END AS freq, CASE WHEN c_custkey % 2 = 0 THEN 'tl' ELSE 'usd' END AS unit, CASE WHEN c_custkey % 2 = 0 THEN ['a', 'b'] ELSE [] END AS tags FROM customer")
def metadata_sync(spark, d):
    c = X.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("series_id"), F.col("c_mktsegment").alias("group_code"), F.col("c_name").alias("name"))
    groups = c.select("group_code").distinct().select("group_code", F.lit("g").alias("group_name"), F.lit("D").alias("freq"), F.lit("usd").alias("unit"))
    own = c.where("cast(series_id AS long) % 2 = 0").select("series_id", F.lit(None).cast("string").alias("name"), F.lit("M").alias("freq"), F.lit("tl").alias("unit"), F.lit("a, ,b").alias("tags"))
    return readers.synced_metadata(c, groups, own)


@query(X.sql("SELECT series_id, count(*) AS n_obs, min(date) AS first_date, round(arg_min(value, date), 2) AS first_value, max(date) AS last_date, round(arg_max(value, date), 2) AS last_value FROM (SELECT series_id || dims AS series_id, date, value FROM gap_m) GROUP BY 1", "gap_m"))
def series_summary(spark, d):
    return rounded(health.series_summary(X.gap_m(spark, d).withColumn("series_id", F.concat("series_id", "dims"))), 2)


@query("SELECT 'o_totalprice' AS column_name, count(o_totalprice)::DOUBLE AS n, round(min(o_totalprice), 2) AS min, round(max(o_totalprice), 2) AS max, round(avg(o_totalprice), 2) AS mean FROM orders UNION ALL SELECT 'o_custkey', count(o_custkey)::DOUBLE, min(o_custkey)::DOUBLE, max(o_custkey)::DOUBLE, round(avg(o_custkey), 2) FROM orders")
def numeric_summary(spark, d):
    return rounded(health.numeric_summary(X.table(spark, d, "orders"), ["o_totalprice", "o_custkey"]), 2)


@query(X.sql("WITH g AS (SELECT json_extract_string(dims, '$.province') AS province, max(CASE WHEN series_id = 'GEO:bad' THEN value END) / (max(CASE WHEN series_id = 'GEO:good' THEN value END) + max(CASE WHEN series_id = 'GEO:bad' THEN value END)) AS r FROM geo_rows WHERE date = DATE '2000-12-31' GROUP BY 1) (SELECT 'worst' AS kind, province, round(r, 6) AS bad_ratio FROM g ORDER BY r DESC LIMIT 1) UNION ALL (SELECT 'best', province, round(r, 6) FROM g ORDER BY r LIMIT 1)", "geo_rows"))
def geo_extremes(spark, d):
    g = gold.geo_quality(X.geo_rows(spark, d), {"province": "province"}, "GEO:good", "GEO:bad").where("date = date'2000-12-31'")
    pick = lambda kind, order: g.orderBy(order).limit(1).select(F.lit(kind).alias("kind"), "province", "bad_ratio")
    return rounded(pick("worst", F.desc("bad_ratio")).unionByName(pick("best", F.asc("bad_ratio"))), 6)


@query("SELECT p_partkey, p_brand || ':' || p_size AS code, 'Size ' || p_size AS name, p_brand AS category, replace(p_brand, '#', '#') || ' - Size ' || p_size || ' (period value)' AS description FROM (SELECT p_partkey, p_brand, p_size FROM part)")
def id_metadata(spark, d):
    p = X.table(spark, d, "part")
    made = lakehouse.id_metadata(F.concat_ws(":", F.lit("PART"), "p_brand", F.concat(F.lit("size_"), F.col("p_size").cast("string"), F.lit("_periodic"))))
    out = p.select("p_partkey", "p_brand", "p_size", *[c.alias(n) for n, c in made.items()])
    return out.select("p_partkey", F.concat_ws(":", "p_brand", "p_size").alias("code"), "name", "category", "description")


@query(
    X.sql(
        """SELECT k.column_name, k.comment, k.unit, CASE k.column_name WHEN 'series_id' THEN (SELECT count(series_id) FROM flow_m) WHEN 'value' THEN (SELECT count(value) FROM flow_m) ELSE (SELECT count(dims) FROM flow_m) END AS n_values
 FROM (VALUES ('series_id', 'the series', NULL), ('value', 'monthly revenue', 'usd'), ('dims', NULL, 'json')) AS k(column_name, comment, unit)""",
        "flow_m",
    )
)
def column_comments(spark, d):
    """Comments and units of a written table's columns, as its readers find them, and how many values stand under each."""
    rows = catalog.described(X.flow_m(spark, d), {"series_id": "the series", "value": "monthly revenue"}, {"value": "usd", "dims": "json"})
    read = spark.read.parquet(sinks.write_table(rows, folder(spark, "described")))
    told = [(f.name, f.metadata.get("comment"), f.metadata.get("unit")) for f in read.schema if f.metadata]
    counts = read.agg(*[F.count(c).alias(c) for c, _, _ in told]).unpivot([], [c for c, _, _ in told], "name", "n_values")
    listed = spark.createDataFrame(told, "column_name string, comment string, unit string")
    return listed.join(counts, F.col("column_name") == F.col("name")).drop("name")
