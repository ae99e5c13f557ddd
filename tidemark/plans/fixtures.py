"""Series derived from the order tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims as D
from ..sources.scratch import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _placed_orders(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    out = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return out.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("day", F.to_date("o_orderdate"))


def daily_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders summed by day, nation and segment, written: what series of several frequencies and dims are added up from."""
    rows = _placed_orders(spark, d).groupBy("day", "r_name", "n_name", "c_mktsegment").agg(F.sum("o_totalprice").alias("o_totalprice"))
    return written(rows, "daily_orders")


def _series(rows: DataFrame, series_id: str, source: str, date: Column, value: Column, freq: str, unit: str, **dims: str) -> DataFrame:
    out = rows.groupBy(date.alias("date"), *dims.values()).agg(value.alias("value"))
    return out.select(F.lit(series_id).alias("series_id"), F.lit(source).alias("source"), "date", "value", F.lit(freq).alias("freq"), F.lit(unit).alias("unit"), D.build(**{k: F.col(c) for k, c in dims.items()}).alias("dims"))


def flow_d(spark, d, orders=None):
    """Daily revenue by region; ``orders``: ``daily_orders``, if there are any."""
    return _series(_placed_orders(spark, d) if orders is None else orders, "ORDERS:revenue", "ORDERS", F.col("day"), F.sum("o_totalprice"), "D", "usd", region="r_name")


def price_d(spark, d):
    """Daily mean unit price by return flag."""
    rows = table(spark, d, "lineitem")
    return _series(rows, "LINEITEM:unit_price", "LINEITEM", F.to_date("l_shipdate"), F.avg(F.col("l_extendedprice") / F.col("l_quantity")), "D", "usd", flag="l_returnflag")


def flow_m(spark, d, orders=None):
    """Monthly revenue by region."""
    return _series(_placed_orders(spark, d) if orders is None else orders, "ORDERS:revenue_m", "ORDERS", F.last_day("day"), F.sum("o_totalprice"), "M", "usd", region="r_name")


def gap_m(spark, d, orders=None):
    """Monthly revenue by nation and segment, with gaps."""
    return _series(_placed_orders(spark, d) if orders is None else orders, "ORDERS:sparse_m", "ORDERS", F.last_day("day"), F.sum("o_totalprice"), "M", "usd", nation="n_name", segment="c_mktsegment")


def year_y(spark, d):
    """Yearly revenue by region."""
    return _series(_placed_orders(spark, d), "ORDERS:revenue_y", "ORDERS", F.make_date(F.year("day"), F.lit(12), F.lit(31)), F.sum("o_totalprice"), "Y", "usd", region="r_name")


def stock_w(spark, d):
    """Weekly shipped quantity by return flag, on Fridays."""
    day = F.to_date("l_shipdate")
    return _series(table(spark, d, "lineitem"), "LINEITEM:quantity_w", "LINEITEM", F.date_add(day, 4 - F.weekday(day)), F.sum("l_quantity"), "W", "pieces", flag="l_returnflag")


def ytd_m(spark, d):
    """Monthly revenue since the start of the year by order priority."""
    from pyspark.sql import Window as W

    rows = table(spark, d, "orders").groupBy(F.last_day(F.to_date("o_orderdate")).alias("date"), "o_orderpriority").agg(F.sum("o_totalprice").alias("v"))
    run = F.sum("v").over(W.partitionBy("o_orderpriority", F.year("date")).orderBy("date"))
    return rows.select(F.lit("ORDERS:ytd").alias("series_id"), F.lit("ORDERS").alias("source"), "date", run.alias("value"), F.lit("M").alias("freq"), F.lit("usd").alias("unit"), D.build(priority=F.col("o_orderpriority")).alias("dims"))


def geo_rows(spark, d):
    """Quarterly good and bad value by province, as two series."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    q = F.last_day(F.add_months(F.trunc(F.to_date("l_shipdate"), "QUARTER"), 2))
    good = _series(rows.where("l_returnflag <> 'R'"), "GEO:good", "GEO", q, F.sum("l_extendedprice"), "Q", "usd", province="r_name")
    return good.unionByName(_series(rows.where("l_returnflag = 'R'"), "GEO:bad", "GEO", q, F.sum("l_extendedprice"), "Q", "usd", province="r_name"))


def metadata(spark) -> DataFrame:
    """What the derived series measure."""
    rows = [
        ("ORDERS:revenue", "flow", "none", True), ("LINEITEM:unit_price", "price", "none", True), ("ORDERS:revenue_m", "flow", "none", True), ("ORDERS:sparse_m", "flow", "none", True),
        ("ORDERS:revenue_y", "flow", "none", False), ("LINEITEM:quantity_w", "stock", "none", True), ("ORDERS:ytd", "flow", "ytd", True), ("GEO:good", "flow", "none", True), ("GEO:bad", "flow", "none", False),
    ]
    df = spark.createDataFrame(rows, "series_id string, nature string, accumulation string, nature_reviewed boolean")
    return df.withColumns({"alignment_override": F.lit(None).cast("string"), "is_cumulative": F.col("accumulation") != "none"})


_ORDERS = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_DAY = "CAST(o_orderdate AS DATE)"
_SHIP = "CAST(l_shipdate AS DATE)"
_GEO = "lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_QUARTER = f"last_day(CAST(date_trunc('quarter', {_SHIP}) AS DATE) + INTERVAL 2 MONTH)"


def _sql(series_id, source, date, value, freq, unit, dims, rows, where=""):
    keys = ", ".join([date, *[c for _, c in dims]])
    text = " || ',' || ".join(f"'\"{k}\":\"' || {c} || '\"'" for k, c in dims)
    return f"SELECT '{series_id}' AS series_id, '{source}' AS source, {date} AS date, {value} AS value, '{freq}' AS freq, '{unit}' AS unit, '{{' || {text} || '}}' AS dims FROM {rows} {where} GROUP BY {keys}"


SQL = {
    "flow_d": _sql("ORDERS:revenue", "ORDERS", _DAY, "SUM(o_totalprice)", "D", "usd", [("region", "r_name")], _ORDERS),
    "price_d": _sql("LINEITEM:unit_price", "LINEITEM", _SHIP, "AVG(l_extendedprice / l_quantity)", "D", "usd", [("flag", "l_returnflag")], "lineitem"),
    "flow_m": _sql("ORDERS:revenue_m", "ORDERS", f"last_day({_DAY})", "SUM(o_totalprice)", "M", "usd", [("region", "r_name")], _ORDERS),
    "gap_m": _sql("ORDERS:sparse_m", "ORDERS", f"last_day({_DAY})", "SUM(o_totalprice)", "M", "usd", [("nation", "n_name"), ("segment", "c_mktsegment")], _ORDERS),
    "year_y": _sql("ORDERS:revenue_y", "ORDERS", f"make_date(year({_DAY}), 12, 31)", "SUM(o_totalprice)", "Y", "usd", [("region", "r_name")], _ORDERS),
    "stock_w": _sql("LINEITEM:quantity_w", "LINEITEM", f"CAST({_SHIP} + CAST(5 - isodow({_SHIP}) AS INTEGER) AS DATE)", "SUM(l_quantity)", "W", "pieces", [("flag", "l_returnflag")], "lineitem"),
    "ytd_m": """SELECT 'ORDERS:ytd' AS series_id, 'ORDERS' AS source, date, SUM(v) OVER (PARTITION BY o_orderpriority, year(date) ORDER BY date) AS value, 'M' AS freq, 'usd' AS unit,
 '{"priority":"' || o_orderpriority || '"}' AS dims FROM (SELECT last_day(CAST(o_orderdate AS DATE)) AS date, o_orderpriority, SUM(o_totalprice) AS v FROM orders GROUP BY 1, 2) AS m""",
    "geo_rows": _sql("GEO:good", "GEO", _QUARTER, "SUM(l_extendedprice)", "Q", "usd", [("province", "r_name")], _GEO, "WHERE l_returnflag <> 'R'")
    + " UNION ALL "
    + _sql("GEO:bad", "GEO", _QUARTER, "SUM(l_extendedprice)", "Q", "usd", [("province", "r_name")], _GEO, "WHERE l_returnflag = 'R'"),
}


def sql(body: str, *views: str) -> str:
    """``body`` with the derived series that it names as common table expressions."""
    heads = ", ".join(f"{v} AS ({SQL[v]})" for v in views)
    rest = body.strip()
    return f"WITH {heads}, {rest[5:]}" if rest[:5].upper() == "WITH " else f"WITH {heads} {rest}"
