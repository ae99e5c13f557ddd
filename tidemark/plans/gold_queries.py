"""Queries over rules and registries of series, the gold graph, and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, registry as R
from ..functions import dims as D
from ..functions import nature as NA
from ..operators import align, gold_graph, health, lakehouse, lineage, lookup
from ..sources.publication import Log
from ..sources.scratch import folder, written
from . import fixtures as X
from .registry import query
from .series_queries import _EXPECT, rounded

_CATEGORIES = [*R.PRICE_CATEGORIES, *R.RATE_CATEGORIES, *R.FLOW_CATEGORIES, *R.STOCK_CATEGORIES, *R.INDEX_CATEGORIES, "unknown_category"]
_KINDS = [(R.PRICE_CATEGORIES, "price"), (R.RATE_CATEGORIES, "rate"), (R.FLOW_CATEGORIES, "flow"), (R.STOCK_CATEGORIES, "stock"), (R.INDEX_CATEGORIES, "index")]
_BANK = ["kar_zarar", "rasyolar", "yurt_disi_sube_rasyolari", "bilanco"]


def _in(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_SERIES_OF = f"""x AS (SELECT o_orderkey, o_orderkey % 4 AS k, o_orderkey % {len(_CATEGORIES)} AS c, ([{', '.join(f"'{w}'" for w in _CATEGORIES)}])[CAST(o_orderkey % {len(_CATEGORIES)} AS INTEGER) + 1] AS central,
 (['kar_zarar', 'rasyolar', 'yurt_disi_sube_rasyolari', 'bilanco'])[CAST(o_custkey % 4 AS INTEGER) + 1] AS bank, CASE WHEN o_orderstatus = 'F' THEN 'ytd' ELSE 'none' END AS acc, o_orderpriority LIKE '1%' AS periodic, o_custkey % 50 AS h FROM orders)"""


@query(
    f"""WITH {_SERIES_OF} SELECT o_orderkey, CASE k WHEN 0 THEN CASE WHEN h = 0 THEN 'stock' WHEN h = 1 THEN 'rate'
  {' '.join(f"WHEN central IN {_in(words)} THEN '{'stock' if kind == 'index' else kind}'" for words, kind in _KINDS)} ELSE 'unclassified' END
 WHEN 1 THEN CASE WHEN acc <> 'none' THEN 'stock' WHEN periodic THEN 'flow' WHEN bank = 'kar_zarar' THEN 'flow' WHEN bank = 'bilanco' THEN 'stock' ELSE 'rate' END
 WHEN 2 THEN CASE WHEN h % 8 = 5 THEN 'rate' ELSE 'stock' END ELSE CASE WHEN h < 25 THEN 'stock' ELSE 'unclassified' END END AS nature,
 CASE WHEN k = 0 AND (h = 0 OR h > 1 AND central IN {_in(R.INDEX_CATEGORIES)}) THEN 'mean' END AS alignment_override FROM x"""
)
def nature_index(spark, d):
    """The shipped rules over series of all known sources: exact ids, accumulation, suffixes, categories and defaults."""
    o = X.table(spark, d, "orders")
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (n % len(words) + 1).cast("int"))
    key, h = F.col("o_orderkey"), F.col("o_custkey") % 50
    k = key % 4
    source = F.when(k == 0, R.CENTRAL).when(k == 1, R.MONTHLY).when(k == 2, R.REGIONAL).otherwise(F.when(h < 25, R.WEEKLY).otherwise("OTHER"))
    category = F.when(k == 0, pick(_CATEGORIES, key)).when(k == 1, pick(_BANK, F.col("o_custkey"))).when(k == 2, F.concat(F.lit("t"), (h % 8).cast("string"))).otherwise("any")
    tail = F.when((k == 0) & (h == 0), "TP.APIFON1.IHA").when((k == 0) & (h == 1), "TP.APIFON4").otherwise(F.concat(key.cast("string"), F.when(F.col("o_orderpriority").startswith("1"), "_periodic").otherwise("")))
    s = o.select("o_orderkey", source.alias("source"), category.alias("category"), F.concat(source, F.lit(":"), tail).alias("series_id"), F.when(F.col("o_orderstatus") == "F", "ytd").otherwise("none").alias("accumulation"))
    return NA.classified(s, R.nature_rules(spark)).select("o_orderkey", "nature", "alignment_override")


@query(
    f"""WITH r AS (SELECT unnest([{', '.join(f"'{i}'" for i in R.YTD_ITEMS)}]) AS item, unnest(range({len(R.YTD_ITEMS)})) AS i),
 s AS (SELECT o_orderkey, o_orderkey % {len(R.YTD_ITEMS)} AS i, o_orderpriority LIKE '1%' AS other FROM orders)
 SELECT o_orderkey, 'BDDK_MONTHLY:kar_zarar:' || item || CASE WHEN other THEN '_x' ELSE '' END AS series_id, CASE WHEN other THEN 'none' ELSE 'ytd' END AS accumulation, NOT other AS is_cumulative FROM s JOIN r USING (i)"""
)
def accumulation_of_series(spark, d):
    """The reviewed registry over all series: what is not in it does not accumulate."""
    items = F.array(*[F.lit(i) for i in R.YTD_ITEMS])
    item = F.element_at(items, (F.col("o_orderkey") % len(R.YTD_ITEMS) + 1).cast("int"))
    s = X.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit(f"{R.MONTHLY}:kar_zarar:"), item, F.when(F.col("o_orderpriority").startswith("1"), "_x").otherwise("")).alias("series_id"))
    return NA.with_accumulation(s, R.accumulation_registry(spark))


@query(
    X.sql(
        """WITH r AS (SELECT series_id, value FROM flow_d UNION ALL SELECT series_id, value FROM price_d UNION ALL SELECT series_id || '_new', value FROM geo_rows)
 SELECT series_id, CASE series_id WHEN 'ORDERS:revenue' THEN 'flow' WHEN 'LINEITEM:unit_price' THEN 'price' ELSE 'unclassified' END AS nature, count(*) AS n, round(sum(value), 2) AS total FROM r GROUP BY 1""",
        "flow_d", "price_d", "geo_rows",
    )
)
def attribute_default(spark, d):
    """Observations with the nature that the metadata gives their series, unclassified where it knows none."""
    rows = X.flow_d(spark, d).unionByName(X.price_d(spark, d)).unionByName(X.geo_rows(spark, d).withColumn("series_id", F.concat("series_id", F.lit("_new"))))
    out = lookup.with_attribute(rows, X.metadata(spark).unionByName(X.metadata(spark)), "nature", "unclassified")
    return rounded(out.groupBy("series_id", "nature").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 2)


_PLACES = {**codes.SALES_PLACES, "999": None}
_SALES = list(codes.SALES_TYPES.values())


def _dims_sql(pairs):
    return "'{' || concat_ws(',', " + ", ".join(f"CASE WHEN ({value}) IS NOT NULL THEN '\"{key}\":\"' || ({value}) || '\"' END" for key, value in sorted(pairs.items())) + ") || '}'"


def _of(n, values):
    return f"([{', '.join('NULL' if v is None else chr(39) + v + chr(39) for v in values)}])[CAST(n % {len(values)} AS INTEGER) + 1]"


_REGION = [*codes.REGIONS, "XX"]
_CODES = {
    "index": ("'TP.KFE.' || " + _of("n", _REGION), {"geo_level": _of("n", [*[v[0] for v in codes.REGIONS.values()], None]), "region_code": _of("n", [*codes.REGIONS, None]), "region_name": _of("n", [*[v[1] for v in codes.REGIONS.values()], None]), "market": f"CASE WHEN n % {len(_REGION)} < {len(codes.REGIONS)} THEN 'housing' END", "indicator": f"CASE WHEN n % {len(_REGION)} < {len(codes.REGIONS)} THEN 'price_index' END"}),
    "sales": ("'TP.AKONUTSAT' || (n % 4 + 1) || '.K' || " + _of("n", list(_PLACES)), {"market": "'housing'", "indicator": "'sales_volume'", "sales_type": f"([{', '.join(chr(39) + s + chr(39) for s in _SALES)}])[CAST(n % 4 AS INTEGER) + 1]", "province": _of("n", [v and v[0] for v in _PLACES.values()]), "plate_code": _of("n", [v and v[1] for v in _PLACES.values()])}),
    "rent": ("'TP.BK.' || " + _of("n", ["ISTANBUL", "ANKARA", "IZMIR", "TR", "X"]), {"market": "'housing'", "indicator": "'rent'", "province": _of("n", ["İstanbul", "Ankara", "İzmir", "Türkiye", None]), "plate_code": _of("n", ["34", "06", "35", None, None])}),
    "money": ("'TP.DK.' || " + _of("n", ["USD", "EURTRY", "JPYTL", "CHF", "GBP", "ALTIN", "GUMUS.USD", "NONE"]), {"currency": _of("n", ["USD", "EUR", "TRY", "CHF", "GBP", None, "USD", None]), "commodity_group": _of("n", [None] * 5 + ["precious_metals"] * 2 + [None]), "commodity": _of("n", [None] * 5 + ["gold", "silver", None])}),
}


@query(
    "WITH c AS (SELECT p_partkey, p_partkey // 4 AS n, p_partkey % 4 AS k FROM part)"
    + " UNION ALL ".join(f" SELECT p_partkey, {code} AS code, {_dims_sql(dims)} AS dims FROM c WHERE k = {k}" for k, (code, dims) in enumerate(_CODES.values()))
)
def code_tree(spark, d):
    """Dims of price index, sales, rent and money codes, known places and unknown ones."""
    p = X.table(spark, d, "part").select("p_partkey", F.floor(F.col("p_partkey") / 4).alias("n"), (F.col("p_partkey") % 4).alias("k"))
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("n") % len(values) + 1).cast("int"))
    code = (
        F.when(F.col("k") == 0, F.concat(F.lit("TP.KFE."), of(_REGION)))
        .when(F.col("k") == 1, F.concat(F.lit("TP.AKONUTSAT"), (F.col("n") % 4 + 1).cast("string"), F.lit(".K"), of(list(_PLACES))))
        .when(F.col("k") == 2, F.concat(F.lit("TP.BK."), of(["ISTANBUL", "ANKARA", "IZMIR", "TR", "X"])))
        .otherwise(F.concat(F.lit("TP.DK."), of(["USD", "EURTRY", "JPYTL", "CHF", "GBP", "ALTIN", "GUMUS.USD", "NONE"])))
    )
    return p.withColumn("code", code).select("p_partkey", "code", codes.code_dims(F.col("code")).alias("dims"))


# ------------------------------------------------------------------ the gold set

_H = gold_graph.WIDE_TABLES["gold_housing_credit_market"]
_LOANS = _H["konut_kredisi_hacmi_tp"].series_id
_BY_STATUS = {"F": "TP", "O": "YP", "P": "Toplam"}
_BY_FLAG = {"A": "EVDS:TP.KTF12", "N": "EVDS:TP.KFE.TR", "R": "EVDS:TP.AKONUTSAT1.KTRTOPLAM"}
_BY_PRIORITY = {"1": ("BDDK_MONTHLY:krediler:toplam_krediler", "Toplam"), "2": ("EVDS:TP.KREHACBS.A1", None), "3": ("EVDS:TP.KTF17", None), "4": ("BDDK_MONTHLY:bilanco:mevduat_katilim_fonu", "TP"), "5": ("EVDS:TP.TRY.MT06", None)}
_METAL_FLAG = {"A": gold_graph.METALS[0], "R": gold_graph.METALS[1]}


def _map(values):
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _lake(spark, d, buckets=64):
    """A published lakehouse that holds the series of the shipped gold set, made of orders and items."""
    o, i = X.table(spark, d, "orders"), X.table(spark, d, "lineitem")
    row = lambda rows, sid, value, freq, dims: rows.select(sid.alias("series_id"), F.element_at(F.split(sid, ":"), 1).alias("source"), "date", value.alias("value"), F.lit(freq).alias("freq"), F.lit("usd").alias("unit"), dims.alias("dims"))
    month = lambda df, c: df.withColumn("date", F.last_day(F.to_date(c)))
    status = month(o, "o_orderdate").groupBy("date", "o_orderstatus").agg(F.sum("o_totalprice").alias("v"))
    flags = month(i, "l_shipdate").groupBy("date", "l_returnflag").agg(F.avg("l_extendedprice").alias("v"))
    p = F.substring("o_orderpriority", 1, 1)
    priority = month(o, "o_orderdate").groupBy("date", p.alias("p")).agg(F.sum("o_totalprice").alias("v"))
    daily = i.withColumn("date", F.to_date("l_shipdate")).where("l_returnflag <> 'N'").groupBy("date", "l_returnflag").agg(F.avg("l_extendedprice").alias("v"))
    geo = X.geo_rows(spark, d)
    rows = [
        row(status, F.lit(_LOANS), F.col("v"), "M", D.build(variable=F.element_at(_map(_BY_STATUS), F.col("o_orderstatus")))),
        row(flags, F.element_at(_map(_BY_FLAG), F.col("l_returnflag")), F.col("v"), "M", F.lit("{}")),
        row(priority, F.element_at(_map({k: v[0] for k, v in _BY_PRIORITY.items()}), F.col("p")), F.col("v"), "M", D.build(variable=F.try_element_at(_map({k: v[1] for k, v in _BY_PRIORITY.items() if v[1]}), F.col("p")))),
        row(daily, F.element_at(_map(_METAL_FLAG), F.col("l_returnflag")), F.col("v"), "D", F.lit("{}")),
        row(geo, F.when(F.col("series_id") == "GEO:good", gold_graph.QUALITY[0]).otherwise(gold_graph.QUALITY[1]), F.col("value"), "Q", D.build(province=D.get(F.col("dims"), "province"), geo_level=F.lit("province"))),
    ]
    facts = rows[0]
    for r in rows[1:]:
        facts = facts.unionByName(r)
    facts = written(facts, "facts")
    meta = facts.select("series_id", "source").distinct().withColumns({"nature": F.lit("price"), "accumulation": F.lit("none"), "alignment_override": F.lit(None).cast("string"), "nature_reviewed": F.lit(True), "is_cumulative": F.lit(False)})
    meta = written(meta, "series")
    log = Log(spark, folder(spark, "lake"))
    none = facts.select("series_id").limit(0)
    lakehouse.create_lakehouse(log, facts, meta, align.monthly(facts, meta), none, buckets)
    return log


def _long(table, columns, rows):
    return " UNION ALL ".join(f"SELECT '{table}' AS gold_table, date, '{c}' AS gold_column, round({expr}, 4) AS value FROM {src}" for c, (expr, src) in zip(columns, rows))


_GOLD = """s AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS date, o_orderstatus AS k, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2),
 p AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS date, left(o_orderpriority, 1) AS k, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2),
 f AS (SELECT last_day(CAST(l_shipdate AS DATE)) AS date, l_returnflag AS k, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2),
 y AS (SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS k, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2),
 z AS (SELECT a.date, a.v AS g, b.v AS r FROM y a JOIN y b ON a.date = b.date AND a.k = 'A' AND b.k = 'R')"""


@query(
    f"WITH {_GOLD} "
    + " UNION ALL ".join(
        [
            _long("gold_housing_credit_market", _H, [("v", "s WHERE k = 'F'"), ("v", "s WHERE k = 'O'"), ("v", "s WHERE k = 'P'"), ("v", "f WHERE k = 'A'"), ("v", "f WHERE k = 'N'"), ("v", "f WHERE k = 'R'")]),
            _long("gold_credit_market", gold_graph.WIDE_TABLES["gold_credit_market"], [("v", f"p WHERE k = '{k}'") for k in "123"]),
            _long("gold_deposit_market", gold_graph.WIDE_TABLES["gold_deposit_market"], [("v", f"p WHERE k = '{k}'") for k in "45"]),
            _long("gold_precious_metal_ratios_daily", ["gold_usd_ons_close", "silver_usd_ons_close", "ratio"], [("g", "z"), ("r", "z"), ("g / r", "z")]),
        ]
    )
)
def shipped_gold(spark, d):
    """The shipped wide tables and metal prices, built from a published lakehouse, as (gold_table, date, gold_column, value)."""
    log = _lake(spark, d)
    gold_graph.rebuild(log, gold_graph.shipped(), 4)
    seen, out = log.latest(), None
    for table in [*gold_graph.WIDE_TABLES, "gold_precious_metal_ratios_daily"]:
        wide = seen.read(table)
        long = wide.unpivot(["date"], [c for c in wide.columns if c != "date"], "gold_column", "value").where("value is not null")
        long = long.select(F.lit(table).alias("gold_table"), "date", "gold_column", "value")
        out = long if out is None else out.unionByName(long)
    return rounded(out)


@query(
    f"""WITH {_GOLD}, c AS (SELECT 'gold_housing_credit_market' AS gold_table, (SELECT count(DISTINCT date) FROM (SELECT date FROM s UNION SELECT date FROM f)) AS n_rows
  UNION ALL SELECT 'gold_credit_market', (SELECT count(DISTINCT date) FROM p WHERE k IN ('1', '2', '3')) UNION ALL SELECT 'gold_deposit_market', (SELECT count(DISTINCT date) FROM p WHERE k IN ('4', '5'))
  UNION ALL SELECT 'gold_precious_metal_ratios_daily', (SELECT count(*) FROM z)
  UNION ALL SELECT 'gold_precious_metal_ratios_monthly', (SELECT (year(max(date)) - year(min(date))) * 12 + month(max(date)) - month(min(date)) + 1 FROM z) UNION ALL SELECT 'gold_evidence', 11)
 SELECT r.run, gold_table, n_rows FROM c JOIN (SELECT 1 AS run, gold_table AS t FROM c UNION ALL SELECT unnest([3, 3, 4, 4]), unnest(['gold_precious_metal_ratios_daily', 'gold_precious_metal_ratios_monthly', 'gold_housing_credit_market', 'gold_evidence'])) AS r ON gold_table = t"""
)
def gold_rebuilds(spark, d):
    """Which gold tables are built, and how large they are: at first, again at once, after a metal's facts changed, and after a loan series did."""
    log = _lake(spark, d)
    specs = [s for s in gold_graph.shipped() if s.name not in ("gold_periodic_change", "gold_finturk_province_credit_quality")]
    runs = [gold_graph.rebuild(log, specs, 4), gold_graph.rebuild(log, specs, 4)]
    for table, series in (("facts", gold_graph.METALS[0]), ("aligned", _LOANS)):
        with log.begin() as load:
            load.replace(table, load.read(table).where(F.col("series_id") == series).withColumn("value", F.col("value") * 2))
        runs.append(gold_graph.rebuild(log, specs, 4))
    seen, out = log.latest(), None
    for run, names in enumerate(runs, 1):
        for name in names:
            one = seen.read(name).agg(F.count("*").alias("n_rows")).select(F.lit(run).alias("run"), F.lit(name).alias("gold_table"), "n_rows")
            out = one if out is None else out.unionByName(one)
    return out


@query(
    X.sql(
        f"""WITH s AS (SELECT json_extract_string(dims, '$.nation') AS nation, json_extract_string(dims, '$.segment') AS segment, count(*) AS n_obs, min(date) AS lo, max(date) AS hi FROM gap_m GROUP BY 1, 2), x AS (SELECT *, {_EXPECT} AS expected FROM s),
 m AS (SELECT *, round(greatest(expected - n_obs, 0) * 100.0 / greatest(expected, n_obs), 2) AS missing_pct FROM x),
 h AS (SELECT nation, 'series:' || nation || ':' || segment AS source, CAST(round(greatest(0.0, least(100.0, 100 - missing_pct * 1.5 - CASE WHEN n_obs < 5 THEN 10.0 ELSE 0.0 END)), 1) AS DOUBLE) AS score FROM m),
 r AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
 e AS (SELECT 'gold:all' AS node, h.*, 4 AS steps FROM h UNION ALL SELECT 'gold:' || r_name, h.*, 3 FROM h JOIN r ON n_name = nation UNION ALL SELECT 'silver:' || nation, h.*, 2 FROM h UNION ALL SELECT 'bronze:' || source[8:], h.*, 1 FROM h)
 SELECT node, count(*) AS n_sources, 0::BIGINT AS n_unknown, max(steps) AS steps, arg_min(source, (score, source)) AS worst_source, min(score) AS health_score,
 CASE WHEN min(score) >= 90 THEN 'EXCELLENT' WHEN min(score) >= 75 THEN 'GOOD' WHEN min(score) >= 50 THEN 'FAIR' ELSE 'WARNING' END AS health_status FROM e GROUP BY 1""",
        "gap_m",
    )
)
def lineage_health(spark, d):
    """Every level's grade by its worst origin: all regions, regions, nations, and the files of their segments."""
    rows = written(X.gap_m(spark, d), "gap_m")
    nation, segment = (D.get(F.col("dims"), k) for k in ("nation", "segment"))
    named = F.concat_ws(":", nation, segment)
    leaves = health.series_health(rows.withColumn("series_id", F.concat(F.lit("series:"), named))).select(F.col("series_id").alias("source"), "health_score")
    parts = rows.select(nation.alias("nation"), named.alias("part")).distinct()
    places = X.table(spark, d, "nation").join(X.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    places = places.join(parts.select(F.col("nation").alias("n_name")).distinct(), "n_name", "left_semi")
    pair = lambda df, a, b: df.select(F.concat(*a).alias("node"), F.concat(*b).alias("source"))
    edges = pair(places, [F.lit("gold:all")], [F.lit("gold:"), "r_name"]).unionByName(pair(places, [F.lit("gold:"), "r_name"], [F.lit("silver:"), "n_name"]))
    edges = edges.unionByName(pair(parts, [F.lit("silver:"), "nation"], [F.lit("bronze:"), "part"])).unionByName(pair(parts, [F.lit("bronze:"), "part"], [F.lit("series:"), "part"]))
    return lineage.health_by_lineage(edges, leaves)
