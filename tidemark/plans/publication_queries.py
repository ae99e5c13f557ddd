"""Queries over the publication log: loads of many series, audited versions, and merges of small deltas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims as D
from ..operators import align, contracts, lakehouse
from ..schema import ContractError
from ..sources.publication import Log
from ..sources.scratch import folder, written
from . import fixtures as X
from .registry import query
from .series_queries import rounded


def _nations(spark, d):
    """Monthly revenue as one series for each nation, by segment."""
    rows = X.gap_m(spark, d)
    nation, segment = (D.get(F.col("dims"), k) for k in ("nation", "segment"))
    rows = rows.withColumns({"series_id": F.concat(F.lit("NATION:"), nation), "dims": D.build(segment=segment), "period_start": F.trunc("date", "MM"), "period_end": F.col("date"), "source_file": F.lit("orders")})
    return written(rows.select(*lakehouse.OBS), "nations")


def _described(rows, nature="flow"):
    one = rows.select("series_id").distinct()
    return one.select("series_id", F.lit(nature).alias("nature"), F.lit("none").alias("accumulation"), F.lit(True).alias("nature_reviewed"), F.lit(None).cast("string").alias("alignment_override"), F.lit(False).alias("is_cumulative"), F.col("series_id").alias("name"))


def _refused(step) -> str:
    try:
        step()
    except ContractError as e:
        return e.code
    return "published"


@query(
    X.sql(
        """WITH n AS (SELECT json_extract_string(dims, '$.nation') AS nation, count(*) AS n, sum(value) AS total FROM gap_m GROUP BY 1),
 s AS (SELECT 'NATION:' || nation AS series_id, n, total * CASE WHEN nation <= 'NATION_20' THEN 2 ELSE 1 END AS total FROM n
  UNION ALL SELECT 'LIVE:revenue', count(*), sum(value) FROM flow_m)
 SELECT 'facts' AS layer, series_id, n, round(total, 2) AS total FROM s UNION ALL SELECT 'aligned', series_id, n, round(total, 2) FROM s WHERE series_id <> 'LIVE:revenue'
 UNION ALL SELECT 'series', series_id, 1, NULL FROM s UNION ALL SELECT 'embeddings', series_id, 1, NULL FROM s""",
        "gap_m", "flow_m",
    )
)
def published_load(spark, d):
    """What readers see of a lakehouse after a load of some series, one that fails in its last table, a batch of an unclassified series, and that series live."""
    rows = _nations(spark, d)
    meta = _described(rows)
    log = Log(spark, folder(spark, "lake"))
    lakehouse.create_lakehouse(log, rows, meta, align.monthly(rows, meta), lakehouse.embed_catalog(meta, rows).select("series_id", "semantic_text", "embedding"), 8)
    some = rows.where("series_id <= 'NATION:NATION_20'")
    lakehouse.load_published(log, some.withColumn("value", F.col("value") * 2), _described(some))
    lost = ContractError("no_model", "the embedding step fails")
    assert _refused(lambda: lakehouse.load_published(log, rows.withColumn("value", F.lit(0.0)), meta, embed=lambda m, o: _raise(lost))) == "no_model"
    live = X.flow_m(spark, d).withColumns({"series_id": F.lit("LIVE:revenue"), "period_start": F.trunc("date", "MM"), "period_end": F.col("date"), "source_file": F.lit("orders")})
    open_ = _described(live, "unclassified").withColumn("nature_reviewed", F.lit(False))
    assert _refused(lambda: lakehouse.load_published(log, live, open_)) == "unclassified"
    lakehouse.load_published(log, live, open_, "live")
    seen = log.latest()
    counted = [seen.read(t).groupBy("series_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.lit(t).alias("layer"), "series_id", "n", "total") for t in ("facts", "aligned")]
    single = [seen.read(t).groupBy("series_id").agg(F.count("*").alias("n")).select(F.lit(t).alias("layer"), "series_id", "n", F.lit(None).cast("double").alias("total")) for t in ("series", "embeddings")]
    return rounded(counted[0].unionByName(counted[1]).unionByName(single[0]).unionByName(single[1]), 2, total=2)


def _raise(error):
    raise error


@query(
    X.sql(
        """WITH r AS (SELECT json_extract_string(dims, '$.region') AS region, count(*) AS n_rows, sum(value) AS total FROM flow_m GROUP BY 1)
 SELECT k.step, k.outcome, k.set_no, region, n_rows, round(total * k.times, 2) AS total FROM r,
 (VALUES (1, 'published', 1, 1), (2, 'contract_violated', 1, 1), (3, 'contract_violated', 1, 1), (4, 'published', 2, 3), (5, 'conflict', 2, 3)) AS k(step, outcome, set_no, times)""",
        "flow_m",
    )
)
def audited_versions(spark, d):
    """Write, audit, publish: what readers see of a table after a sound version, one with blank units, one with repeated keys, a sound one, and one that another load overtook."""
    rows = written(X.flow_m(spark, d), "flow_m")
    log = Log(spark, folder(spark, "audited"))
    asia = D.get(F.col("dims"), "region") == "ASIA"
    versions = [rows, rows.withColumn("unit", F.when(asia, " ").otherwise(F.col("unit"))), rows.unionByName(rows.where(asia).withColumn("value", F.lit(1.0))), rows.withColumn("value", F.col("value") * 3), rows.withColumn("value", F.lit(0.0))]

    def staged(version, start=None):
        load = start or log.begin()
        with load:
            load.write("facts", version, ["series_id", "date"], 4)
            load.audit("facts", contracts.observation_violations)

    out, late = None, None
    for step, version in enumerate(versions, 1):
        if step == 4:
            late = log.begin()  # it starts from the set that the fourth version replaces
        outcome = _refused(lambda: staged(version, late if step == 5 else None))  # noqa: B023
        seen = log.latest()
        by = seen.read("facts").groupBy(D.get(F.col("dims"), "region").alias("region")).agg(F.count("*").alias("n_rows"), F.sum("value").alias("total"))
        one = by.select(F.lit(step).alias("step"), F.lit(outcome).alias("outcome"), F.lit(seen.number).alias("set_no"), "region", "n_rows", "total")
        out = one if out is None else out.unionByName(one)
    return rounded(out, 2, total=2)


_FILES = """f AS (SELECT o_orderpriority AS code, date_trunc('month', o_orderdate)::DATE AS date, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2),
 e AS (SELECT code, date, v, 0 AS seq FROM f WHERE year(date) < 1998 UNION ALL SELECT code, date, 2 * v, 9 FROM f WHERE year(date) >= 1997 UNION ALL SELECT code, date, 3 * v, 10 FROM f WHERE month(date) = 6 AND year(date) >= 1996)"""


@query(f"WITH {_FILES} SELECT 'API:' || code AS series_id, last_day(date) AS date, round(arg_max(v, seq), 2) AS value, max(seq) AS ingest_seq FROM e GROUP BY 1, 2")
def incremental_merge(spark, d):
    """Silver of an API's files, merged: files 9 and 10 of one delivery overlap each other and what was there, and the later file stands."""
    o = X.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("code"), F.trunc("o_orderdate", "MM").alias("date")).agg(F.sum("o_totalprice").alias("value"))
    o = written(o, "api")
    catalog = o.select("code").distinct().withColumns({"freq_text": F.lit("AYLIK"), "unit": F.lit("usd")})
    silver = lambda rows, seq: lakehouse.api_silver(rows, catalog, "API").withColumn("ingest_seq", F.lit(seq))
    log = Log(spark, folder(spark, "api"))
    with log.begin() as load:
        load.write("silver", silver(o.where("year(date) < 1998"), 0), ["series_id", "date"], 16)
    nine = silver(o.where("year(date) >= 1997").withColumn("value", F.col("value") * 2), 9)
    ten = silver(o.where("month(date) = 6 and year(date) >= 1996").withColumn("value", F.col("value") * 3), 10)
    with log.begin() as load:
        load.merge("silver", ten.unionByName(nine), ["series_id", "date"], "ingest_seq")
    return rounded(log.latest().read("silver").select("series_id", "date", "value", "ingest_seq"), 2)


@query(f"WITH {_FILES} SELECT 'API:' || code AS series_id, last_day(date) AS date, round(arg_max(v, seq), 2) AS value, 'M' AS freq, '{{}}' AS dims FROM e WHERE seq < 10 GROUP BY 1, 2")
def api_incremental(spark, d):
    """The incremental branch of the API's silver: new readings over existing ones, all others kept."""
    o = X.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("code"), F.trunc("o_orderdate", "MM").alias("date")).agg(F.sum("o_totalprice").alias("value"))
    catalog = o.select("code").distinct().withColumns({"freq_text": F.lit("AYLIK"), "unit": F.lit("usd")})
    old = lakehouse.api_silver(o.where("year(date) < 1998"), catalog, "API")
    new = o.where("year(date) >= 1997").withColumn("value", F.col("value") * 2)
    return rounded(lakehouse.api_silver(new, catalog, "API", old).select("series_id", "date", "value", "freq", "dims"), 2)
