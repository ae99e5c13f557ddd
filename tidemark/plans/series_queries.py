"""Queries over series: alignment, changes, anomalies, statistics, cycles, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as T
from ..functions import dims as D
from ..operators import align, change, concentration, contracts, cycles, gold, health, stats
from ..sources.scratch import written
from . import fixtures as X
from .registry import query

_MDIFF = "(year(date) - year(lag(date, {n}) OVER w)) * 12 + month(date) - month(lag(date, {n}) OVER w)"


def rounded(df, places=4, **names):
    """Doubles rounded, so that sums taken in another order compare equal."""
    return df.select(*[F.round(c, names.get(c, places)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_CHANGE = """SELECT series_id, dims, date, round(value, 2) AS value, round(value - m, 2) AS mom_abs, round((value - m) / NULLIF(abs(m), 0), 6) AS mom_pct,
 round(value - y, 2) AS yoy_abs, round((value - y) / NULLIF(abs(y), 0), 6) AS yoy_pct FROM (SELECT *, CASE WHEN {m1} = 1 THEN lag(value, 1) OVER w END AS m,
 CASE WHEN {m12} = 12 THEN lag(value, 12) OVER w END AS y FROM {view} WINDOW w AS (PARTITION BY series_id, dims ORDER BY date)) AS t"""


def _change_sql(view):
    return X.sql(_CHANGE.format(view=view, m1=_MDIFF.format(n=1), m12=_MDIFF.format(n=12)), view)


def _changes(df):
    out = change.periodic(df).select("series_id", "dims", "date", "value", "mom_abs", "mom_pct", "yoy_abs", "yoy_pct")
    return rounded(out, 2, mom_pct=6, yoy_pct=6)


@query(_change_sql("flow_m"))
def change_mom_yoy(spark, d):
    return _changes(X.flow_m(spark, d))


@query(_change_sql("gap_m"))
def change_gap_aware(spark, d):
    return _changes(X.gap_m(spark, d))


@query(
    X.sql(
        f"""WITH u AS (SELECT * FROM flow_m UNION ALL SELECT * FROM geo_rows UNION ALL SELECT * FROM year_y),
 t AS (SELECT *, CASE WHEN freq = 'M' AND {_MDIFF.format(n=1)} = 1 THEN lag(value, 1) OVER w END AS m,
  CASE WHEN freq = 'M' AND {_MDIFF.format(n=12)} = 12 THEN lag(value, 12) OVER w WHEN freq = 'Q' AND {_MDIFF.format(n=4)} = 12 THEN lag(value, 4) OVER w WHEN freq = 'Y' AND {_MDIFF.format(n=1)} = 12 THEN lag(value, 1) OVER w END AS y
  FROM u WINDOW w AS (PARTITION BY series_id, dims, freq ORDER BY date))
 SELECT series_id, dims, freq, date, round(value - m, 2) AS mom_abs, round((value - m) / NULLIF(abs(m), 0), 6) AS mom_pct, round(value - y, 2) AS yoy_abs, round((value - y) / NULLIF(abs(y), 0), 6) AS yoy_pct FROM t""",
        "flow_m", "geo_rows", "year_y",
    )
)
def change_by_freq(spark, d):
    rows = X.flow_m(spark, d).unionByName(X.geo_rows(spark, d)).unionByName(X.year_y(spark, d))
    out = change.by_frequency(rows).select("series_id", "dims", "freq", "date", "mom_abs", "mom_pct", "yoy_abs", "yoy_pct")
    return rounded(out, 2, mom_pct=6, yoy_pct=6)


@query(X.sql("SELECT series_id, dims, max(date) AS date, round(arg_max(value, date), 2) AS value FROM flow_m GROUP BY series_id, dims", "flow_m"))
def latest_per_series(spark, d):
    return rounded(change.latest(X.flow_m(spark, d)).select("series_id", "dims", "date", "value"), 2)


def _aligned(view, method, agg):
    return X.sql(f"SELECT series_id, dims, last_day(date) AS date, '{method}' AS alignment_method, round({agg}, 4) AS value FROM {view} GROUP BY series_id, dims, last_day(date)", view)


def _to_month(df, method):
    out = align.to_month_end(df.withColumn("method", F.lit(method)))
    return rounded(out.select("series_id", "dims", "date", "alignment_method", "value"))


@query(_aligned("flow_d", "sum", "sum(value)"))
def align_daily_sum(spark, d):
    return _to_month(X.flow_d(spark, d), "sum")


@query(_aligned("price_d", "mean", "avg(value)"))
def align_daily_mean(spark, d):
    return _to_month(X.price_d(spark, d), "mean")


@query(_aligned("stock_w", "last", "arg_max(value, date)"))
def align_weekly_last(spark, d):
    return _to_month(X.stock_w(spark, d), "last")


def _all_rows(spark, d):
    orders = X.daily_orders(spark, d)
    return X.flow_d(spark, d, orders).unionByName(X.price_d(spark, d)).unionByName(X.stock_w(spark, d)).unionByName(X.flow_m(spark, d, orders)).unionByName(X.gap_m(spark, d, orders)).unionByName(X.geo_rows(spark, d)).unionByName(X.ytd_m(spark, d))


_ALL = ("flow_d", "price_d", "stock_w", "flow_m", "gap_m", "geo_rows", "ytd_m")
_UNION = " UNION ALL ".join(f"SELECT * FROM {v}" for v in _ALL)


@query(
    X.sql(
        """SELECT series_id, source, dims, last_day(date) AS date, round(sum(value), 4) AS value, 'D' AS source_freq, 'sum' AS alignment_method FROM flow_d GROUP BY ALL
 UNION ALL SELECT series_id, source, dims, last_day(date), round(avg(value), 4), 'D', 'mean' FROM price_d GROUP BY ALL
 UNION ALL SELECT series_id, source, dims, last_day(date), round(arg_max(value, date), 4), 'W', 'last' FROM stock_w GROUP BY ALL
 UNION ALL SELECT series_id, source, dims, date, round(value, 4), 'M', 'native' FROM flow_m UNION ALL SELECT series_id, source, dims, date, round(value, 4), 'M', 'native' FROM gap_m
 UNION ALL SELECT series_id, source, dims, date, round(value, 4), 'Q', 'quarter_end_sparse' FROM geo_rows""",
        *_ALL,
    )
)
def align_monthly_all(spark, d):
    facts = written(_all_rows(spark, d), "facts")  # alignment reads a table of facts, branch by branch
    out = align.monthly(facts, X.metadata(spark))
    return rounded(out.select("series_id", "source", "dims", "date", "value", "source_freq", "alignment_method"))


@query(X.sql("SELECT series_id, dims, last_day(date) AS date, round(value, 4) AS value, 'quarter_end_sparse' AS alignment_method FROM geo_rows", "geo_rows"))
def align_quarter_sparse(spark, d):
    return rounded(align.native_month(X.geo_rows(spark, d), "quarter_end_sparse").select("series_id", "dims", "date", "value", "alignment_method"))


@query(
    X.sql(
        """WITH b AS (SELECT series_id, dims, date_trunc('month', min(date)) AS lo, date_trunc('month', max(date)) AS hi FROM geo_rows GROUP BY 1, 2),
 s AS (SELECT series_id, dims, last_day(CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE)) AS date FROM b)
 SELECT s.series_id, s.dims, s.date, round(last_value(g.value IGNORE NULLS) OVER (PARTITION BY s.series_id, s.dims ORDER BY s.date ROWS UNBOUNDED PRECEDING), 4) AS value, g.value IS NULL AS is_imputed
 FROM s LEFT JOIN geo_rows g ON s.series_id = g.series_id AND s.dims = g.dims AND s.date = g.date""",
        "geo_rows",
    )
)
def align_quarter_ffill(spark, d):
    return rounded(align.quarter_fill(X.geo_rows(spark, d)).select("series_id", "dims", "date", "value", "is_imputed"))


def _flag(spark, d, flag):
    return X.price_d(spark, d).where(D.get(F.col("dims"), "flag") == flag)


_FRIDAY = "CAST(date + CAST(5 - isodow(date) AS INTEGER) AS DATE)"


@query(
    X.sql(
        f"""WITH a AS (SELECT {_FRIDAY} AS date, avg(value) AS v FROM price_d WHERE dims = '{{"flag":"A"}}' GROUP BY 1), b AS (SELECT {_FRIDAY} AS date, avg(value) AS v FROM price_d WHERE dims = '{{"flag":"R"}}' GROUP BY 1)
 SELECT a.date, round(a.v, 4) AS value_a, round(b.v, 4) AS value_b FROM a JOIN b ON a.date = b.date""",
        "price_d",
    )
)
def align_pair_weekly(spark, d):
    return rounded(align.pair(_flag(spark, d, "A"), _flag(spark, d, "R"), "D", "D", "mean", "mean", "W")[0])


@query(
    X.sql(
        """WITH a AS (SELECT last_day(date) AS date, avg(value) AS v FROM price_d WHERE dims = '{"flag":"A"}' GROUP BY 1), b AS (SELECT date, value AS v FROM flow_m WHERE dims = '{"region":"ASIA"}')
 SELECT a.date, round(a.v, 4) AS value_a, round(b.v, 4) AS value_b FROM a JOIN b ON a.date = b.date""",
        "price_d", "flow_m",
    )
)
def align_pair_auto(spark, d):
    b = X.flow_m(spark, d).where(D.get(F.col("dims"), "region") == "ASIA")
    return rounded(align.pair(_flag(spark, d, "A"), b, "D", "M", "mean", "sum")[0])


@query(X.sql("SELECT dims, date, round(CASE WHEN row_number() OVER w = 1 THEN value ELSE value - lag(value) OVER w END, 2) AS value FROM ytd_m WINDOW w AS (PARTITION BY series_id, dims, year(date) ORDER BY date)", "ytd_m"))
def decumulate_ytd(spark, d):
    return rounded(change.decumulate(X.ytd_m(spark, d), "ytd").select("dims", "date", "value"), 2)


@query(X.sql("SELECT dims, date, round(CASE WHEN row_number() OVER w = 1 THEN value ELSE value - lag(value) OVER w END, 2) AS value FROM ytd_m WINDOW w AS (PARTITION BY series_id, dims ORDER BY date)", "ytd_m"))
def decumulate_since_start(spark, d):
    return rounded(change.decumulate(X.ytd_m(spark, d), "since_start").select("dims", "date", "value"), 2)


@query(
    X.sql(
        """WITH u AS (SELECT * FROM ytd_m UNION ALL SELECT * FROM flow_m), s AS (SELECT *, year(date) AS y, value - lag(value) OVER (PARTITION BY series_id, dims, year(date) ORDER BY date) AS step FROM u),
 yr AS (SELECT series_id, dims, y, count(*) AS n, avg(CASE WHEN step IS NULL THEN NULL WHEN step >= 0 THEN 1.0 ELSE 0.0 END) AS ratio, arg_min(value, date) AS f, arg_max(value, date) AS l FROM s GROUP BY 1, 2, 3),
 r AS (SELECT *, CASE WHEN lead(y) OVER w = y + 1 AND l > 0 AND lead(f) OVER w < 0.4 * l THEN 1 ELSE 0 END AS reset FROM yr WINDOW w AS (PARTITION BY series_id, dims ORDER BY y)),
 rs AS (SELECT series_id, max(k) AS resets FROM (SELECT series_id, dims, sum(reset) AS k FROM r GROUP BY 1, 2) GROUP BY 1),
 sy AS (SELECT series_id, y, avg(CASE WHEN ratio >= 0.9 AND l > f THEN 1.0 ELSE 0.0 END) AS share, avg(ratio) AS ratio, max(ratio) AS top FROM r WHERE n >= 6 GROUP BY 1, 2),
 c AS (SELECT series_id, count(*) AS reviewed_years, count(*) FILTER (WHERE share >= 0.8) AS monotonic_years, avg(share) AS a, avg(ratio) AS b, max(top) AS m FROM sy GROUP BY 1)
 SELECT c.series_id, reviewed_years, monotonic_years, round(monotonic_years / reviewed_years, 4) AS monotonic_share, round(a, 4) AS avg_monotonic_dim_share, round(b, 4) AS avg_nonnegative_ratio, round(m, 4) AS max_nonnegative_ratio,
 CAST(resets AS BIGINT) AS reset_signals, round(2 * monotonic_years / reviewed_years + a + b + resets, 4) AS review_score FROM c JOIN rs ON c.series_id = rs.series_id
 WHERE (monotonic_years >= 3 AND monotonic_years / reviewed_years >= 0.6) OR (monotonic_years >= 2 AND resets >= 2)""",
        "ytd_m", "flow_m",
    )
)
def cumulative_review(spark, d):
    return rounded(change.cumulative_scan(X.ytd_m(spark, d).unionByName(X.flow_m(spark, d))))


@query(X.sql("SELECT dims, date, round((value - lag(value) OVER w) / NULLIF(lag(value) OVER w, 0), 6) AS pct_change FROM flow_m WINDOW w AS (PARTITION BY series_id, dims ORDER BY date)", "flow_m"))
def pct_change_seq(spark, d):
    return rounded(change.sequence_change(X.flow_m(spark, d)).select("dims", "date", "pct_change"), 6)


@query(
    X.sql(
        """WITH t AS (SELECT dims, date, value, (value - lag(value) OVER w) / NULLIF(lag(value) OVER w, 0) AS p FROM flow_m WINDOW w AS (PARTITION BY series_id, dims ORDER BY date))
 SELECT dims, date, round(value, 2) AS value, round(p, 6) AS pct_change FROM (SELECT *, row_number() OVER (PARTITION BY dims ORDER BY abs(p) DESC, date) AS n FROM t WHERE p IS NOT NULL) WHERE n = 1""",
        "flow_m",
    )
)
def shock_top(spark, d):
    return rounded(change.largest_shock(X.flow_m(spark, d)).select("dims", "date", "value", "pct_change"), 2, pct_change=6)


_REGIONS = {"africa": "AFRICA", "america": "AMERICA", "asia": "ASIA", "europe": "EUROPE", "middle_east": "MIDDLE EAST"}


@query(
    X.sql("SELECT date, " + ", ".join(f"round(max(CASE WHEN dims = '{{\"region\":\"{r}\"}}' THEN value END), 2) AS {c}" for c, r in _REGIONS.items()) + " FROM flow_m GROUP BY date", "flow_m")
)
def wide_gold(spark, d):
    slices = {c: gold.Slice("ORDERS:revenue_m", "region", r, "usd") for c, r in _REGIONS.items()}
    return rounded(gold.wide(X.flow_m(spark, d), slices, X.metadata(spark)), 2)


_PAIR = """WITH d AS (SELECT a.date, a.value AS a, r.value AS r, a.value / NULLIF(r.value, 0) AS ratio FROM (SELECT * FROM price_d WHERE dims = '{"flag":"A"}') a JOIN (SELECT * FROM price_d WHERE dims = '{"flag":"R"}') r ON a.date = r.date)"""


@query(X.sql(_PAIR + " SELECT date, round(a, 4) AS a, round(r, 4) AS r, round(ratio, 6) AS ratio FROM d", "price_d"))
def ratio_daily(spark, d):
    return rounded(gold.ratio_daily(_flag(spark, d, "A"), _flag(spark, d, "R"), "a", "r"), 4, ratio=6)


@query(
    X.sql(
        _PAIR
        + """, m AS (SELECT last_day(date) AS date, avg(a) AS a, avg(r) AS r, avg(ratio) AS ratio FROM d GROUP BY 1),
 s AS (SELECT last_day(CAST(unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), INTERVAL 1 MONTH)) AS DATE)) AS date FROM m)
 SELECT s.date, round(a, 4) AS a, round(r, 4) AS r, round(ratio, 6) AS ratio, round((ratio - lag(ratio) OVER (ORDER BY s.date)) / NULLIF(lag(ratio) OVER (ORDER BY s.date), 0), 6) AS ratio_change FROM s LEFT JOIN m ON s.date = m.date""",
        "price_d",
    )
)
def ratio_monthly(spark, d):
    daily = gold.ratio_daily(_flag(spark, d, "A"), _flag(spark, d, "R"), "a", "r")
    return rounded(gold.ratio_monthly(daily, ["a", "r"]).select("date", "a", "r", "ratio", "ratio_change"), 4, ratio=6, ratio_change=6)


@query(
    X.sql(
        """SELECT date, json_extract_string(dims, '$.province') AS province, round(max(CASE WHEN series_id = 'GEO:good' THEN value END), 2) AS good, round(max(CASE WHEN series_id = 'GEO:bad' THEN value END), 2) AS bad,
 round(max(CASE WHEN series_id = 'GEO:bad' THEN value END) / NULLIF(max(CASE WHEN series_id = 'GEO:good' THEN value END) + max(CASE WHEN series_id = 'GEO:bad' THEN value END), 0), 6) AS bad_ratio FROM geo_rows GROUP BY 1, 2""",
        "geo_rows",
    )
)
def geo_quality(spark, d):
    return rounded(gold.geo_quality(X.geo_rows(spark, d), {"province": "province"}, "GEO:good", "GEO:bad"), 2, bad_ratio=6)


_CHANGED = f"""c AS (SELECT dims, date, value, (value - m) / NULLIF(abs(m), 0) AS p FROM (SELECT *, CASE WHEN {_MDIFF.format(n=1)} = 1 THEN lag(value) OVER w END AS m FROM flow_m WINDOW w AS (PARTITION BY series_id, dims ORDER BY date)) AS t WHERE date < (SELECT max(date) FROM flow_m))"""


def _open_month(spark, d):
    """The end of the last month that has orders: it may not be whole, so it is left out."""
    return X.table(spark, d, "orders").agg(F.last_day(F.to_date(F.max("o_orderdate")))).scalar()


def _changed(spark, d):
    return change.periodic(X.flow_m(spark, d)).where(F.col("date") < _open_month(spark, d)).select("dims", "date", "value", "mom_pct")


@query(
    X.sql(
        f"""WITH {_CHANGED}, v AS (SELECT * FROM c WHERE p IS NOT NULL), md AS (SELECT dims, median(p) AS mid FROM v GROUP BY 1), mad AS (SELECT v.dims, mid, median(abs(p - mid)) AS mad FROM v JOIN md ON v.dims = md.dims GROUP BY 1, 2),
 z AS (SELECT v.*, 0.6745 * (p - mid) / CASE WHEN mad = 0 THEN 1e-9 ELSE mad END AS z FROM v JOIN mad ON v.dims = mad.dims)
 SELECT dims, date, round(p, 6) AS mom_pct, round(z, 4) AS z_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY dims ORDER BY abs(z) DESC, date) AS rank FROM z WHERE abs(z) >= 2) WHERE rank <= 20""",
        "flow_m",
    )
)
def anomaly_robust(spark, d):
    return rounded(stats.anomalies(_changed(spark, d), ["dims"]).select("dims", "date", "mom_pct", "z_score", F.col("rank").cast("long").alias("rank")), 4, mom_pct=6)


@query(
    X.sql(
        f"""WITH {_CHANGED}, s AS (SELECT dims, avg(p) AS mid, stddev_samp(p) AS sd FROM c WHERE p IS NOT NULL GROUP BY 1), z AS (SELECT c.*, (p - mid) / NULLIF(sd, 0) AS z FROM c JOIN s ON c.dims = s.dims WHERE p IS NOT NULL)
 SELECT dims, date, round(p, 6) AS mom_pct, round(z, 4) AS z_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY dims ORDER BY abs(z) DESC, date) AS rank FROM z WHERE abs(z) >= 2) WHERE rank <= 20""",
        "flow_m",
    )
)
def anomaly_zscore(spark, d):
    out = stats.anomalies(_changed(spark, d), ["dims"], method="zscore")
    return rounded(out.select("dims", "date", "mom_pct", "z_score", F.col("rank").cast("long").alias("rank")), 4, mom_pct=6)


def _two(spark, d):
    orders = X.table(spark, d, "orders").withColumn("date", F.last_day(F.to_date("o_orderdate"))).where(F.col("date") < _open_month(spark, d)).groupBy("date").agg(F.count("*").cast("double").alias("n"), F.avg("o_totalprice").alias("ticket"), F.sum("o_totalprice").alias("revenue"))
    items = X.table(spark, d, "lineitem").withColumn("date", F.last_day(F.to_date("l_shipdate"))).groupBy("date").agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return orders, items


_TWO = """o AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS date, CAST(count(*) AS DOUBLE) AS n, avg(o_totalprice) AS ticket, sum(o_totalprice) AS revenue FROM orders WHERE last_day(CAST(o_orderdate AS DATE)) < (SELECT last_day(CAST(max(o_orderdate) AS DATE)) FROM orders) GROUP BY 1),
 i AS (SELECT last_day(CAST(l_shipdate AS DATE)) AS date, avg(l_extendedprice / l_quantity) AS price FROM lineitem GROUP BY 1), p AS (SELECT o.date, o.revenue AS a, i.price AS b, n, ticket FROM o JOIN i ON o.date = i.date)"""


def _revenue_price(spark, d):
    o, i = _two(spark, d)
    return stats.paired(o.select("date", F.col("revenue").alias("value")), i.select("date", F.col("price").alias("value")))


@query(f"WITH {_TWO} SELECT count(*) AS n, round(corr(a, b), 4) AS correlation, 'D' AS grain FROM p")
def corr_pair(spark, d):
    return rounded(stats.correlation(_revenue_price(spark, d)))


@query(
    f"""WITH {_TWO}, r AS (SELECT a, b, row_number() OVER (ORDER BY date) AS i FROM p), l AS (SELECT unnest(generate_series(-6, 6)) AS lag), c AS (SELECT lag, count(*) AS n, round(corr(x.a, y.b), 4) AS correlation FROM l JOIN r x ON true JOIN r y ON y.i = x.i + lag GROUP BY 1)
 SELECT lag, n, correlation, row_number() OVER (ORDER BY abs(correlation) DESC NULLS LAST, abs(lag), lag) = 1 AS is_best FROM c"""
)
def corr_lead_lag(spark, d):
    return stats.lead_lag(_revenue_price(spark, d)).withColumn("lag", F.col("lag").cast("long"))


def _count_ticket(spark, d):
    o, _ = _two(spark, d)
    return o.select("date", F.col("n").alias("value")), o.select("date", F.col("ticket").alias("value"))


_ELASTIC = "CASE WHEN abs(e) > 1.2 THEN 'elastic' WHEN abs(e) >= 0.8 THEN 'unit' ELSE 'inelastic' END AS elastic_class, CASE WHEN e > 0 THEN 'positive' WHEN e < 0 THEN 'negative' ELSE 'none' END AS direction"


@query(f"WITH {_TWO} SELECT n, round(e, 4) AS elasticity, round(r2, 4) AS r_squared, 'log_log' AS form, {_ELASTIC} FROM (SELECT count(*) AS n, regr_slope(ln(n), ln(ticket)) AS e, regr_r2(ln(n), ln(ticket)) AS r2 FROM o)")
def elasticity_loglog(spark, d):
    return rounded(stats.elasticity(*_count_ticket(spark, d)))


@query(
    f"""WITH {_TWO}, x AS (SELECT date, n, lag(ticket, 3) OVER (ORDER BY date) AS t FROM o)
 SELECT n, round(e, 4) AS elasticity, round(r2, 4) AS r_squared, 'log_log' AS form, {_ELASTIC} FROM (SELECT count(*) AS n, regr_slope(ln(n), ln(t)) AS e, regr_r2(ln(n), ln(t)) AS r2 FROM x WHERE t IS NOT NULL)"""
)
def elasticity_lagged(spark, d):
    return rounded(stats.elasticity(*_count_ticket(spark, d), lag=3))


@query(
    f"""WITH {_TWO}, e AS (SELECT count(*) AS n, arg_min(n, date) AS y0, arg_max(n, date) AS y1, arg_min(ticket, date) AS x0, arg_max(ticket, date) AS x1 FROM o)
 SELECT n, round(e, 4) AS elasticity, 1.0::DOUBLE AS r_squared, 'arc' AS form, {_ELASTIC} FROM (SELECT n, ((y1 - y0) / ((y1 + y0) / 2)) / ((x1 - x0) / ((x1 + x0) / 2)) AS e FROM e)"""
)
def elasticity_arc(spark, d):
    return rounded(stats.elasticity(*_count_ticket(spark, d), method="arc"))


def _deflated(spark, d):
    o, i = _two(spark, d)
    return stats.deflated(o.select("date", F.col("revenue").alias("value")), i.select("date", F.col("price").alias("value")))


_REAL = f"{_TWO}, f AS (SELECT arg_min(b, date) AS base FROM p), r AS (SELECT date, a AS nominal, b AS deflator, CASE WHEN b > 0 THEN a * base / b ELSE a END AS real FROM p, f)"


@query(f"WITH {_REAL} SELECT date, round(nominal, 2) AS nominal, round(deflator, 4) AS deflator, round(real, 2) AS real FROM r")
def deflate_series(spark, d):
    return rounded(_deflated(spark, d), 2, deflator=4)


@query(
    f"""WITH {_REAL}, e AS (SELECT round(arg_min(nominal, date), 2) AS n0, round(arg_max(nominal, date), 2) AS n1, arg_min(deflator, date) AS d0, arg_max(deflator, date) AS d1, round(arg_min(real, date), 2) AS r0, round(arg_max(real, date), 2) AS r1 FROM r)
 SELECT round((n1 - n0) / n0 * 100, 4) AS nominal_growth_pct, round((d1 - d0) / d0 * 100, 4) AS inflation_pct, round((r1 - r0) / r0 * 100, 4) AS real_growth_pct, round((n1 - n0) / n0 * 100 - (r1 - r0) / r0 * 100, 4) AS erosion_pct FROM e"""
)
def deflate_summary(spark, d):
    return rounded(stats.deflation_summary(_deflated(spark, d)))


def _whole_months(spark, d):
    return X.flow_m(spark, d).where(F.col("date") < _open_month(spark, d))


_SMOOTH = """s AS (SELECT dims, date, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY dims) AS n, sum(value) OVER (PARTITION BY dims ORDER BY date ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS smooth FROM flow_m WHERE date < (SELECT max(date) FROM flow_m) WINDOW w AS (PARTITION BY dims ORDER BY date))"""
_TURNS = f"""{_SMOOTH}, x AS (SELECT *, max(smooth) OVER v AS hi, min(smooth) OVER v AS lo FROM s WINDOW v AS (PARTITION BY dims ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
 e AS (SELECT *, CASE WHEN smooth = hi THEN 'peak' ELSE 'trough' END AS kind FROM x WHERE i >= 2 AND i < n - 2 AND (smooth = hi OR smooth = lo)),
 g AS (SELECT *, sum(t) OVER (PARTITION BY dims ORDER BY i) AS run FROM (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY dims ORDER BY i) IS DISTINCT FROM kind THEN 1 ELSE 0 END AS t FROM e)),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dims, run ORDER BY CASE WHEN kind = 'peak' THEN value ELSE -value END DESC, i) AS k FROM g) WHERE k = 1)"""


@query(X.sql(f"WITH {_SMOOTH} SELECT dims, date, round(smooth, 2) AS smooth FROM s", "flow_m"))
def cycle_smooth(spark, d):
    return rounded(cycles.smoothed(_whole_months(spark, d)).select("dims", "date", "smooth"), 2)


@query(X.sql(f"WITH {_TURNS} SELECT dims, date, i, kind, round(value, 2) AS value FROM b", "flow_m"))
def cycle_turning_points(spark, d):
    return rounded(cycles.turning_points(_whole_months(spark, d)).select("dims", "date", F.col("i").cast("long").alias("i"), "kind", "value"), 2)


_DRAW = "dd AS (SELECT dims, max(CASE WHEN peak > 0 THEN (peak - value) / peak * 100 END) AS dd FROM (SELECT dims, value, max(value) OVER (PARTITION BY dims ORDER BY date) AS peak FROM s) GROUP BY 1)"


@query(X.sql(f"WITH {_SMOOTH}, {_DRAW} SELECT dims, round(dd, 4) AS max_drawdown_pct FROM dd", "flow_m"))
def cycle_drawdown(spark, d):
    return rounded(cycles.drawdown(_whole_months(spark, d)).select("dims", "max_drawdown_pct"))


@query(
    X.sql(
        f"""WITH {_TURNS}, {_DRAW}, l AS (SELECT dims, arg_max(kind, i) AS kind, max(i) AS i, count(*) FILTER (WHERE kind = 'peak') AS n_peaks, count(*) FILTER (WHERE kind = 'trough') AS n_troughs FROM b GROUP BY 1), c AS (SELECT dims, count(*) AS n FROM s GROUP BY 1)
 SELECT c.dims, n, CASE kind WHEN 'trough' THEN 'expansion' WHEN 'peak' THEN 'contraction' ELSE 'none' END AS phase, coalesce(n - 1 - i, n) AS duration, coalesce(n_peaks, 0) AS n_peaks, coalesce(n_troughs, 0) AS n_troughs, round(dd, 4) AS max_drawdown_pct
 FROM c LEFT JOIN l ON c.dims = l.dims JOIN dd ON c.dims = dd.dims""",
        "flow_m",
    )
)
def cycle_phase(spark, d):
    out = cycles.phases(_whole_months(spark, d)).select("dims", "n", "phase", "duration", "n_peaks", "n_troughs", "max_drawdown_pct")
    return rounded(out)


def _last_month(spark, d):
    rows = X._placed_orders(spark, d).withColumn("date", F.last_day("day"))
    return concentration.entity_sums(concentration.at_month(rows, "2001-07"), F.col("n_name"), "o_totalprice")


_SUMS = "e AS (SELECT n_name AS entity, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= DATE '2001-07-01' AND o_orderdate < DATE '2001-08-01' GROUP BY 1 HAVING sum(o_totalprice) > 0), s AS (SELECT *, value / sum(value) OVER () * 100 AS share, row_number() OVER (ORDER BY value DESC, entity) AS rank FROM e)"


@query(
    f"""WITH {_SUMS}, x AS (SELECT count(*) AS n_entities, sum(value) AS total, sum(CASE WHEN rank <= 3 THEN share END) AS a, sum(CASE WHEN rank <= 5 THEN share END) AS b, sum(share * share) AS h FROM s)
 SELECT n_entities, round(total, 2) AS total, round(a, 4) AS cr3_pct, round(b, 4) AS cr5_pct, round(h, 4) AS hhi, CASE WHEN h > 2500 THEN 'high' WHEN h >= 1500 THEN 'moderate' ELSE 'low' END AS level FROM x"""
)
def concentration_indices(spark, d):
    return rounded(concentration.indices(_last_month(spark, d)), 4, total=2)


@query(f"WITH {_SUMS} SELECT entity, round(value, 2) AS value, round(share, 4) AS share_pct, rank, round(sum(share) OVER (ORDER BY rank), 4) AS cumulative_pct FROM s QUALIFY rank <= 5")
def concentration_top(spark, d):
    out = concentration.ranked(_last_month(spark, d)).where("rank <= 5")
    return rounded(out.select("entity", "value", "share_pct", F.col("rank").cast("long").alias("rank"), "cumulative_pct"), 4, value=2)


_EXPECT = "(year(hi) - year(lo)) * 12 + month(hi) - month(lo) + 1"


@query(
    X.sql(
        f"""WITH s AS (SELECT series_id, dims, count(*) AS n_obs, count(*) FILTER (WHERE value IS NULL OR isnan(value)) AS n_null, min(date) AS lo, max(date) AS hi FROM gap_m GROUP BY 1, 2), x AS (SELECT *, {_EXPECT} AS expected FROM s),
 m AS (SELECT *, greatest(expected - n_obs, 0) + n_null AS missing, round((greatest(expected - n_obs, 0) + n_null) * 100.0 / greatest(expected, n_obs), 2) AS missing_pct FROM x),
 h AS (SELECT *, round(greatest(0.0, least(100.0, 100 - missing_pct * 1.5 - CASE WHEN n_obs < 5 THEN 10.0 ELSE 0.0 END)), 1) AS score FROM m)
 SELECT dims, n_obs, expected, missing, CAST(missing_pct AS DOUBLE) AS missing_pct, CAST(score AS DOUBLE) AS health_score, CASE WHEN score >= 90 THEN 'EXCELLENT' WHEN score >= 75 THEN 'GOOD' WHEN score >= 50 THEN 'FAIR' ELSE 'WARNING' END AS health_status FROM h""",
        "gap_m",
    )
)
def health_series(spark, d):
    return health.series_health(X.gap_m(spark, d), per_dims=True).select("dims", "n_obs", "expected", "missing", "missing_pct", "health_score", "health_status")


@query(
    X.sql(
        """SELECT series_id, total, valid, round(valid * 100.0 / total, 2)::DOUBLE AS completeness_pct, fd AS first_date, ld AS last_date, fv AS first_valid, lv AS last_valid, coalesce(fv > fd, true) AS late_start,
 CASE WHEN valid * 100.0 / total = 100 THEN 'complete' WHEN valid * 100.0 / total >= 90 THEN 'good' WHEN valid * 100.0 / total >= 70 THEN 'partial' ELSE 'sparse' END AS status
 FROM (SELECT series_id || dims AS series_id, count(*) AS total, count(*) FILTER (WHERE value > 50000) AS valid, min(date) AS fd, max(date) AS ld, min(CASE WHEN value > 50000 THEN date END) AS fv, max(CASE WHEN value > 50000 THEN date END) AS lv FROM gap_m GROUP BY 1)""",
        "gap_m",
    )
)
def completeness_audit(spark, d):
    # Small values stand as missing, so that every band occurs.
    rows = X.gap_m(spark, d).withColumns({"series_id": F.concat("series_id", "dims"), "value": F.when(F.col("value") > 50000, F.col("value"))})
    return health.completeness(rows).select("series_id", "total", "valid", "completeness_pct", "first_date", "last_date", "first_valid", "last_valid", "late_start", "status")


@query(
    X.sql(
        f"""WITH u AS ({_UNION}), d AS (SELECT count(*) AS c FROM u GROUP BY series_id, date, dims HAVING count(*) > 1)
 SELECT 'null_series_id' AS rule, count(*) FILTER (WHERE series_id IS NULL OR trim(series_id) = '') AS n_rows FROM u UNION ALL SELECT 'null_source', count(*) FILTER (WHERE source IS NULL OR trim(source) = '') FROM u
 UNION ALL SELECT 'null_date', count(*) FILTER (WHERE date IS NULL) FROM u UNION ALL SELECT 'blank_unit', count(*) FILTER (WHERE unit IS NULL OR trim(unit) = '') FROM u
 UNION ALL SELECT 'bad_freq', count(*) FILTER (WHERE freq NOT IN ('D', 'W', 'M', 'Q', 'Y')) FROM u UNION ALL SELECT 'bad_dims', count(*) FILTER (WHERE json_type(dims) <> 'OBJECT') FROM u
 UNION ALL SELECT 'nan_value', count(*) FILTER (WHERE isnan(value)) FROM u UNION ALL SELECT 'duplicate_key', CAST(coalesce(sum(c) - count(*), 0) AS BIGINT) FROM d""",
        *_ALL,
    )
)
def contract_violations(spark, d):
    return contracts.observation_violations(_all_rows(spark, d))


@query(X.sql(f"WITH u AS ({_UNION}), m AS (SELECT * FROM (VALUES ('ORDERS:revenue_y'), ('ORDERS:revenue'), ('ORDERS:revenue_m'), ('ORDERS:ytd'), ('GEO:good'), ('GEO:bad'), ('LINEITEM:unit_price')) AS t(series_id)) SELECT series_id, 'facts_only' AS side FROM (SELECT DISTINCT series_id FROM u EXCEPT SELECT series_id FROM m) UNION ALL SELECT series_id, 'metadata_only' FROM (SELECT series_id FROM m EXCEPT SELECT series_id FROM u)", *_ALL))
def coverage_diff(spark, d):
    meta = X.metadata(spark).where(~F.col("series_id").isin("ORDERS:sparse_m", "LINEITEM:quantity_w"))
    return contracts.coverage_gaps(_all_rows(spark, d), meta)


@query("SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority, count(*) AS n_rows FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def dup_keys(spark, d):
    rows = X.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), "o_orderpriority")
    return contracts.duplicate_keys(rows, ["date", "o_orderpriority"])


@query(X.sql("SELECT dims, round(max(CASE WHEN date = DATE '1996-01-31' THEN value END), 2) AS start_value, round(max(CASE WHEN date = DATE '2000-12-31' THEN value END), 2) AS end_value, round((max(CASE WHEN date = DATE '2000-12-31' THEN value END) - max(CASE WHEN date = DATE '1996-01-31' THEN value END)) / max(CASE WHEN date = DATE '1996-01-31' THEN value END) * 100, 4) AS change_pct FROM flow_m GROUP BY dims", "flow_m"))
def cond_start_end(spark, d):
    at = lambda day: F.max(F.when(F.col("date") == F.lit(day).cast("date"), F.col("value")))
    out = X.flow_m(spark, d).groupBy("dims").agg(at("1996-01-31").alias("start_value"), at("2000-12-31").alias("end_value"))
    return rounded(out.withColumn("change_pct", F.try_divide(F.col("end_value") - F.col("start_value"), F.col("start_value")) * 100), 2, change_pct=4)


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def value_counts(spark, d):
    return X.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("value")).agg(F.count("*").alias("n"))


@query(X.sql(f"SELECT source, freq, count(*) AS n_rows, count(DISTINCT series_id) AS n_series, count(*) FILTER (WHERE value > 1000) AS n_large FROM ({_UNION}) GROUP BY 1, 2", *_ALL))
def by_source_freq(spark, d):
    return _all_rows(spark, d).groupBy("source", "freq").agg(F.count("*").alias("n_rows"), F.count_distinct("series_id").alias("n_series"), F.count_if(F.col("value") > 1000).alias("n_large"))


@query(X.sql("SELECT series_id, dims, date, round(value, 4) AS value FROM geo_rows WHERE series_id = 'GEO:good'", "geo_rows"))
def review_guard(spark, d):
    return rounded(contracts.reviewed_only(X.geo_rows(spark, d), X.metadata(spark)).select("series_id", "dims", "date", "value"))


@query(
    X.sql(
        "SELECT dims, date, freq, CASE freq WHEN 'W' THEN date - CAST(isodow(date) - 1 AS INTEGER) WHEN 'M' THEN CAST(date_trunc('month', date) AS DATE) WHEN 'Q' THEN CAST(date_trunc('quarter', date) AS DATE) WHEN 'Y' THEN CAST(date_trunc('year', date) AS DATE) ELSE date END AS period_start, CASE freq WHEN 'M' THEN last_day(date) WHEN 'Q' THEN last_day(CAST(date_trunc('quarter', date) AS DATE) + INTERVAL 2 MONTH) WHEN 'Y' THEN make_date(year(date), 12, 31) ELSE date END AS period_end FROM (SELECT * FROM flow_d UNION ALL SELECT * FROM stock_w UNION ALL SELECT * FROM flow_m UNION ALL SELECT * FROM geo_rows UNION ALL SELECT * FROM year_y)",
        "flow_d", "stock_w", "flow_m", "geo_rows", "year_y",
    )
)
def period_bounds(spark, d):
    rows = X.flow_d(spark, d).unionByName(X.stock_w(spark, d)).unionByName(X.flow_m(spark, d)).unionByName(X.geo_rows(spark, d)).unionByName(X.year_y(spark, d))
    return rows.select("dims", "date", "freq", T.period_start(F.col("date"), F.col("freq")).alias("period_start"), T.period_end(F.col("date"), F.col("freq")).alias("period_end"))
