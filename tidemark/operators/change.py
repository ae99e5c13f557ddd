"""Period changes that respect the calendar, de-cumulation, and sequences of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import month_distance

KEYS = ["series_id", "dims"]
#: Rows back and months back of each change by frequency.
LAGS = {"M": {"mom": (1, 1), "yoy": (12, 12)}, "Q": {"yoy": (4, 12)}, "Y": {"yoy": (1, 12)}}


def relative(now: Column, before: Column) -> Column:
    """(now - before) / |before|; null where that cannot be divided."""
    return F.try_divide(now - before, F.abs(before))


def lagged(order: W, rows: int, months: int) -> Column:
    """The value ``rows`` rows back if it lies exactly ``months`` calendar months back, else null."""
    return F.when(month_distance(F.col("date"), F.lag("date", rows).over(order)) == months, F.lag("value", rows).over(order))


def periodic(obs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``obs`` (a monthly panel) with mom_abs, mom_pct, yoy_abs, yoy_pct; a gap in the calendar gives null. One sort serves all."""
    order = W.partitionBy(*keys).orderBy("date")
    out = obs.withColumns({"_m": lagged(order, 1, 1), "_y": lagged(order, 12, 12)})
    v = F.col("value")
    return out.withColumns({"mom_abs": v - F.col("_m"), "mom_pct": relative(v, F.col("_m")), "yoy_abs": v - F.col("_y"), "yoy_pct": relative(v, F.col("_y"))}).drop("_m", "_y")


def by_frequency(obs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """As ``periodic``, for rows of any ``freq``: quarters and years have a year-over-year change only, days and weeks none."""
    order = W.partitionBy(*keys, "freq").orderBy("date")
    pick = lambda kind: F.coalesce(*[F.when(F.col("freq") == f, lagged(order, *lags[kind])) for f, lags in LAGS.items() if kind in lags])
    out = obs.withColumns({"_m": pick("mom"), "_y": pick("yoy")})
    v = F.col("value")
    return out.withColumns({"mom_abs": v - F.col("_m"), "mom_pct": relative(v, F.col("_m")), "yoy_abs": v - F.col("_y"), "yoy_pct": relative(v, F.col("_y"))}).drop("_m", "_y")


def latest(obs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The row with the last date of each key, as one aggregation."""
    rest = [c for c in obs.columns if c not in keys]
    top = obs.groupBy(*keys).agg(F.max_by(F.struct(*rest), "date").alias("row"))
    return top.select(*keys, "row.*")


def decumulate(obs: DataFrame, accumulation: str, keys: list[str] = KEYS) -> DataFrame:
    """Period values of an accumulating series: ``ytd`` restarts each year, ``since_start`` never does, ``none`` changes nothing.

    The first row of a run keeps its value; one whose predecessor is null becomes null, and a gap is spanned.
    """
    if accumulation == "none":
        return obs
    run = [*keys, F.year("date")] if accumulation == "ytd" else keys
    order = W.partitionBy(*run).orderBy("date")
    before = F.lag("value").over(order)
    return obs.withColumn("value", F.when(F.row_number().over(order) == 1, F.col("value")).otherwise(F.col("value") - before))


def with_periodic(obs: DataFrame, meta: DataFrame, suffix: str = "_periodic") -> DataFrame:
    """``obs`` and, for each accumulating series, its period values under its id with ``suffix``."""
    kinds = meta.where("accumulation <> 'none'").select("series_id", "accumulation")
    rows = obs.join(kinds, "series_id")
    made = decumulate(rows.where("accumulation = 'ytd'"), "ytd").unionByName(decumulate(rows.where("accumulation = 'since_start'"), "since_start"))
    return obs.unionByName(made.drop("accumulation").withColumn("series_id", F.concat("series_id", F.lit(suffix))).select(*obs.columns))


def sequence_change(obs: DataFrame, keys: list[str] = KEYS, percent: bool = False) -> DataFrame:
    """``obs`` with pct_change to the row before, as a fraction or in percent; null after a null or zero."""
    before = F.lag("value").over(W.partitionBy(*keys).orderBy("date"))
    change = F.try_divide(F.col("value") - before, F.abs(before) if percent else before)
    return obs.withColumn("pct_change", change * 100 if percent else change)


def largest_shock(obs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The row of each key with the largest absolute change to the row before; the earliest of equals."""
    rows = sequence_change(obs, keys).where("pct_change is not null")
    rest = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.abs("pct_change").alias("size"), (-F.datediff("date", F.lit("1970-01-01").cast("date"))).alias("early"))).alias("row"))
    return top.select(*keys, "row.*")


def cumulative_scan(obs: DataFrame) -> DataFrame:
    """(series_id, reviewed_years, monotonic_years, monotonic_share, avg_monotonic_dim_share, avg_nonnegative_ratio, max_nonnegative_ratio, reset_signals, review_score): series that look cumulative.

    A year of a series and dims with 6 or more values is monotonic if at least 0.9 of its steps do not fall and its last
    value tops its first; a year of a series is if 0.8 of its dims are. A reset is a year that opens below 0.4 of the
    positive close of the year before, counted for the dims that has most. Kept are series with 3 monotonic years and a
    share of 0.6, or 2 monotonic years and 2 resets.
    """
    rows = obs.where("value is not null").withColumn("year", F.year("date"))
    order = W.partitionBy("series_id", "dims", "year").orderBy("date")
    step = rows.withColumn("step", F.col("value") - F.lag("value").over(order))
    years = step.groupBy("series_id", "dims", "year").agg(
        F.count("*").alias("n"), F.avg((F.col("step") >= 0).cast("double")).alias("ratio"), F.min_by("value", "date").alias("first"), F.max_by("value", "date").alias("last")
    )
    nxt = W.partitionBy("series_id", "dims").orderBy("year")
    reset = (F.lead("year").over(nxt) == F.col("year") + 1) & (F.col("last") > 0) & (F.lead("first").over(nxt) < 0.4 * F.col("last"))
    years = years.withColumn("reset", F.coalesce(reset, F.lit(False)).cast("int"))
    resets = years.groupBy("series_id", "dims").agg(F.sum("reset").alias("resets")).groupBy("series_id").agg(F.max("resets").alias("reset_signals"))
    full = years.where("n >= 6").withColumn("mono", ((F.col("ratio") >= 0.9) & (F.col("last") > F.col("first"))).cast("double"))
    by_year = full.groupBy("series_id", "year").agg(F.avg("mono").alias("dim_share"), F.avg("ratio").alias("ratio"), F.max("ratio").alias("top"))
    out = by_year.groupBy("series_id").agg(
        F.count("*").alias("reviewed_years"), F.sum((F.col("dim_share") >= 0.8).cast("long")).alias("monotonic_years"), F.avg("dim_share").alias("avg_monotonic_dim_share"),
        F.avg("ratio").alias("avg_nonnegative_ratio"), F.max("top").alias("max_nonnegative_ratio"),
    )
    out = out.withColumn("monotonic_share", F.col("monotonic_years") / F.col("reviewed_years")).join(resets, "series_id", "left").fillna(0, ["reset_signals"])
    out = out.where("(monotonic_years >= 3 and monotonic_share >= 0.6) or (monotonic_years >= 2 and reset_signals >= 2)")
    score = 2 * F.col("monotonic_share") + F.col("avg_monotonic_dim_share") + F.col("avg_nonnegative_ratio") + F.col("reset_signals")
    return out.withColumn("review_score", score).select(
        "series_id", "reviewed_years", "monotonic_years", "monotonic_share", "avg_monotonic_dim_share", "avg_nonnegative_ratio", "max_nonnegative_ratio", "reset_signals", "review_score"
    )
