"""Data health: coverage of the calendar, missing values, scores, completeness and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import expected_periods


def score(n: Column, missing_pct: Column) -> Column:
    """From 0 to 100: 1.5 points off for each percent that is missing, 10 for fewer than five observations; 0 without any."""
    raw = 100 - missing_pct * 1.5 - F.when(n < 5, 10.0).otherwise(0.0)
    return F.when(n == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 1))


def status(points: Column) -> Column:
    return F.when(points >= 90, "EXCELLENT").when(points >= 75, "GOOD").when(points >= 50, "FAIR").otherwise("WARNING")


def assessed(spans: DataFrame) -> DataFrame:
    """Spans (n_obs, n_null, first_date, last_date, freq) with expected periods, what is missing, score and status.

    Calendar gaps and null values are added up; without a known frequency only nulls count.
    """
    expected = expected_periods(F.col("first_date"), F.col("last_date"), F.col("freq"))
    out = spans.withColumn("expected", expected)
    gaps = F.greatest(F.col("expected") - F.col("n_obs"), F.lit(0))
    slots = F.when(F.col("expected").isNull(), F.col("n_obs")).otherwise(F.greatest("expected", "n_obs"))
    out = out.withColumn("missing", F.coalesce(gaps, F.lit(0)) + F.col("n_null"))
    out = out.withColumn("missing_pct", F.coalesce(F.round(F.try_divide(F.col("missing") * 100.0, slots), 2), F.lit(0.0)))
    out = out.withColumn("health_score", score(F.col("n_obs"), F.col("missing_pct")))
    return out.withColumn("health_status", status(F.col("health_score")))


def spans(obs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_obs, n_null, first_date, last_date, freq), null and NaN alike."""
    missing = F.col("value").isNull() | F.isnan("value")
    return obs.groupBy(*keys).agg(F.count("*").alias("n_obs"), F.count_if(missing).alias("n_null"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max("freq").alias("freq"))


def series_health(obs: DataFrame, per_dims: bool = False) -> DataFrame:
    """Health of each series, all its dims counted together, or of each series and dims."""
    return assessed(spans(obs, ["series_id", "dims"] if per_dims else ["series_id"]))


def column_health(df: DataFrame, columns: list[str], date: str = "date") -> DataFrame:
    """Health of each column of a wide table by nulls alone, in one pass; calendar gaps do not count."""
    missing = lambda c: F.count_if(F.col(c).isNull() | F.isnan(c))
    wide = df.agg(F.count("*").alias("n_obs"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), *[missing(c).alias(c) for c in columns])
    long = wide.unpivot(["n_obs", "first_date", "last_date"], columns, "column_name", "n_null")
    return assessed(long.withColumn("freq", F.lit(None).cast("string")))


def completeness(obs: DataFrame) -> DataFrame:
    """(series_id, total, valid, completeness_pct, first_date, last_date, first_valid, last_valid, late_start, status)."""
    good = F.col("value").isNotNull() & ~F.isnan("value")
    out = obs.groupBy("series_id").agg(
        F.count("*").alias("total"), F.count_if(good).alias("valid"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.min(F.when(good, F.col("date"))).alias("first_valid"), F.max(F.when(good, F.col("date"))).alias("last_valid")
    )
    share = F.round(F.try_divide(F.col("valid") * 100.0, F.col("total")), 2)
    band = F.when(share == 100, "complete").when(share >= 90, "good").when(share >= 70, "partial").otherwise("sparse")
    return out.withColumns({"completeness_pct": share, "late_start": F.coalesce(F.col("first_valid") > F.col("first_date"), F.lit(True)), "status": band})


def series_summary(obs: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """(series_id, n_obs, first_date, first_value, last_date, last_value) of valid observations, with the metadata if given."""
    good = obs.where(F.col("value").isNotNull() & ~F.isnan("value"))
    out = good.groupBy("series_id").agg(F.count("*").alias("n_obs"), F.min("date").alias("first_date"), F.min_by("value", "date").alias("first_value"), F.max("date").alias("last_date"), F.max_by("value", "date").alias("last_value"))
    return meta.join(out, "series_id", "left") if meta is not None else out


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n, min, max, mean) of numeric columns, in one pass over the table."""
    stats = {"n": F.count, "min": F.min, "max": F.max, "mean": F.avg}
    wide = df.agg(*[F.struct(*[f(F.col(c).cast("double")).cast("double").alias(k) for k, f in stats.items()]).alias(c) for c in columns])
    return wide.unpivot([], columns, "column_name", "s").select("column_name", *[f"s.{k}" for k in stats])
