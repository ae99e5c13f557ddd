"""Turning points and cycles: smoothing, strict local extrema, alternation, drawdown and phase, for all series at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ["series_id", "dims"]
LEAST_ROWS = 6


def smoothed(obs: DataFrame, window: int = 3, keys: list[str] = KEYS) -> DataFrame:
    """``obs`` without null values, with the row number ``i`` from 0, the count ``n`` and ``smooth``: a centred mean whose missing neighbours count as 0.

    Series shorter than the window stay as they are.
    """
    order = W.partitionBy(*keys).orderBy("date")
    rows = obs.where("value is not null").withColumns({"i": F.row_number().over(order) - 1, "n": F.count("*").over(W.partitionBy(*keys))})
    if window <= 1:
        return rows.withColumn("smooth", F.col("value"))
    mean = F.sum("value").over(order.rowsBetween(-(window // 2), (window - 1) // 2)) / window
    return rows.withColumn("smooth", F.when(F.col("n") >= window, mean).otherwise(F.col("value")))


def turning_points(obs: DataFrame, smoothing: int = 3, min_cycle: int = 4, keys: list[str] = KEYS) -> DataFrame:
    """(keys, date, i, n, kind, value): alternating peaks and troughs of series with six rows or more; value is the raw one.

    A turning point is the only largest, or smallest, smoothed value within max(2, min_cycle // 2) rows on either side. Of
    neighbours of one kind the most extreme raw value stays, the earlier one of equals.
    """
    reach = max(2, min_cycle // 2)
    order = W.partitionBy(*keys).orderBy("i")
    near = F.collect_list("smooth").over(order.rowsBetween(-reach, reach))
    rows = smoothed(obs, smoothing, keys).withColumn("near", near)
    inside = (F.col("i") >= reach) & (F.col("i") < F.col("n") - reach) & (F.col("n") >= LEAST_ROWS)
    alone = F.size(F.filter("near", lambda x: x == F.col("smooth"))) == 1
    kind = F.when(F.col("smooth") == F.array_max("near"), "peak").when(F.col("smooth") == F.array_min("near"), "trough")
    found = rows.where(inside & alone).withColumn("kind", kind).where("kind is not null").drop("near")
    found = found.withColumn("turn", (F.lag("kind").over(order).isNull() | (F.lag("kind").over(order) != F.col("kind"))).cast("int"))
    found = found.withColumn("run", F.sum("turn").over(order))
    extreme = F.when(F.col("kind") == "peak", F.col("value")).otherwise(-F.col("value"))
    best = found.groupBy(*keys, "run", "kind").agg(F.max_by(F.struct("date", "i", "n", "value"), F.struct(extreme.alias("x"), (-F.col("i")).alias("e"))).alias("p"))
    return best.select(*keys, "p.date", "p.i", "p.n", "kind", "p.value")


def drawdown(obs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, max_drawdown_pct): the largest fall, in percent, from a positive running peak; 0 without one."""
    peak = F.max("value").over(W.partitionBy(*keys).orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    rows = obs.where("value is not null").withColumn("peak", peak)
    fall = F.when(F.col("peak") > 0, (F.col("peak") - F.col("value")) / F.col("peak") * 100)
    return rows.groupBy(*keys).agg(F.greatest(F.coalesce(F.max(fall), F.lit(0.0)), F.lit(0.0)).alias("max_drawdown_pct"))


def phases(obs: DataFrame, smoothing: int = 3, min_cycle: int = 4, keys: list[str] = KEYS) -> DataFrame:
    """(keys, n, phase, duration, n_peaks, n_troughs, max_drawdown_pct) of series with six rows or more.

    After a trough comes an expansion, after a peak a contraction; without turning points the phase is ``none`` and as long as the series.
    """
    counts = obs.where("value is not null").groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_ROWS)
    last = turning_points(obs, smoothing, min_cycle, keys).groupBy(*keys).agg(
        F.max_by("kind", "i").alias("kind"), F.max("i").alias("i"), F.count_if(F.col("kind") == "peak").alias("n_peaks"), F.count_if(F.col("kind") == "trough").alias("n_troughs")
    )
    both = counts.join(last, keys, "left").join(drawdown(obs, keys), keys, "left")
    phase = F.when(F.col("kind") == "trough", "expansion").when(F.col("kind") == "peak", "contraction").otherwise("none")
    return both.select(*keys, "n", phase.alias("phase"), F.coalesce(F.col("n") - 1 - F.col("i"), F.col("n")).alias("duration"), F.coalesce("n_peaks", F.lit(0)).alias("n_peaks"), F.coalesce("n_troughs", F.lit(0)).alias("n_troughs"), "max_drawdown_pct")
