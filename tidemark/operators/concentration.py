"""Concentration of a metric over entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import dot_tail_share, inline_number
from .ranges import by_range, numbered


def at_month(df: DataFrame, month: str | None, date: str = "date") -> DataFrame:
    """The rows of a month ``YYYY-MM``, or of the table's last date."""
    if month:
        start = F.lit(f"{month}-01").cast("date")
        return df.where((F.col(date) >= start) & (F.col(date) < F.add_months(start, 1)))
    return df.where(F.col(date) == df.agg(F.max(date)).scalar())


def entity_sums(df: DataFrame, entity: Column, metric: str) -> DataFrame:
    """(entity, value): positive sums of the metric."""
    return df.groupBy(entity.alias("entity")).agg(F.sum(metric).alias("value")).where("value > 0")


def ranked(sums: DataFrame) -> DataFrame:
    """(entity, value, share_pct, rank, cumulative_pct) by falling value; entities come in ranges, each ranked in its own task."""
    order = [F.desc("value"), "entity"]
    parts = by_range(sums.select("entity", "value"), order)
    out = numbered(parts, order, number="rank", sums={"upto": "value"})
    total = parts.agg(F.sum("value")).scalar()
    return out.select("entity", "value", (F.col("value") / total * 100).alias("share_pct"), F.col("rank").cast("int").alias("rank"), (F.col("upto") / total * 100).alias("cumulative_pct"))


def indices(sums: DataFrame) -> DataFrame:
    """(n_entities, total, cr3_pct, cr5_pct, hhi, level): the shares of the top three and five, and the sum of squared shares."""
    most = sums.orderBy(F.desc("value"), "entity").limit(5).agg(F.sort_array(F.collect_list("value"), False).alias("vs"))  # five rows
    first = lambda k: F.aggregate(F.slice("vs", 1, k), F.lit(0.0), lambda a, x: a + x)
    most = most.select(F.struct(*[first(k).alias(f"top_{k}") for k in (3, 5)])).scalar()
    top = lambda k: most[f"top_{k}"]
    out = sums.agg(F.count("*").alias("n_entities"), F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares"))
    out = out.select(
        "n_entities", "total", (top(3) / F.col("total") * 100).alias("cr3_pct"), (top(5) / F.col("total") * 100).alias("cr5_pct"), (F.col("squares") / F.col("total") / F.col("total") * 10_000).alias("hhi")
    )
    return out.withColumn("level", F.when(F.col("hhi") > 2500, "high").when(F.col("hhi") >= 1500, "moderate").otherwise("low"))


def inline_items(rows: DataFrame, entity: str, value: str) -> DataFrame:
    """(entity, value) of a user's text columns: numbers read by the column's notation, what is not positive left out, equal entities summed."""
    share = rows.agg(dot_tail_share(F.col(value))).scalar()
    read = rows.withColumn("_share", share).select(F.trim(entity).alias("entity"), inline_number(F.col(value), F.col("_share")).alias("value"))
    return read.where("entity <> '' and value > 0").groupBy("entity").agg(F.sum("value").alias("value"))
