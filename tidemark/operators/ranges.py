"""Ranks and running sums over a whole table, and order statistics of large groups, without a task that sees them whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written

#: A group with over this share of all rows is hot: there are at most so many of them, and each one's result is broadcast.
HOT_SHARE = 10_000
#: Rows of a group under which it is never hot.
SMALL_GROUP = 100_000
#: Steps of the grid of approximate quantiles that narrows a group's middle down, and rows that are left to be counted one by one.
GRID = 64
FEW = 4096


def by_range(rows: DataFrame, order: list[str | Column], parts: int | None = None) -> DataFrame:
    """``rows``, written, with ``_part``: a range of ``order`` each, in ascending order. What shares all of ``order`` shares a part."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def numbered(rows: DataFrame, order: list[str | Column], keys: list[str] = (), part: str = "_part", number: str = "number", sums: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with ``number``, their place by ``order`` (from 1), and running sums (name: column), over each key or the whole table.

    Rows come in parts that follow each other in the order, as ``by_range`` or the splits of a file make them. A part is
    numbered on its own, and what the parts before it hold, one row for each, is added: no task sees more than a part.
    """
    sums = sums or {}
    tally = rows.groupBy(*keys, part).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_sum_{name}") for name, c in sums.items()])
    before = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)  # a row for each part
    offset = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    tally = tally.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col(part).alias("_of"), offset("_n").alias("_n"), *[offset(f"_sum_{n}").alias(f"_sum_{n}") for n in sums])
    on = (F.col(part) == F.col("_of")) if not keys else (F.col(part) == F.col("_of")) & _all([F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    within = W.partitionBy(*keys, part).orderBy(*order)
    out = rows.join(tally, on).withColumn(number, F.col("_n") + F.row_number().over(within))
    out = out.withColumns({name: F.col(f"_sum_{name}") + F.coalesce(F.sum(c).over(within.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)) for name, c in sums.items()})
    return out.drop("_of", "_n", *[f"_key_{k}" for k in keys], *[f"_sum_{n}" for n in sums])


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def hot_groups(rows: DataFrame, keys: list[str], small: int = SMALL_GROUP) -> DataFrame | None:
    """(keys, n) of the groups that hold over a ``HOT_SHARE``-th of the rows and over ``small`` of them, as a written table; None if there are none."""
    sizes = written(rows.groupBy(*keys).agg(F.count("*").alias("n")), "sizes")
    least = max(small, (sizes.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    hot = written(sizes.where(F.col("n") > least), "hot")
    return hot if hot.limit(1).count() else None


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """``rows`` joined with ``groups``, a row for each key: hot keys' rows stay where they are and get theirs by broadcast. Null keys meet each other."""
    renamed = lambda df: df.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in df.columns if c not in keys])
    on = _all([F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    tidy = lambda df: df.drop(*[f"_key_{k}" for k in keys])
    if hot is None:
        return tidy(rows.join(renamed(groups), on))
    names = F.broadcast(renamed(hot.select(*keys)))  # HOT_SHARE rows at most
    large = renamed(groups).join(names.select(*[F.col(f"_key_{k}").alias(f"_hot_{k}") for k in keys]), _all([F.col(f"_key_{k}").eqNullSafe(F.col(f"_hot_{k}")) for k in keys])).drop(*[f"_hot_{k}" for k in keys])
    return tidy(rows.join(F.broadcast(large), on)).unionByName(tidy(rows.join(names, on, "left_anti").join(renamed(groups), on)))


def medians(rows: DataFrame, keys: list[str], value: str, name: str = "median", hot: DataFrame | None = None, few: int = FEW) -> DataFrame:
    """(keys, ``name``): the exact median of each key's values, null ones left out; NaN counts as the largest.

    The groups in ``hot`` are narrowed down, all of them together: a grid of mergeable approximate quantiles gives a pivot
    near the two middle places and a bracket around it, exact counts say on which side of the pivot they lie, and that side's
    rows within the bracket go into the next round, until the places are the pivot's or ``few`` rows are left. Only these
    meet in a task. Each round loses its pivot, so that any values end it. The other groups are small.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    if hot is None:
        return rows.groupBy(*keys).agg(F.median("_v").alias(name))
    same = lambda a, b: _all([F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}")) for k in keys])
    renamed = lambda df: df.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in df.columns if c not in keys])
    names = F.broadcast(renamed(hot.select(*keys)))
    small = rows.join(names, same("", "_key_"), "left_anti").groupBy(*keys).agg(F.median("_v").alias(name))
    band = rows.join(names, same("", "_key_"), "left_semi")
    # The middle places count from 0; below: how many values lie under the band.
    state = band.groupBy(*keys).agg(F.count("*").alias("m")).select(*keys, F.floor((F.col("m") - 1) / 2).alias("first"), F.floor(F.col("m") / 2).alias("second"), F.lit(0).cast("long").alias("below"))
    state, done = written(state, "state"), None
    on_grid = lambda k: F.element_at("grid", k.cast("int") + 1)
    while True:
        shape = band.groupBy(*keys).agg(F.count("*").alias("inside"), F.percentile_approx("_v", [k / GRID for k in range(GRID + 1)], 20 * GRID).alias("grid"))
        met = written(state.join(renamed(shape), same("", "_key_")).drop(*[f"_key_{k}" for k in keys]), "met")
        ended = F.broadcast(renamed(met.where(F.col("inside") <= few).select(*keys, "first", "second", "below")))
        left = band.join(ended, same("", "_key_")).groupBy(*keys, "first", "second", "below").agg(F.sort_array(F.collect_list("_v")).alias("vs"))  # ``few`` values at most
        place = lambda c: F.get("vs", (F.col(c) - F.col("below")).cast("int"))
        part = left.select(*keys, ((place("first") + place("second")) / 2).alias(name))
        # A pivot near the middle, and two values a step or two of the grid around it.
        step = F.floor((F.col("first") - F.col("below")) / F.col("inside") * GRID)
        bracket = met.where(F.col("inside") > few).select(*keys, "first", "second", "below", on_grid(F.greatest(step - 1, F.lit(0))).alias("from"), on_grid(step).alias("pivot"), on_grid(F.least(step + 3, F.lit(GRID))).alias("to"))
        v, pivot = F.col("_v"), F.col("pivot")
        counts = band.join(F.broadcast(renamed(bracket)), same("", "_key_")).groupBy(*keys, "first", "second", "below", "from", "pivot", "to").agg(
            F.count_if(v < F.col("from")).alias("under"), F.count_if(v <= F.col("to")).alias("upto"), F.count_if(v < pivot).alias("less"), F.count_if(v <= pivot).alias("most"), F.max(F.when(v < pivot, v)).alias("lower"), F.min(F.when(v > pivot, v)).alias("higher")
        )
        a, b = F.col("first") - F.col("below"), F.col("second") - F.col("below")
        # Both places above the pivot, both under it, or at it: then they are it, or its neighbours.
        counts = written(counts.withColumn("side", F.when(a >= F.col("most"), "above").when(b < F.col("less"), "under").otherwise("at")), "counts")
        at = counts.where("side = 'at'").select(*keys, ((F.when(a >= F.col("less"), pivot).otherwise(F.col("lower")) + F.when(b < F.col("most"), pivot).otherwise(F.col("higher"))) / 2).alias(name))
        part = part.unionByName(at)
        done = written(part if done is None else done.unionByName(part), "medians")
        open_ = counts.where("side <> 'at'")
        if open_.limit(1).count() == 0:
            return small.unionByName(done)
        # The outer end of what is kept is the bracket's, if the exact counts say that it holds the places.
        sure = F.when(F.col("side") == "under", a >= F.col("under")).otherwise(b < F.col("upto"))
        below = F.col("below") + F.when(F.col("side") == "above", F.col("most")).when(sure, F.col("under")).otherwise(0)
        open_ = open_.select(*keys, "first", "second", below.alias("below"), "side", sure.alias("sure"), "from", "pivot", "to")
        kept = (F.col("side") == "above") & (v > pivot) & (~F.col("sure") | (v <= F.col("to"))) | (F.col("side") == "under") & (v < pivot) & (~F.col("sure") | (v >= F.col("from")))
        band = written(band.join(F.broadcast(renamed(open_)), same("", "_key_")).where(kept).select(*keys, "_v"), "band")
        state = open_.select(*keys, "first", "second", "below")


def grouped_medians(rows: DataFrame, keys: list[str], value: str, name: str = "median", small: int = SMALL_GROUP) -> tuple[DataFrame, DataFrame | None]:
    """(medians, the hot groups) of ``rows``, for ``with_groups``."""
    hot = hot_groups(rows, keys, small)
    return medians(rows, keys, value, name, hot), hot


