"""Gold tables: wide slices, ratios, geography, period changes, with guards and generated lineage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims as D
from ..schema import LINEAGE, ContractError
from . import change
from .contracts import require_reviewed, reviewed_only


@dataclass(frozen=True)
class Slice:
    """A column of a wide table: a series, and the value (None: absent) of one of its dims."""

    series_id: str
    key: str | None = None
    value: str | None = None
    unit: str | None = None

    def where(self) -> Column:
        return (F.col("series_id") == self.series_id) & D.matches(F.col("dims"), self.key, self.value)


def wide(obs: DataFrame, slices: dict[str, Slice], meta: DataFrame | None = None, context: str = "wide") -> DataFrame:
    """(date, a column for each slice): one conditional aggregation over the rows of any slice.

    It holds the dates that a chain of full outer joins would. Raises where a slice has more than one row on a date, as
    its rows are computed, and for series that are not reviewed if ``meta`` is given.
    """
    if meta is not None:
        require_reviewed(meta, sorted({s.series_id for s in slices.values()}), context)
    tests = {name: s.where() for name, s in slices.items()}
    some = None
    for t in tests.values():
        some = t if some is None else some | t
    columns = []
    for name, t in tests.items():
        fail = F.raise_error(F.lit(f"slice {name} has more than one row on a date")).cast("double")
        columns.append(F.when(F.count_if(t) <= 1, F.max(F.when(t, F.col("value")))).otherwise(fail).alias(name))
    out = obs.where(some).groupBy("date").agg(*columns)
    for name, s in slices.items():
        if s.unit:
            out = out.withMetadata(name, {"unit": s.unit})
    return out


def wide_by_joins(obs: DataFrame, slices: dict[str, Slice]) -> DataFrame:
    """The same table as a chain of full outer joins, for slices that come from different tables."""
    out = None
    for name, s in slices.items():
        one = obs.where(s.where()).select("date", F.col("value").alias(name))
        out = one if out is None else out.join(one, "date", "full_outer")
    return out


def lineage(spark, table: str, slices: dict[str, Slice], transformation: str = "slice") -> DataFrame:
    """Lineage rows of a wide table, made from its slices so that they cannot drift from them."""
    rule = lambda s: None if s.key is None else f"{s.key} is null" if s.value is None else f"{s.key} = {s.value}"
    return spark.createDataFrame([(table, c, s.series_id, rule(s), transformation, s.unit) for c, s in slices.items()], LINEAGE)


def ratio_daily(a: DataFrame, b: DataFrame, name_a: str, name_b: str) -> DataFrame:
    """(date, a, b, ratio) of two series (date, value) on common days."""
    both = a.select("date", F.col("value").alias(name_a)).join(b.select("date", F.col("value").alias(name_b)), "date")
    return both.withColumn("ratio", F.try_divide(F.col(name_a), F.col(name_b)))


def ratio_monthly(daily: DataFrame, names: list[str]) -> DataFrame:
    """Month-end means of a daily table's columns and of its *ratios*, each with its change to the month before; empty months stand as nulls."""
    means = daily.groupBy(F.last_day("date").alias("date")).agg(*[F.avg(c).alias(c) for c in [*names, "ratio"]])
    ends = means.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    months = ends.select(F.explode(F.sequence(F.trunc("lo", "MM"), F.trunc("hi", "MM"), F.expr("interval 1 month"))).alias("m")).select(F.last_day("m").alias("date"))
    out = months.join(means, "date", "left")
    from pyspark.sql import Window

    order = Window.orderBy("date")  # a row for each month
    return out.withColumns({f"{c}_change": F.try_divide(F.col(c) - F.lag(c).over(order), F.lag(c).over(order)) for c in [*names, "ratio"]})


def geo_quality(obs: DataFrame, keys: dict[str, str], good: str, bad: str) -> DataFrame:
    """(date, the dims named by ``keys``, good, bad, bad_ratio): the last non-null value of two series by date and place.

    Rows without a place key stay: they are places that the key does not name. The ratio is bad over all.
    """
    places = [D.get(F.col("dims"), k).alias(name) for name, k in keys.items()]
    rows = obs.where(F.col("series_id").isin(good, bad) & F.col("value").isNotNull()).select("date", *places, "series_id", "value", F.col("period_end" if "period_end" in obs.columns else "date").alias("_at"))
    out = rows.groupBy("date", *keys).agg(*[F.max_by("value", F.when(F.col("series_id") == s, F.struct("_at", "value"))).alias(n) for n, s in (("good", good), ("bad", bad))])
    return out.withColumn("bad_ratio", F.try_divide(F.col("bad"), F.col("good") + F.col("bad")))


def with_change(table: DataFrame, changes: DataFrame, keys: tuple[str, ...] = ("series_id", "dims", "date"), columns: tuple[str, ...] = ("mom_pct", "yoy_pct")) -> DataFrame:
    """A gold table's rows, each with its own periodic changes; nulls where it has none. Keys join as they stand, nulls included."""
    c = changes.select(*[F.col(k).alias(f"_{k}") for k in keys], *[x for x in columns if x in changes.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return table.join(c, on, "left").drop(*[f"_{k}" for k in keys])


def lineage_of(slices: DataFrame, table: str, transformation: str = "slice") -> DataFrame:
    """Lineage rows of a table whose columns stand as rows (gold_column, series_id, key, value, unit): no spec has to fit the driver."""
    rule = F.when(F.col("key").isNotNull(), F.when(F.col("value").isNull(), F.concat("key", F.lit(" is null"))).otherwise(F.concat("key", F.lit(" = "), "value")))
    return slices.select(F.lit(table).alias("gold_table"), "gold_column", F.col("series_id").alias("source_series"), rule.alias("source_filter"), F.lit(transformation).alias("transformation"), "unit")


def periodic_change(aligned: DataFrame, meta: DataFrame) -> DataFrame:
    """Gap-aware changes of the reviewed series."""
    return change.periodic(reviewed_only(aligned, meta))


def build_all(steps: dict, context: dict) -> dict[str, DataFrame]:
    """Gold tables in the order of ``steps`` (name: function of the tables so far); a failing step names itself."""
    tables = dict(context)
    for name, step in steps.items():
        try:
            tables[name] = step(tables)
        except ContractError as e:
            raise ContractError(e.code, f"{name}: {e}") from e
    return tables
