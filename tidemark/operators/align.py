"""Alignment of series to a common frequency, by what each series measures; nothing is invented."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates as T
from ..functions import dims as D
from ..functions.nature import alignment_method
from ..schema import ContractError
from ..sources.scratch import written
from .contracts import duplicate_keys, require_columns

RANK = {"D": 0, "W": 1, "M": 2, "Q": 3, "Y": 4}
_OUT = ["series_id", "source", "date", "value", "unit", "dims", "source_freq", "aligned_freq", "alignment_method", "is_imputed"]


def aggregate(value: Column, date: Column, method: Column) -> Column:
    """Aggregate of a period: the last, the sum or the mean of its non-null values; null if it has none."""
    v = F.when(~F.isnan(value), value)
    last = F.max_by(v, F.when(v.isNotNull(), date))
    return F.when(F.first(method) == "sum", F.sum(v)).when(F.first(method) == "mean", F.avg(v)).when(F.first(method) == "last", last)


def to_month_end(obs: DataFrame) -> DataFrame:
    """Daily or weekly rows (with ``method``) to one row a month: the first row's source and unit, the method's value."""
    first = lambda c: F.min_by(c, "date").alias(c)
    out = obs.groupBy("series_id", "dims", F.last_day("date").alias("month")).agg(
        first("source"), first("unit"), first("freq"), aggregate(F.col("value"), F.col("date"), F.col("method")).alias("value"), F.first("method").alias("alignment_method")
    )
    return out.select("series_id", "source", F.col("month").alias("date"), "value", "unit", "dims", F.col("freq").alias("source_freq"), F.lit("M").alias("aligned_freq"), "alignment_method", F.lit(False).alias("is_imputed"))


def native_month(obs: DataFrame, method: str = "native") -> DataFrame:
    """Monthly (``native``) or quarterly (``quarter_end_sparse``) rows at their own month's end."""
    return obs.select("series_id", "source", F.last_day("date").alias("date"), "value", "unit", "dims", F.col("freq").alias("source_freq"), F.lit("M").alias("aligned_freq"), F.lit(method).alias("alignment_method"), F.lit(False).alias("is_imputed"))


def quarter_fill(obs: DataFrame) -> DataFrame:
    """Quarterly rows on every month from the first to the last one, the last value carried on and marked as imputed."""
    own = native_month(obs, "quarter_ffill")
    ends = own.groupBy("series_id", "dims").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    spine = ends.select("series_id", "dims", F.explode(T.month_ends(F.col("lo"), F.col("hi"))).alias("date"))
    both = spine.join(own, ["series_id", "dims", "date"], "left")
    upto = W.partitionBy("series_id", "dims").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    carried = {c: F.last(c, ignorenulls=True).over(upto) for c in ("value", "source", "unit", "source_freq", "aligned_freq", "alignment_method")}
    return both.withColumn("is_imputed", F.col("value").isNull()).withColumns(carried).where("value is not null").select(*_OUT)


def monthly(obs: DataFrame, meta: DataFrame, quarterly: str = "sparse") -> DataFrame:
    """All series at month ends: days and weeks by their method, months as they are, quarters sparse or filled (``ffill``).

    Accumulating series are left out. Raises for a series and dims with more than one frequency, one without metadata, a
    frequency other than D, W, M, Q, or a result with duplicate keys; days and weeks of a series without a method raise
    when their rows are computed.
    """
    require_columns(obs, ["series_id", "source", "date", "value", "freq", "unit", "dims"], "observations")
    if quarterly not in ("sparse", "ffill"):
        raise ContractError("bad_policy", f"quarterly policy {quarterly!r}")
    policy = meta.select("series_id", "accumulation", *([c for c in ("nature", "alignment_override") if c in meta.columns]))
    for c in {"nature", "alignment_override"} - set(meta.columns):
        policy = policy.withColumn(c, F.lit(None).cast("string"))
    rows = obs.withColumn("dims", D.canonical(F.col("dims"))).join(policy.withColumn("known", F.lit(True)), "series_id", "left")
    faults = rows.groupBy("series_id", "dims").agg(F.count_distinct("freq").alias("n"), F.max(~F.coalesce(F.col("freq").isin("D", "W", "M", "Q"), F.lit(False))).alias("odd"), F.max(F.col("known").isNull()).alias("unknown"))
    fault = faults.where("n > 1 or odd or unknown").first()
    if fault:
        kind = "mixed_frequency" if fault["n"] > 1 else "unsupported_frequency" if fault["odd"] else "missing_policy"
        raise ContractError(kind, f"{fault['series_id']} {fault['dims']}")
    rows = rows.where("coalesce(accumulation, 'none') = 'none'")  # a series of unknown accumulation is taken as it stands
    days = rows.where("freq in ('D', 'W')").withColumn("method", alignment_method(F.col("nature"), F.col("alignment_override"), F.col("accumulation")))
    quarters = rows.where("freq = 'Q'")
    parts = [to_month_end(days), native_month(rows.where("freq = 'M'")), native_month(quarters, "quarter_end_sparse") if quarterly == "sparse" else quarter_fill(quarters)]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).select(*_OUT)
    out = written(out, "aligned")  # the layer is a table; the check below reads what was written
    if duplicate_keys(out, ["series_id", "date", "dims"]).first():
        raise ContractError("duplicate_key", "aligned rows repeat a series, date and dims")
    return out


def to_frequency(obs: DataFrame, freq: str, method: Column, keys: list[str] = ("series_id", "dims")) -> DataFrame:
    """(keys, date, value): rows of each key at the period dates of ``freq``, aggregated by ``method``."""
    rows = obs.withColumns({"period": T.period_date(F.col("date"), freq), "method": method})
    return rows.groupBy(*keys, F.col("period").alias("date_")).agg(aggregate(F.col("value"), F.col("date"), F.col("method")).alias("value")).withColumnRenamed("date_", "date")


def quarters_on_spine(series: DataFrame, target: str, policy: str) -> DataFrame:
    """A quarterly (date, value) series at a finer frequency: sparse, or carried on to every period up to its last one."""
    if policy != "ffill":
        return series
    step = {"D": "interval 1 day", "W": "interval 7 days", "M": "interval 1 month"}[target]
    ends = series.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = ends.select(F.explode(F.sequence(F.trunc("lo", "MM") if target == "M" else F.col("lo"), "hi", F.expr(step))).alias("day"))
    spine = days.select(T.period_date(F.col("day"), target).alias("date")).distinct()
    upto = W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)  # one series
    return spine.join(series, "date", "left").withColumn("value", F.last("value", ignorenulls=True).over(upto)).where("value is not null")


def pair(a: DataFrame, b: DataFrame, freq_a: str, freq_b: str, method_a: str, method_b: str, target: str | None = None, quarterly: str = "sparse") -> tuple[DataFrame, list[str]]:
    """((date, value_a, value_b), notes): two series (date, value) at the coarser of their frequencies or ``target``, on common periods.

    A series that is coarser than the target keeps its own dates, or with ``ffill`` is carried on.
    """
    goal = target or max(freq_a, freq_b, key=RANK.__getitem__)
    notes, sides = [f"target frequency {goal}"], []
    for name, df, freq, method in (("a", a, freq_a, method_a), ("b", b, freq_b, method_b)):
        if RANK[freq] < RANK[goal]:
            notes.append(f"series {name}: {freq} to {goal} by {method}")
        elif RANK[freq] > RANK[goal]:
            notes.append(f"series {name}: {freq} is coarser than {goal}, {quarterly}")
            df = quarters_on_spine(df, goal, quarterly)
        one = df.select("date", "value").withColumn("series", F.lit(name))
        sides.append(to_frequency(one, goal, F.lit(method), ["series"]).select("date", F.col("value").alias(f"value_{name}")))
    both = sides[0].join(sides[1], "date").where("value_a is not null and value_b is not null")
    return both.select("date", "value_a", "value_b"), notes


def build(canonical: DataFrame, meta: DataFrame, quarterly: str = "sparse") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(aligned, its series' metadata, rows and series by source, frequency and method); other frequencies are left out."""
    kept = canonical.where(F.col("freq").isin("D", "W", "M", "Q"))
    aligned = monthly(kept, meta, quarterly)
    subset = meta.join(aligned.select("series_id").distinct(), "series_id", "left_semi")
    audit = aligned.groupBy("source", "source_freq", "alignment_method").agg(F.count("*").alias("n_rows"), F.count_distinct("series_id").alias("n_series"))
    return aligned, subset, audit
