"""Data contracts: violations as one-pass aggregations, and guards that fail loudly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims as D
from ..schema import ACCUMULATIONS, FREQUENCIES, METHODS, NATURES, ContractError

KEY = ["series_id", "date", "dims"]


def require_columns(df: DataFrame, columns: list[str], context: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError("missing_columns", f"{context} lacks {missing}")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_rows) of the keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def _tally(df: DataFrame, rules: dict[str, Column], keys: list[str], repeated: str) -> DataFrame:
    """(rule, n_rows): rows that break each rule, and under ``repeated`` those beyond the first of their key. ``df`` is computed once: counts are taken by key and then added up."""
    by_key = df.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"_{k}") for k, c in rules.items()])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counts = by_key.agg(*[total(f"_{k}").alias(k) for k in rules], total(F.col("_n") - 1).alias(repeated))
    return counts.unpivot([], [*rules, repeated], "rule", "n_rows")


def blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(c) == "")


def observation_violations(obs: DataFrame) -> DataFrame:
    """(rule, n_rows) for observations: required and blank fields, domains, period bounds, dims, and duplicate keys."""
    require_columns(obs, ["series_id", "source", "date", "value", "freq", "unit", "dims"], "observations")
    rules = {
        "null_series_id": blank("series_id"),
        "null_source": blank("source"),
        "null_date": F.col("date").isNull(),
        "blank_unit": blank("unit"),
        "bad_freq": ~F.coalesce(F.col("freq").isin(*FREQUENCIES), F.lit(False)),
        "bad_dims": ~D.is_object(F.col("dims")),
        "nan_value": F.isnan("value"),
    }
    if {"period_start", "period_end"} <= set(obs.columns):
        rules["bad_period"] = (F.col("period_start") > F.col("period_end")) | (F.col("date") != F.col("period_end"))
    return _tally(obs, rules, KEY, "duplicate_key")


def series_violations(meta: DataFrame) -> DataFrame:
    """(rule, n_rows) for series metadata: unique ids, domains, and ``is_cumulative`` as ``accumulation`` says."""
    require_columns(meta, ["series_id", "accumulation", "is_cumulative", "nature", "alignment_override"], "series metadata")
    rules = {
        "null_series_id": blank("series_id"),
        "bad_accumulation": ~F.coalesce(F.col("accumulation").isin(*ACCUMULATIONS), F.lit(False)),
        "bad_nature": ~F.coalesce(F.col("nature").isin(*NATURES), F.lit(False)),
        "bad_override": F.col("alignment_override").isNotNull() & ~F.col("alignment_override").isin(*METHODS),
        "cumulative_mismatch": ~F.col("is_cumulative").eqNullSafe(F.col("accumulation") != "none"),
    }
    return _tally(meta, rules, ["series_id"], "duplicate_series")


def coverage_gaps(obs: DataFrame, meta: DataFrame) -> DataFrame:
    """(series_id, side): ids that only the facts or only the metadata have."""
    a, b = obs.select("series_id").distinct(), meta.select("series_id").distinct()
    return a.join(b, "series_id", "left_anti").withColumn("side", F.lit("facts_only")).unionByName(b.join(a, "series_id", "left_anti").withColumn("side", F.lit("metadata_only")))


def aligned_violations(aligned: DataFrame, meta: DataFrame) -> DataFrame:
    """(rule, n_rows) for aligned rows: all monthly, unique, and no accumulating series among them."""
    rules = {"not_monthly": ~F.coalesce(F.col("aligned_freq") == "M", F.lit(False)), "not_month_end": F.col("date") != F.last_day("date")}
    leaking = aligned.join(meta.where("accumulation <> 'none'").select("series_id").distinct(), "series_id", "left_semi").agg(F.count("*").alias("n_rows"))
    return _tally(aligned, rules, KEY, "duplicate_key").unionByName(leaking.select(F.lit("cumulative_leak").alias("rule"), "n_rows"))


def inconsistent_series(obs: DataFrame) -> DataFrame:
    """(series_id, n_variants): series with more than one source, frequency and unit, or a blank unit."""
    variants = F.count_distinct(F.struct("source", "freq", F.coalesce("unit", F.lit(""))))
    out = obs.groupBy("series_id").agg(variants.alias("n_variants"), F.max(blank("unit")).alias("has_blank_unit"))
    return out.where("n_variants > 1 or has_blank_unit")


def enforce(violations: DataFrame, context: str) -> None:
    """Raise if a violations table has any rows counted."""
    bad = [f"{r['rule']}={r['n_rows']}" for r in violations.where("n_rows > 0").collect()]  # one row for each rule
    if bad:
        raise ContractError("contract_violated", f"{context}: {', '.join(sorted(bad))}")


def require_reviewed(meta: DataFrame, ids: list[str], context: str) -> None:
    """Raise unless every id is a reviewed series."""
    reviewed = {r["series_id"] for r in meta.where(F.col("series_id").isin(ids) & F.col("nature_reviewed")).select("series_id").collect()}
    blocked = sorted(set(ids) - reviewed)
    if blocked:
        raise ContractError("not_reviewed", f"{context}: {blocked}")


def reviewed_only(obs: DataFrame, meta: DataFrame) -> DataFrame:
    """The observations of reviewed series."""
    return obs.join(meta.where("nature_reviewed").select("series_id").distinct(), "series_id", "left_semi")


def join_unique(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A many-to-one join; raises at run time where a key of ``right`` repeats."""
    n = F.count("*").over(_by(on))
    checked = right.withColumn("_n", n).withColumn(on[0], F.when(F.col("_n") == 1, F.col(on[0])).otherwise(F.raise_error(F.lit(f"right side repeats {on}")).cast(right.schema[on[0]].dataType))).drop("_n")
    return left.join(checked, on, how)


def _by(on: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*on)
