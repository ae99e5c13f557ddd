"""What a series measures, and how that lets it be aggregated."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ACCUMULATIONS, METHODS

# What the nature of a series implies.
METHOD_OF = {"stock": "last", "flow": "sum", "rate": "mean", "price": "mean"}
RATE_UNITS = ["%", "YÜZDE", "YUZDE", "ORAN", "PUAN"]
CUMULATIVE = "KÜMÜLATİF"


def official_nature(unit: Column, aggregation: Column) -> Column:
    """The nature that exactly one official signal gives: a rate's unit or a cumulative aggregation; else ``unclassified``."""
    rate = F.coalesce(F.upper(F.trim(unit)).isin(RATE_UNITS), F.lit(False))
    flow = F.coalesce(F.upper(F.trim(aggregation)) == CUMULATIVE, F.lit(False))
    return F.when(rate & ~flow, "rate").when(flow & ~rate, "flow").otherwise("unclassified")


def method_of(nature: Column, override: Column) -> Column:
    """last, sum or mean: a valid override, else what the nature implies, else null."""
    implied = F.when(nature == "stock", "last").when(nature == "flow", "sum").when(nature.isin("rate", "price"), "mean")
    return F.when(override.isNotNull(), F.when(override.isin(*METHODS), override)).otherwise(implied)


def alignment_method(nature: Column, override: Column, accumulation: Column) -> Column:
    """As ``method_of``, but the last value for anything that accumulates; raises where no method follows."""
    bad = F.raise_error(F.concat(F.lit("no alignment method for nature "), F.coalesce(nature, F.lit("null")), F.lit(", override "), F.coalesce(override, F.lit("null"))))
    return F.when(F.coalesce(accumulation, F.lit("none")) != "none", F.lit("last")).otherwise(F.coalesce(method_of(nature, override), bad.cast("string")))


def display_policy(policy: Column, nature: Column) -> Column:
    """The policy to show: the recorded one, else the one that the nature implies, else last."""
    implied = F.when(nature == "flow", "sum").when(nature.isin("rate", "index"), "mean").otherwise("last")
    return F.coalesce(F.nullif(policy, F.lit("")), implied)


#: Rules that are sent to all tasks for a look-up; more of them are joined without.
BROADCAST_RULES = 100_000
#: What a rule may ask of a series, besides its source.
ASKED = ("category", "series_id", "id_suffix", "accumulates")


@dataclass(frozen=True)
class RuleIndex:
    """Rules compiled into look-ups: one for each set of things that rules ask, keyed by their values.

    A suffix is asked by its length, so that it is a key like any other: every look-up is an equi-join, and no series meets
    a rule that does not fit it.
    """

    rules: DataFrame
    shapes: list[tuple[tuple[str, ...], int]]
    small: bool

    @classmethod
    def of(cls, rules: DataFrame) -> "RuleIndex":
        """rules: priority, source, category, series_id, id_suffix, accumulates (null asks nothing), nature, override."""
        shape = [F.col(c).isNotNull().alias(c) for c in ASKED]
        found = rules.groupBy(*shape, F.coalesce(F.length("id_suffix"), F.lit(0)).alias("length")).agg(F.count("*").alias("n")).collect()  # a row for each shape
        return cls(rules, sorted((tuple(c for c in ASKED if r[c]), r["length"]) for r in found), sum(r["n"] for r in found) <= BROADCAST_RULES)

    def look_up(self, series: DataFrame) -> DataFrame:
        """``series`` (series_id, source, category, accumulation) with ``rule``: (priority, nature, override) of the fitting rule with the smallest priority, or null.

        Equal priorities go by nature, then override.
        """
        out, found = series, []
        for k, (asked, length) in enumerate(self.shapes):
            fits = F.lit(True)
            for c in ASKED:
                fits = fits & (F.col(c).isNotNull() if c in asked else F.col(c).isNull())
            if "id_suffix" in asked:
                fits = fits & (F.length("id_suffix") == length)
            own = {"category": F.trim("category"), "series_id": F.col("series_id"), "id_suffix": F.right("series_id", F.lit(length)), "accumulates": F.coalesce("accumulation", F.lit("none")) != "none"}
            keys = ["source", *asked]
            best = self.rules.where(fits).groupBy(*keys).agg(F.min(F.struct("priority", "nature", "override")).alias(f"_rule{k}"))
            best = best.select(*[F.col(c).alias(f"_{k}_{c}") for c in keys], f"_rule{k}")
            asking = {c: own[c] if c != "source" else F.col("source") for c in keys}
            out = out.withColumns({f"_ask{k}_{c}": v for c, v in asking.items()})
            on = [F.col(f"_ask{k}_{c}") == F.col(f"_{k}_{c}") for c in keys]
            out = out.join(F.broadcast(best) if self.small else best, on, "left").drop(*[f"_{k}_{c}" for c in keys], *[f"_ask{k}_{c}" for c in keys])
            found.append(f"_rule{k}")
        none = F.lit(None).cast("struct<priority:int,nature:string,override:string>")
        rule = F.array_min(F.filter(F.array(*found), lambda r: r.isNotNull())) if found else none
        return out.withColumn("rule", rule).drop(*found)


def classified(series: DataFrame, rules: DataFrame | RuleIndex) -> DataFrame:
    """``series`` with ``nature`` and ``alignment_override`` from the fitting rule with the smallest priority, else unclassified."""
    index = rules if isinstance(rules, RuleIndex) else RuleIndex.of(rules)
    out = index.look_up(series.drop("nature", "alignment_override"))
    return out.withColumns({"nature": F.coalesce("rule.nature", F.lit("unclassified")), "alignment_override": F.col("rule.override")}).drop("rule")


def with_accumulation(series: DataFrame, registry: DataFrame) -> DataFrame:
    """``series`` with ``accumulation`` and ``is_cumulative`` from a registry (series_id, accumulation); what is not in it does not accumulate."""
    known = registry.groupBy(F.col("series_id").alias("_id")).agg(F.max("accumulation").alias("_kind"), F.count_distinct("accumulation").alias("_n"))
    kind = F.when(F.col("_n") == 1, F.col("_kind")).otherwise(F.raise_error(F.concat(F.lit("the registry has several accumulations of "), F.col("_id"))).cast("string"))
    kind = F.when(F.col("_id").isNotNull(), F.when(F.col("_kind").isin(*ACCUMULATIONS), kind).otherwise(F.raise_error(F.concat(F.lit("unknown accumulation "), F.col("_kind"))).cast("string"))).otherwise("none")
    out = series.drop("accumulation", "is_cumulative").join(known, F.col("series_id") == F.col("_id"), "left").withColumn("accumulation", kind)
    return out.withColumn("is_cumulative", F.col("accumulation") != "none").drop("_id", "_kind", "_n")
