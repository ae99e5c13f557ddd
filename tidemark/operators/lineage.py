"""What tables and columns are built from, over any number of levels, and what that says of their health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .health import status


def ancestors(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, source, steps): all that each node of ``edges`` (node, source) is built from, with the fewest steps to it.

    Each round joins the pairs that the last one found with the edges and keeps what is new, so that a cycle ends it too;
    then a node is among its own sources. Repeated edges do not matter, and those with a null end are left out.
    """
    edges = written(edges.select("node", "source").where("node is not null and source is not null").distinct(), "edges")
    found = [edges.withColumn("steps", F.lit(1))]
    last, seen = found[0], found[0]
    for step in range(2, max_rounds + 2):
        further = last.select("node", F.col("source").alias("via")).join(edges.select(F.col("node").alias("via"), "source"), "via").select("node", "source").distinct()
        last = written(further.join(seen.select("node", "source"), ["node", "source"], "left_anti").withColumn("steps", F.lit(step)), "reached")
        if last.limit(1).count() == 0:
            return seen
        found.append(last)
        seen = seen.unionByName(last)
    raise RuntimeError(f"lineage is over {max_rounds} levels deep")


def origins(edges: DataFrame) -> DataFrame:
    """(node, source, steps): the sources of each node that are built from nothing themselves."""
    inner = edges.where("source is not null").select(F.col("node").alias("source")).distinct()
    return ancestors(edges).join(inner, "source", "left_anti").select("node", "source", "steps")


def health_by_lineage(edges: DataFrame, health: DataFrame) -> DataFrame:
    """(node, n_sources, n_unknown, steps, worst_source, health_score, health_status): each node has the grade of its worst origin.

    health: source, health_score. An origin that ``health`` does not know counts as 0; of equal scores the smallest name is
    the worst. ``steps`` is the longest of the shortest ways to an origin.
    """
    met = origins(edges).join(health.select("source", "health_score"), "source", "left").withColumn("score", F.coalesce("health_score", F.lit(0.0)))
    out = met.groupBy("node").agg(
        F.count("*").alias("n_sources"), F.count_if(F.col("health_score").isNull()).alias("n_unknown"), F.max("steps").alias("steps"), F.min(F.struct("score", "source")).alias("worst")
    )
    out = out.select("node", "n_sources", "n_unknown", "steps", F.col("worst.source").alias("worst_source"), F.col("worst.score").alias("health_score"))
    return out.withColumn("health_status", status(F.col("health_score")))


def gold_edges(evidence: DataFrame) -> DataFrame:
    """(node, source) of a lineage table: each gold table is built from its columns, and each column from its series."""
    column = F.concat_ws(".", "gold_table", "gold_column")
    own = evidence.select(column.alias("node"), F.col("source_series").alias("source"))
    return own.unionByName(evidence.select(F.col("gold_table").alias("node"), column.alias("source")))
