"""Connected components of a link table, as rounds of joins and aggregations (large-star and small-star)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One round: every node hands its neighbours (the larger ones, or the smaller and itself) to its smallest neighbour.

    Links stand as (u, v) with u > v. Minima are aggregated before the join, so a hub's neighbours never meet in a group.
    """
    if large:
        both = links.select(F.col("u").alias("n"), F.col("v").alias("m")).union(links.select(F.col("v").alias("n"), F.col("u").alias("m")))
    else:
        both = links.select(F.col("u").alias("n"), F.col("v").alias("m"))
    least = both.groupBy("n").agg(F.min("m").alias("lo")).select(F.col("n").alias("k"), F.least("n", "lo").alias("lo"))
    met = both.join(least, both["n"] == least["k"])
    if large:
        out = met.where(F.col("m") > F.col("n")).select(F.col("m").alias("u"), F.col("lo").alias("v"))
    else:
        out = met.select(F.col("m").alias("u"), F.col("lo").alias("v")).union(least.select(F.col("k").alias("u"), F.col("lo").alias("v")))
    return out.where("u > v").distinct()


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label``, by node, after the links (i, j): the smallest one of each group that they join."""
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def _joined(links: DataFrame) -> DataFrame:
    """(node, root) of few long links (u, v), in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
        if held:
            u, v = (np.concatenate(x) for x in zip(*held))
            nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
            label = merged(np.arange(len(nodes)), place[: len(u)], place[len(u) :])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "root"])

    return written(links.coalesce(1).mapInArrow(run, "node long, root long"), "roots")


def connected_components(links: DataFrame, max_rounds: int = 40, few: int = 0) -> DataFrame:
    """(node, root) for every node that has a link: root is the smallest node that can be reached.

    links: two columns of one orderable type; direction, repeats and self links do not matter, nulls are left out.
    Rounds grow with the logarithm of the longest chain; each is written to the shared folder. The loop ends when a round
    changes nothing, so that links then form stars; it raises rather than return half-merged components. Once no more than
    ``few`` links are left, of longs, one pass over them ends it: a round has some ten shuffles, which do not pay for so little.
    """
    a, b = links.columns
    now = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v")
    if few and links.count() <= few:
        return _joined(now)
    now = written(now.distinct(), "links")
    digest = None
    for _ in range(max_rounds):
        if few and (digest[0] if digest else now.count()) <= few:
            nodes = _joined(now)
            forget(now)
            return nodes
        last, now = now, written(_star(_star(now, True), False), "links")
        forget(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == digest:
            nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        digest = tuple(state)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
