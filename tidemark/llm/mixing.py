"""Mixing sources to target weights by fitting subset sums to word budgets.

Documents are counted by exact length in words. Each source's budget is first spread over all lengths in proportion, which
keeps the mix like the source; a bounded-knapsack dynamic programme over the unused counts then fits what is left of the
budget to the word. How many documents of each length it takes is thereby known, and a seeded order says which.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, row_hash, text_or_empty, written

#: Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix, as a share of all words, and how often it may take a document.
SHARE = 1.5
MAX_COPIES = 2
#: Words of a budget that are left to the dynamic programme.
FITTED = 8192
#: Documents of one source and length that are put in order together.
ORDERED = 1024


def sized(docs: DataFrame, seed: int, carry: str | None = None) -> DataFrame:
    """(doc_id, source, size, draw): words of each text and its place in the seeded order; and the column ``carry``."""
    more = [carry] if carry else []
    out = docs.select("doc_id", F.col("source").cast("string").alias("source"), text_or_empty().alias("text"), *more)
    return out.select(*more, "doc_id", "source", F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).cast("long").alias("size"), row_hash("doc_id", "source", "text", seed=seed).alias("draw"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size) to (source, source_size, target), one row per source.

    Targets stand as the weights do but stop at ``max_copies`` times the source's size; what lies above is shared again by
    weight. In the order of the size that a unit of weight may take, sources are full until one has room for its share.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), "source"))  # one row per source
    ranked = sizes.select("source", "source_size", F.element_at(cycle, ((place - 1) % len(weights) + 1).cast("int")).alias("weight"))
    ranked = ranked.withColumn("most", F.lit(float(max_copies)) * F.col("source_size"))
    order = W.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    ranked = ranked.withColumn("left", F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("open", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    ranked = ranked.withColumn("level", F.col("left") / F.col("open"))
    room = F.col("most") / F.col("weight") > F.col("level")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).withColumn("rank", F.when(room, F.col("rank")))
    common = F.min_by("level", "rank").over(everything)  # of the first source with room: all after it share at this level
    return ranked.withColumn("common", common).select("source", "source_size", F.coalesce(F.least("most", F.col("weight") * F.col("common")), F.col("most")).alias("target"))


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int, fitted: int = FITTED) -> np.ndarray:
    """How many documents of each length to take so that their words come to ``budget``, or as near below as can be."""
    taken = np.zeros(len(sizes), np.int64)
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return taken
    order = np.argsort(-sizes)
    spread, want, got = max(0, budget - fitted) / total, 0.0, 0
    for i in order:
        want += float(sizes[i] * counts[i]) * spread
        taken[i] = min(int(counts[i]), max(0, int((want - got) // sizes[i])))
        got += int(taken[i] * sizes[i])
    room = budget - got
    pieces = []  # (index, copies): binary parts of the unused counts
    for i in order[::-1]:
        unused, part = min(int(counts[i] - taken[i]), room // int(sizes[i])), 1
        while unused > 0:
            part = min(part, unused)
            pieces.append((int(i), part))
            unused -= part
            part *= 2
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    by = np.full(room + 1, -1)  # the piece that first reached a sum; the sum without it needed earlier pieces only
    for p, (i, part) in enumerate(pieces):
        words = int(sizes[i]) * part
        new = np.flatnonzero(reached[: room + 1 - words] & ~reached[words:]) + words
        reached[new] = True
        by[new] = p
        if reached[room]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, part = pieces[by[at]]
        taken[i] += part
        at -= int(sizes[i]) * part
    return taken


def plan(sizes: DataFrame, goal: DataFrame, fitted: int = FITTED) -> DataFrame:
    """(source, size, n, whole, extra): of a source's n documents of a length, all go in ``whole`` times and ``extra`` once more.

    A group holds one row for each length of a source.
    """
    counted = sizes.groupBy("source", "size").agg(F.count("*").alias("n"))
    goal = goal.select(F.col("source").alias("of_source"), "source_size", "target")
    both = counted.join(goal, F.col("source").eqNullSafe(F.col("of_source"))).select("source", "size", "n", "source_size", "target")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        total, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        whole = int(target // total) if total else 0
        size, n = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
        extra = np.zeros(len(group), np.int64)
        some = size > 0
        extra[some] = fit_counts(size[some], n[some], round(target - whole * total), fitted)
        return pd.DataFrame({"source": group["source"], "size": size, "n": n, "whole": np.where(some, whole, 0), "extra": extra})

    return both.groupBy("source").applyInPandas(fit, "source string, size long, n long, whole long, extra long")


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES, seed: int = 5, carry: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source) for every row of ``docs`` (doc_id, source, text), and its column ``carry``.

    copies: how often the mix takes the document; taken: its words in the mix. A null text has size 0 and is not taken; a
    null source is a source, the last one. Sources without words have target 0. Equal rows are interchangeable. The same
    rows and seed give the same mix, however they are partitioned; documents that draw the same number stand by doc_id. Texts
    are only counted, however long. Columns but ``carry`` are not read; an empty table gives an empty one. max_copies is at least ``share``, or nothing could fit.
    """
    if max_copies < share:
        raise ValueError("sources cannot hold the mix: max_copies is below share")
    every = written(sized(docs, seed, carry), "sized")
    goal = targets(every.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_copies)
    goal = written(goal, "targets")
    named = goal.withColumnRenamed("source", "goal_source")
    chosen = written(plan(every, goal), "plan").join(named, F.col("source").eqNullSafe(F.col("goal_source")))
    chosen = chosen.select(F.col("source").alias("of_source"), F.col("size").alias("of_size"), "n", "whole", "extra", "source_size", "target")
    rows = every.join(chosen, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size"))).drop("of_source", "of_size")
    rows = rows.withColumn("part", F.pmod("draw", F.ceil(F.col("n") / ORDERED)))
    # Large groups are ordered part by part: a part holds about ORDERED documents, and whole parts are counted, not sorted.
    parts = rows.groupBy("source", "size", "part").agg(F.count("*").alias("n_part"))
    before = W.partitionBy("source", "size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("of_source"), F.col("size").alias("of_size"), F.col("part").alias("of_part"), F.coalesce(F.sum("n_part").over(before), F.lit(0)).alias("before"))
    rows = rows.join(parts, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size")) & (F.col("part") == F.col("of_part")))
    place = F.row_number().over(W.partitionBy("source", "size", "part").orderBy("draw", "doc_id"))
    copies = F.col("whole") + ((F.col("before") + place) <= F.col("extra")).cast("long")
    return rows.withColumn("copies", copies).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source", *([carry] if carry else []))
