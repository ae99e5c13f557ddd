"""Hard negatives for anchors among embeddings, with bounds carried along spanning trees of anchors.

Anchors come in trees of bounded size. A row's score with the root is computed; with any other anchor it lies within its
score at the parent plus or minus the edge's length times the row's norm. Only rows whose interval reaches what the anchor
still looks for (its best positives, then the windows of scores below them) are scored again. Trees are sent to the rows'
tasks a bounded number at a time; each task keeps the best few of each anchor, and these few are what shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shuffle_parts, written

#: Anchors of a tree, and trees that are sent to all tasks at once: 8,192 vectors at most.
TREE_ANCHORS = 1024
TREES_AT_ONCE = 8
SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: Hundredths of a positive's score between which its negatives score.
LEAST, MOST = 30, 90
#: Sums under this are exact in doubles; larger ones are taken in whole numbers.
EXACT = float(1 << 52)
_LOW, _HIGH = -(1 << 63) + 1, (1 << 63) - 1


@dataclass
class Rows:
    """Rows that take part: ids, labels, whole-numbered vectors (shorter ones filled with zeros), norms, and places by label."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    norms: np.ndarray


def rows_of(batch: pa.RecordBatch) -> Rows:
    """The rows of (vec_id, label, embedding) whose id, label and components are all there and finite."""
    ids, labels, lists = (batch.column(c) for c in ("vec_id", "label", "embedding"))
    there = (ids.is_valid().to_numpy(False)) & (labels.is_valid().to_numpy(False)) & (lists.is_valid().to_numpy(False))
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(SCALE * flat)
    row = np.repeat(np.arange(len(sizes)), sizes)
    there[row[~np.isfinite(flat)]] = False
    width = int(sizes.max(initial=0))
    if len(flat) == len(sizes) * width:
        x = flat.reshape(len(sizes), width)
    else:
        x = np.zeros((len(sizes), width))
        x[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    x = x[there]
    number = lambda c: c.fill_null(0).to_numpy(zero_copy_only=False)[there].astype(np.int64)
    with np.errstate(over="ignore"):
        return Rows(number(ids), number(labels), x, np.sqrt((x * x).sum(axis=1)))


def scores(x: np.ndarray, norms: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``x`` with ``q`` over the components that both have, as long; beyond a long's range its end."""
    w = min(x.shape[1], len(q))
    with np.errstate(over="ignore", invalid="ignore"):
        wide = ~(norms * np.sqrt((q * q).sum()) < EXACT)
        if not wide.any():
            return (x[:, :w] @ q[:w]).astype(np.int64)
    out = np.zeros(len(x), np.int64)
    out[~wide] = (x[~wide, :w] @ q[:w]).astype(np.int64)
    whole = [int(v) for v in q[:w]]
    for i in np.flatnonzero(wide):
        out[i] = max(_LOW, min(_HIGH, sum(int(v) * u for v, u in zip(x[i, :w], whole))))
    return out


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, parents): a minimum spanning tree by distance, depth first, and each row's parent (-1 for the root).

    A node's largest subtree comes last, so that at most log2 of the nodes have children still to come at any time.
    """
    n = len(x)
    parent, far, near, todo = np.full(n, -1), np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    with np.errstate(over="ignore", invalid="ignore"):
        squares = (x * x).sum(axis=1)
        joined, at = [0], 0
        for _ in range(n - 1):
            todo[at] = False
            d = np.nan_to_num(squares + squares[at] - 2 * (x @ x[at]), nan=np.inf)
            closer = todo & (d < far)
            far[closer], near[closer] = d[closer], at
            at = int(np.flatnonzero(todo)[np.argmin(far[todo])])
            parent[at] = near[at]
            joined.append(at)
    size, children = np.ones(n, np.int64), [[] for _ in range(n)]
    for k in reversed(joined[1:]):
        size[parent[k]] += size[k]
        children[parent[k]].append(k)
    order, stack = [], [0] if n else []
    while stack:
        k = stack.pop()
        order.append(k)
        stack += sorted(children[k], key=lambda c: -size[c])
    return np.array(order, np.int64), parent


@dataclass
class Tree:
    """Anchors in depth-first order; ``parents`` are places in that order, ``reach`` the length of each edge."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    parents: np.ndarray
    reach: np.ndarray
    last_child: np.ndarray = field(init=False)

    def __post_init__(self):
        self.last_child = np.zeros(len(self.ids), np.int64)
        for k, p in enumerate(self.parents):
            if p >= 0:
                self.last_child[p] = k

    @classmethod
    def of(cls, rows: Rows) -> "Tree":
        order, parent = spanning_tree(rows.x)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        x, parents = rows.x[order], np.array([place[parent[k]] if parent[k] >= 0 else -1 for k in order], np.int64)
        with np.errstate(over="ignore", invalid="ignore"):
            reach = np.sqrt(((x - x[parents]) ** 2).sum(axis=1))
        return cls(rows.ids[order], rows.labels[order], x, parents, np.nan_to_num(reach, nan=np.inf, posinf=np.inf))


class Met:
    """How many (anchor, row) scores were bounded, and how many of those computed."""

    def __init__(self):
        self.bounded = self.scored = 0


def walk(tree: Tree, rows: Rows, wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray], found: Callable[[int, np.ndarray, np.ndarray], None], met: Met | None = None) -> None:
    """Visit the anchors depth first: ``wanted`` says of (anchor, lows, highs) which rows to score, ``found`` gets (anchor, places, scores).

    Bounds are rounded outwards. Where most rows are wanted all are scored, which tightens the bounds of what hangs below.
    """
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k, q in enumerate(tree.x):
        p = int(tree.parents[k])
        exact = None
        if p < 0:
            exact = scores(rows.x, rows.norms, q)
            lo = hi = exact.astype(np.float64)
        else:
            with np.errstate(invalid="ignore", over="ignore"):
                slack = np.nan_to_num(tree.reach[k] * rows.norms * (1 + 1e-9) + 1, nan=np.inf, posinf=np.inf)
            lo, hi = held[p][0] - slack, held[p][1] + slack
            if tree.last_child[p] == k:
                del held[p]
        places = np.flatnonzero(wanted(k, lo, hi))
        if met is not None:
            met.bounded += len(rows.ids)
            met.scored += len(rows.ids) if exact is not None else len(places)
        if exact is None and 4 * len(places) > len(rows.ids):
            exact = scores(rows.x, rows.norms, q)
            lo = hi = exact.astype(np.float64)
        if exact is not None:
            got = exact[places]
        else:
            got = scores(rows.x[places], rows.norms[places], q)
            lo[places] = hi[places] = got
        if tree.last_child[k]:
            held[k] = (lo, hi)
        if len(places):
            found(k, places, got)


class Best:
    """The first few of (score, id), higher scores and then smaller ids first."""

    __slots__ = ("n", "score", "ids")

    def __init__(self, n: int):
        self.n, self.score, self.ids = n, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def floor(self) -> float:
        """A score below which nothing enters any more."""
        return float(self.score[-1]) if len(self.score) == self.n else -np.inf

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        if len(score) > 4 * self.n:  # ties of the last one stay in
            some = score >= np.partition(score, len(score) - self.n)[len(score) - self.n]
            score, ids = score[some], ids[some]
        score, ids = np.r_[self.score, score], np.r_[self.ids, ids]
        first = np.lexsort((ids, -score))[: self.n]
        self.score, self.ids = score[first], ids[first]


def positives_in(tree: Tree, best: list[Best], rows: Rows, met: Met | None = None) -> None:
    """Bring ``rows`` into each anchor's best rows of its label."""
    if not len(rows.ids):
        return

    def wanted(k, lo, hi):
        mine = (rows.labels == tree.labels[k]) & (rows.ids != tree.ids[k])
        floor, n = best[k].floor, best[k].n
        if mine.sum() > n:
            sure = lo[mine]
            floor = max(floor, np.partition(sure, len(sure) - n)[len(sure) - n])
        return mine & (hi >= floor)

    walk(tree, rows, wanted, lambda k, at, got: best[k].add(got, rows.ids[at]), met)


def windows_of(positives: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The whole scores from ``LEAST`` to ``MOST`` hundredths of each (id, score); below zero there are none."""
    return [(-(-LEAST * s // 100), MOST * s // 100) for _, s in positives]


def negatives_in(tree: Tree, windows: list[list[tuple[int, int]]], best: list[list[Best]], rows: Rows, met: Met | None = None) -> None:
    """Bring ``rows`` into the best rows of other labels inside each window of each anchor."""
    if not len(rows.ids):
        return

    def wanted(k, lo, hi):
        open_ = [(max(a, b.floor), z) for (a, z), b in zip(windows[k], best[k]) if a <= z]
        if not open_:
            return np.zeros(len(rows.ids), bool)
        return (rows.labels != tree.labels[k]) & (rows.ids != tree.ids[k]) & (hi >= min(a for a, _ in open_)) & (lo <= max(z for _, z in open_))

    def found(k, at, got):
        for (a, z), b in zip(windows[k], best[k]):
            inside = np.flatnonzero((got >= max(a, b.floor)) & (got <= z))
            if len(inside):
                b.add(got[inside], rows.ids[at[inside]])

    walk(tree, rows, wanted, found, met)


def trees_of(rows: DataFrame, tree_anchors: int) -> DataFrame:
    """Trees of the anchors, one row each: anchors of a label and a corner of space stand together, at most ``tree_anchors`` a tree."""
    clean = rows.mapInArrow(lambda batches: (_listed(rows_of(b)) for b in batches), "vec_id long, label long, embedding array<double>")
    single = clean.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.label", "row.embedding")
    corner = F.expr("aggregate(slice(embedding, 1, 24), 0L, (a, x) -> a * 2 + IF(x < 0, 0, 1))")
    single = written(single.withColumn("corner", corner), "anchors")
    parts = max(1, -(-single.count() // tree_anchors))
    ordered = single.repartitionByRange(parts, "label", "corner", "vec_id").sortWithinPartitions("label", "corner", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def built() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            for a in range(0, table.num_rows, tree_anchors):
                t = Tree.of(rows_of(table.slice(a, tree_anchors).combine_chunks().to_batches()[0]))
                lists = [pa.array([v.tolist()], k) for v, k in ((t.ids, pa.list_(pa.int64())), (t.labels, pa.list_(pa.int64())), (t.x.ravel() / SCALE, pa.list_(pa.float64())), (t.parents, pa.list_(pa.int64())), (t.reach, pa.list_(pa.float64())))]
                yield pa.RecordBatch.from_arrays(lists, ["ids", "labels", "x", "parents", "reach"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 4 * tree_anchors:
                yield from built()
                held, n = [], 0
        if n:
            yield from built()

    return written(ordered.mapInArrow(run, "ids array<long>, labels array<long>, x array<double>, parents array<long>, reach array<double>"), "trees")


def _listed(rows: Rows) -> pa.RecordBatch:
    offsets = np.arange(len(rows.ids) + 1, dtype=np.int32) * rows.x.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.x.ravel() / SCALE))
    return pa.RecordBatch.from_arrays([pa.array(rows.ids), pa.array(rows.labels), lists], ["vec_id", "label", "embedding"])


def _tree(row) -> Tree:
    n = len(row["ids"])
    x = np.array(row["x"], np.float64).reshape(n, -1) * SCALE
    return Tree(np.array(row["ids"], np.int64), np.array(row["labels"], np.int64), x, np.array(row["parents"], np.int64), np.array(row["reach"], np.float64))


def _in_batches(rows: DataFrame, schema: str, start: Callable, feed: Callable, end: Callable) -> DataFrame:
    """``feed`` each task's rows into the state that ``start`` makes; ``end`` turns it into columns."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for batch in batches:
            if batch.num_rows:
                feed(state, rows_of(batch))
        columns = list(zip(*end(state))) or [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return rows.mapInArrow(run, schema)


def _first(rows: DataFrame, keys: list[str], score: str, tie: str, n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(score), tie))).where(F.col("rank") <= n)


def with_trees(rows: DataFrame, trees: list[Tree]) -> DataFrame:
    """The negatives of these trees' anchors among all ``rows``: two passes over them, the trees sent along."""
    context = rows.sparkSession.sparkContext
    sent = context.broadcast(trees)
    near = _in_batches(
        rows,
        "anchor_id long, score long, vec_id long",
        lambda: [[Best(POSITIVES) for _ in t.ids] for t in sent.value],
        lambda state, part: [positives_in(t, b, part) for t, b in zip(sent.value, state)],
        lambda state: ((t.ids[k], s, i) for t, of in zip(sent.value, state) for k, b in enumerate(of) for s, i in zip(b.score, b.ids)),
    )
    positives: dict[int, list[tuple[int, int]]] = {}
    for r in _first(near, ["anchor_id"], "score", "vec_id", POSITIVES).sort("anchor_id", "rank").collect():  # POSITIVES an anchor of these trees
        positives.setdefault(r["anchor_id"], []).append((r["vec_id"], r["score"]))
    chosen = context.broadcast([[positives.get(int(i), []) for i in t.ids] for t in trees])

    def start():
        windows = [[windows_of(p) for p in of] for of in chosen.value]
        return [(w, [[Best(NEGATIVES) for _ in x] for x in w]) for w in windows]

    def end(state):
        for t, of, (_, best) in zip(sent.value, chosen.value, state):
            for k, anchor in enumerate(t.ids):
                for slot, ((pid, ps), b) in enumerate(zip(of[k], best[k])):
                    for s, i in zip(b.score, b.ids):
                        yield anchor, slot, pid, ps, i, s

    far = _in_batches(
        rows,
        "anchor_id long, slot long, positive_id long, positive_score long, negative_id long, negative_score long",
        start,
        lambda state, part: [negatives_in(t, w, b, part) for t, (w, b) in zip(sent.value, state)],
        end,
    )
    return _first(far, ["anchor_id", "slot"], "negative_score", "negative_id", NEGATIVES)


def mined(embeddings: DataFrame, every: int = 100, tree_anchors: int = TREE_ANCHORS, trees_at_once: int = TREES_AT_ONCE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``embeddings`` (vec_id, embedding, label).

    Anchors are rows whose id is divisible by ``every``; scores are whole inner products of floor(256 x). An anchor's
    positives are its first 5 other rows of its label, and each has its first 10 rows of other labels that score from 30 to
    90 hundredths of it: higher scores first, then smaller ids. Where the id is divisible by 7 the label is (label + 1) % 10.
    Rows with a null label, vector, component or id, or a component that is not finite (times 256, too), take no part. Vectors
    of different lengths count as filled with zeros; scores beyond a long's range count as its end. Rows with an anchor's id
    are not other rows; of several anchors with one id the one with the smallest label, then vector, stands; repeated rows
    count each. Columns of other names are not read; an empty table gives no rows. Each ``trees_at_once`` trees of
    ``tree_anchors`` anchors take two passes over all rows: the queries are a share of the rows, so the work grows with the
    product, in blocks, and no set of rows is ever held but a task's batch.
    """
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    trees = trees_of(rows.where(F.col("vec_id") % every == 0), tree_anchors)
    out, held = None, []

    def add(out: DataFrame | None) -> DataFrame:
        part = with_trees(rows, held).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
        part = written(part, "negatives")
        return part if out is None else out.unionByName(part)

    for row in trees.toLocalIterator():  # a task's trees at a time
        held.append(_tree(row))
        if len(held) == trees_at_once:
            out, held = add(out), []
    return add(out) if held or out is None else out
