"""Toxicity by cumulative-link ordinal regression.

One weight vector over sparse text features (words and word beginnings) serves every threshold: P(grade > k) is the
logistic of the document's score less threshold k, and thresholds are ordered. The expected severity is the sum of these
probabilities. Weights and thresholds are fitted with an L1 penalty on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, map_arrow, row_hash, text_or_empty, words_of, written

#: Labelled documents per class (toxic or not) that are fitted at most.
MAX_PER_CLASS = 10_000
#: Features that enter the model, those most tied to a class; and documents that must have one.
N_FEATURES = 4096
LEAST_DOCS = 5
#: Bytes of the word beginnings that are features.
PREFIXES = (4, 5, 6)
L1 = 2e-4


def feature_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word and of its beginnings; a word as short as a beginning is not one."""
    rows, hashes = [words.row[words.fresh]], [words.hashes[words.fresh]]
    size = words.ends - words.starts
    size[: words.lead] = 0
    for n in PREFIXES:
        at = np.flatnonzero(size > n)
        rows.append(words.row[at])
        hashes.append(words.span_hash(words.starts[at], words.starts[at] + n) ^ np.uint64(n))
    return np.concatenate(rows), np.concatenate(hashes)


def features_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row, hash) of some rows after another; of a long text each feature once."""
    held: list[np.ndarray] = []
    for lo, words in words_of(column):
        row, h = feature_hashes(words)
        if words.lead or words.more:
            held.append(np.unique(h))
            if words.more:
                continue
            h = np.unique(np.concatenate(held))
            row, held = np.zeros(len(h), np.int64), []
        yield lo, row, h


class Selected:
    """Look-up of feature hashes among the selected ones."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def in_rows(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, rows, row, feature number), each pair once; a long text's pieces come as one row."""
        held: list[np.ndarray] = []
        for lo, words in words_of(column):
            row, at = self.present(words)
            if words.lead or words.more:
                held.append(at)
                if words.more:
                    continue
                at = np.unique(np.concatenate(held))
                row, held = np.zeros(len(at), np.int64), []
            yield lo, words.rows, row, at

    def present(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature number), each pair once."""
        row, h = feature_hashes(words)
        if not len(self.hashes):
            return row[:0], row[:0]
        hit = np.flatnonzero(self.seen[(h >> np.uint64(48)).astype(np.int64)])
        row, h = row[hit], h[hit]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        good = self.hashes[at] == h
        both = np.unique(row[good] * np.int64(len(self.hashes)) + at[good])
        return both // len(self.hashes), both % len(self.hashes)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, seed: int) -> DataFrame:
    """(doc_id, text, toxic) of at most ``per_class`` labelled documents of either class, by seeded hash."""
    clean = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked = None
    for toxic in (0, 1):
        part = clean.where(F.col("toxic") == toxic if toxic == 0 else F.col("toxic") != 0).orderBy(row_hash("doc_id", seed=seed), "doc_id").limit(per_class)
        part = part.select(F.col("doc_id").alias("labelled_id"), F.lit(toxic).alias("toxic"))
        picked = part if picked is None else picked.union(part)
    both = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("labelled_id"))
    return both.select("doc_id", "text", "toxic")


def select_features(sample: DataFrame, n_features: int, least_docs: int) -> np.ndarray:
    """Hashes of the features whose log odds between the classes lie the most standard errors from 0."""

    def counted(batch: pa.RecordBatch) -> pa.Table:
        out = {0: [], 1: []}
        toxic = batch.column("toxic").to_numpy()
        for lo, row, h in features_of(batch.column("text")):
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            row, h = row[new], h[new]
            for k in out:
                out[k].append(h[toxic[lo + row] == k])
        parts = []
        for k, hs in out.items():
            h, n = np.unique(np.concatenate(hs) if hs else np.empty(0, np.uint64), return_counts=True)
            parts.append(pa.table({"feature": pa.array(h.view(np.int64)), "toxic": pa.array(np.full(len(h), k, np.int32)), "n": pa.array(n.astype(np.int64))}))
        return pa.concat_tables(parts)

    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    counts = map_arrow(sample.select("text", "toxic"), counted, "feature long, toxic int, n long").groupBy("feature")
    counts = counts.agg(F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("b"))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    rest_a, rest_b = F.lit(n0 + 1.0) - a, F.lit(n1 + 1.0) - b
    z = F.log(b * rest_a / (a * rest_b)) / F.sqrt(1 / a + 1 / b + 1 / rest_a + 1 / rest_b)
    top = counts.where(F.col("a") + F.col("b") >= least_docs).select("feature", F.abs(z).alias("z")).orderBy(F.desc("z"), "feature").limit(n_features).collect()
    return np.array([r["feature"] for r in top], np.int64).view(np.uint64)


def fit_ordinal(index: np.ndarray, start: np.ndarray, grade: np.ndarray, weight: np.ndarray, n_features: int, l1: float = L1, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ordered thresholds) of the cumulative-link model, by accelerated proximal gradient steps.

    index: feature numbers of the documents' binary features, one after another; start: where each document's begin.
    """
    n_grades = int(grade.max()) + 1
    sizes = np.diff(np.append(start, len(index)))
    owner = np.repeat(np.arange(len(grade)), sizes)
    weight = weight / weight.sum()
    above = np.array([max(1e-6, weight[grade > k].sum()) for k in range(n_grades - 1)])
    first = np.log((1 - above) / above)
    # Thresholds are the first one and the logarithms of the steps to the next ones.
    step = np.log(np.maximum(np.diff(first), 0.1))
    w = np.zeros(n_features)
    theta = np.concatenate([first[:1], step])
    w_old, theta_old = w.copy(), theta.copy()
    rate = 4.0 / max(1.0, np.percentile(sizes, 99)) if len(sizes) else 1.0
    scale = max(rate, 0.5)

    def sigmoid(x):
        return 0.5 * (1 + np.tanh(0.5 * x))

    def loss_parts(w, theta):
        cut = np.concatenate([theta[:1], theta[0] + np.cumsum(np.exp(theta[1:]))])
        score = np.bincount(owner, weights=w[index], minlength=len(grade))
        ends = np.concatenate([[-np.inf], cut, [np.inf]])
        hi, lo = ends[grade + 1] - score, ends[grade] - score  # P(y) = s(hi) - s(lo)
        p_hi, p_lo = sigmoid(np.clip(hi, -50, 50)), sigmoid(np.clip(lo, -50, 50))
        p = np.maximum(p_hi - p_lo, 1e-12)
        d_hi, d_lo = p_hi * (1 - p_hi) * np.isfinite(hi), p_lo * (1 - p_lo) * np.isfinite(lo)
        by_score = weight * (d_hi - d_lo) / p  # of the loss
        by_cut = np.array([-(weight[grade == k] * d_hi[grade == k] / p[grade == k]).sum() + (weight[grade == k + 1] * d_lo[grade == k + 1] / p[grade == k + 1]).sum() for k in range(n_grades - 1)])
        by_theta = np.array([by_cut[k:].sum() for k in range(n_grades - 1)])
        by_theta[1:] *= np.exp(theta[1:])
        return -(weight * np.log(p)).sum(), np.bincount(index, weights=by_score[owner], minlength=n_features), by_theta

    best = np.inf
    for t in range(1, rounds + 1):
        momentum = (t - 1) / (t + 2)
        ahead, theta_ahead = w + momentum * (w - w_old), theta + momentum * (theta - theta_old)
        loss, g, g_theta = loss_parts(ahead, theta_ahead)
        if loss > best + 0.05:  # too long a step: start again from here with a shorter one
            scale *= 0.5
            w_old, theta_old = w.copy(), theta.copy()
        best = min(best, loss)
        w_old, theta_old = w, theta
        moved = ahead - scale * g
        w = np.sign(moved) * np.maximum(np.abs(moved) - scale * l1, 0)
        theta = theta_ahead - scale * g_theta
    return w, np.concatenate([theta[:1], theta[0] + np.cumsum(np.exp(theta[1:]))])


class Model:
    def __init__(self, selected: Selected, weights: np.ndarray, cuts: np.ndarray):
        self.selected, self.weights, self.cuts = selected, weights, cuts

    def exceed(self, rows: int, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """P(grade > k) of each of ``rows`` rows from its features (row, feature number), one column for each threshold."""
        score = np.bincount(row, weights=self.weights[at], minlength=rows)
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = MAX_PER_CLASS, n_features: int = N_FEATURES, seed: int = 3) -> Model | None:
    """The fitted model; None unless both classes are labelled.

    labels: doc_id, toxic (0 or not). Grade 0 is not toxic. Toxic documents get grade 2 if they hold as many of the
    features that only toxic ones have as half of them do, else grade 1: a proxy, as no label says how toxic a text is.
    Classes weigh as they do among all labels. At most ``2 * per_class`` documents with ``n_features`` numbers each, 330 MB,
    reach the driver.
    """
    sample = written(labelled_sample(docs, labels, per_class, seed), "labelled")
    selected = Selected(select_features(sample, n_features, LEAST_DOCS))

    def listed(batch: pa.RecordBatch) -> pa.Table:
        parts = []
        for lo, rows, row, at in selected.in_rows(batch.column("text")):
            start = np.searchsorted(row, np.arange(rows + 1))
            parts.append(pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(at.astype(np.int32))))
        lists = pa.chunked_array(parts, pa.list_(pa.int32()))
        return pa.Table.from_arrays([batch.column("doc_id"), batch.column("toxic"), lists], ["doc_id", "toxic", "features"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = map_arrow(sample, listed, f"doc_id {kind}, toxic int, features array<int>").toArrow().sort_by("doc_id")  # at most 2 * per_class documents
    toxic = rows.column("toxic").to_numpy().astype(np.int64)
    if not len(toxic) or toxic.all() or not toxic.any():
        return None
    lists = rows.column("features").combine_chunks()
    index, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    owner = np.repeat(np.arange(len(toxic)), sizes)
    with_it = [np.bincount(index[toxic[owner] == k], minlength=len(selected.hashes)) for k in (0, 1)]
    marks = np.bincount(owner, weights=((with_it[0] == 0) & (with_it[1] > 0))[index], minlength=len(toxic))
    grade = toxic + (toxic > 0) * (marks >= max(1, np.median(marks[toxic > 0])))
    grade = np.unique(grade, return_inverse=True)[1]
    share = labels.where(F.col("toxic").isNotNull()).agg(F.avg((F.col("toxic") != 0).cast("double"))).first()[0]
    weight = np.where(toxic > 0, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    weights, cuts = fit_ordinal(index, np.concatenate([[0], np.cumsum(sizes)[:-1]]), grade, weight, len(selected.hashes))
    return Model(selected, weights, cuts)


def graded(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """(doc_id, exceed, expected_severity, toxic) for every row of ``docs``.

    exceed: P(grade > k) for each k; expected_severity: their sum; toxic: P(grade > 0) is ``least`` or more. Null and empty
    texts have no features and get the severity of the thresholds alone; without a model all severities are 0. Long texts
    are read in pieces, each feature counting once. Repeated rows give a row each, and no row depends on another, so there
    are no ties; of features that lie equally far from chance the model takes those with the smaller hashes. Columns other
    than doc_id and text are not read; an empty table gives an empty one.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_cuts = 0 if model is None else len(model.cuts)
        p = np.zeros((batch.num_rows, n_cuts))
        if model is not None:
            for lo, rows, row, at in model.selected.in_rows(batch.column("text")):
                p[lo : lo + rows] = model.exceed(rows, row, at)
        exceed = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * n_cuts, pa.int32()), pa.array(p.ravel()))
        toxic = p[:, 0] >= least if n_cuts else np.zeros(batch.num_rows, bool)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), exceed, pa.array(p.sum(axis=1)), pa.array(toxic)], ["doc_id", "exceed", "expected_severity", "toxic"])

    base = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_arrow(base, run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, exceed array<double>, expected_severity double, toxic boolean")
