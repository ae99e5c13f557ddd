"""Quality classifier by importance resampling.

Two bag-of-hashed-n-gram models are counted: one over a target (documents labelled good), one over the raw corpus (every
document). A document's importance weight is the ratio of its probabilities under the two; Gumbel noise is added to its
logarithm and the k largest are kept, which samples k documents without replacement in proportion to their weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, mix, row_hash, words_of, written

N_BUCKETS = 10_000
N_GRAM = 2
#: At most so many labelled rows are used: three of four for the target, the others, which it has not seen, for the cut.
MAX_LABELLED = 20_000
#: What losing all good rows costs, in terms of keeping all bad ones.
WORTH = 3.0
#: Raw n-grams per bucket that smooth the target.
PRIOR = 10.0


def features(words, n_gram: int = N_GRAM, n_buckets: int = N_BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each n-gram of 1 to ``n_gram`` words."""
    rows, buckets = [words.row[words.fresh]], [words.hashes[words.fresh] % np.uint64(n_buckets)]
    for n in range(2, n_gram + 1):
        at, h = words.ngrams(n)
        rows.append(words.row[at])
        buckets.append(h % np.uint64(n_buckets))
    return np.concatenate(rows), np.concatenate(buckets).astype(np.int64)


def bucket_counts(docs: DataFrame, n_gram: int, n_buckets: int) -> np.ndarray:
    """Counts of every bucket over all rows of ``docs``; ``n_buckets`` numbers reach the driver, whatever the corpus."""

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = np.zeros(n_buckets, np.int64)
        for _, words in words_of(batch.column("text")):
            total += np.bincount(features(words, n_gram, n_buckets)[1], minlength=n_buckets)
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = map_arrow(docs.select("text"), counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(n_buckets)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log p_target - log p_raw of each bucket; the target is smoothed by ``prior`` raw n-grams per bucket, so that a small one claims little."""
    p_raw = (raw + 1) / (raw.sum() + len(raw))
    more = prior * len(raw)
    return np.log((target + more * p_raw) / (target.sum() + more)) - np.log(p_raw)


def with_weights(docs: DataFrame, ratio: np.ndarray, n_gram: int, seed: int, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` (with ``text`` and ``noise_hash``), ``log_weight`` and ``sample_key``, the log weight with Gumbel noise."""

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        weight = np.zeros(batch.num_rows)
        for lo, words in words_of(batch.column("text")):
            row, bucket = features(words, n_gram, len(ratio))
            weight[lo : lo + words.rows] += np.bincount(row, weights=ratio[bucket], minlength=words.rows)
        h = mix(batch.column("noise_hash").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(seed))
        uniform = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
        key = weight - np.log(-np.log(uniform))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(weight), pa.array(key)], [*keep, "log_weight", "sample_key"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_arrow(docs.select(*dict.fromkeys([*keep, "text", "noise_hash"])), scored, f"{schema}, log_weight double, sample_key double")


def kth_largest(keys: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The exact k-th largest value (-inf if there are at most k): each pass counts ``bins`` equal ranges and enters the one with it."""
    lo, hi, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if n <= k or lo is None:
        return float("-inf")
    if k <= 0:
        return float("inf")
    above = 0  # rows over hi
    inside = keys
    while lo < hi:
        width = (hi - lo) / bins
        if width == 0 or lo + width == lo:
            break
        bin_of = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1))
        inside = keys.where(F.col(column).between(lo, hi))
        rows = sorted(inside.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), reverse=True)
        for r in rows:
            if above + r["n"] >= k:
                if (r["lo"], r["hi"]) == (lo, hi):
                    return lo
                lo, hi = r["lo"], r["hi"]
                break
            above += r["n"]
    return lo


def best_cut(weights: np.ndarray, good: np.ndarray, worth: float = WORTH) -> float:
    """The log weight that parts labelled good rows from bad ones at the least cost; half way between the two rows about it.

    The cost is the share of bad rows above it plus ``worth`` times the share of good rows below.
    """
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order].astype(bool)
    lost = np.concatenate([[0], np.cumsum(g)]) / max(1, g.sum())
    caught = np.concatenate([[0], np.cumsum(~g)]) / max(1, (~g).sum())
    valid = np.concatenate([[True], w[1:] > w[:-1], [True]])  # equal weights stay together
    i = int(np.argmax(np.where(valid, caught - worth * lost, -np.inf)))
    if i == 0:
        return float("-inf")
    return float("inf") if i == len(w) else float((w[i - 1] + w[i]) / 2)


def label_sample(labels: DataFrame, max_labelled: int, seed: int) -> DataFrame:
    """At most ``max_labelled`` labelled ids, by seeded hash, one row each; an id labelled both ways counts as bad."""
    clean = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    clean = clean.groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    return clean.orderBy(row_hash("doc_id", seed=seed), "doc_id").limit(max_labelled)


def fitted(docs: DataFrame, labels: DataFrame, k: int | None, n_gram: int, n_buckets: int, max_labelled: int, seed: int) -> tuple[np.ndarray, DataFrame, float]:
    """(log ratios of the buckets, (doc_id, log_weight, sample_key) of all rows, the k-th largest key)."""
    sample = label_sample(labels, max_labelled, seed).collect()  # at most max_labelled pairs of numbers
    pairs = [(int(r["doc_id"]), int(r["quality"]), k % 4 == 0) for k, r in enumerate(sample)]
    ids = docs.sparkSession.createDataFrame(pairs, "labelled_id long, quality int, unseen boolean")
    labelled = docs.join(F.broadcast(ids), docs["doc_id"] == ids["labelled_id"])
    raw = bucket_counts(docs, n_gram, n_buckets)
    target = bucket_counts(labelled.where("quality > 0 and not unseen"), n_gram, n_buckets)
    ratio = log_ratio(target, raw) if target.any() else np.zeros(n_buckets)
    scored = written(with_weights(docs, ratio, n_gram, seed, ["doc_id"]), "weights")
    if k is None:
        both = scored.join(F.broadcast(ids), scored["doc_id"] == ids["labelled_id"]).where("unseen").select("log_weight", "quality").limit(2 * max_labelled).collect()
        good = np.array([r["quality"] > 0 for r in both], bool)
        cut = best_cut(np.array([r["log_weight"] for r in both]), good) if good.any() and not good.all() else float("-inf")
        k = scored.where(F.col("log_weight") > cut).count()
    return ratio, scored, kth_largest(scored, "sample_key", k)


def noised(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, text, noise_hash, whole): whole holds all columns."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), whole.alias("whole")).withColumn("noise_hash", row_hash("doc_id", "text", seed=seed))


def resample(
    docs: DataFrame, labels: DataFrame, k: int | None = None, n_gram: int = N_GRAM, n_buckets: int = N_BUCKETS, max_labelled: int = MAX_LABELLED, seed: int = 1
) -> DataFrame:
    """(doc_id, log_weight, sample_key, keep) for every row of ``docs`` (doc_id, text).

    k: how many to keep; without it, as many as have a log weight above the cut that best parts the labelled rows.
    A null or empty text has log weight 0. Equal rows draw the same noise and share a decision; ties at the k-th key all
    stay, so more than k rows can. Without labelled good rows the target is the raw corpus, all weights are 0, and with
    no k all rows stay. Rows with a null doc_id are weighed like any other and are never labelled. Long
    texts are weighed in pieces. Other columns are not read; an empty table gives an empty one.
    """
    _, scored, least = fitted(noised(docs, seed).drop("whole"), labels, k, n_gram, n_buckets, max_labelled, seed)
    return scored.withColumn("keep", F.col("sample_key") >= least)


def kept(docs: DataFrame, labels: DataFrame, k: int | None = None, n_gram: int = N_GRAM, n_buckets: int = N_BUCKETS, max_labelled: int = MAX_LABELLED, seed: int = 1) -> DataFrame:
    """The rows of ``docs`` that ``resample`` keeps, whatever their columns: weighed again where they lie, without a join."""
    rows = noised(docs, seed)
    ratio, _, least = fitted(rows.drop("whole"), labels, k, n_gram, n_buckets, max_labelled, seed)
    return with_weights(rows, ratio, n_gram, seed, ["whole"]).where(F.col("sample_key") >= least).select("whole.*")
