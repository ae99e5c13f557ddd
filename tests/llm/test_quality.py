import random

import numpy as np
import pytest

from tidemark.llm import quality
from tidemark.llm.queries import QUERIES


def corpus(spark, n=600):
    rng = random.Random(4)
    good = [f"good{k}" for k in range(60)]
    bad = [f"junk{k}!!" for k in range(60)]
    rows = [(i, " ".join(rng.choice(bad if i % 5 == 0 else good) for _ in range(60))) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, n, 3)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_unlabelled_junk_goes_and_clean_rows_stay(spark):
    out = {r["doc_id"]: r["keep"] for r in quality.resample(*corpus(spark)).collect()}
    assert all(keep == (i % 5 != 0) for i, keep in out.items())


def test_weights_are_ratios_of_bucket_models(spark, texts, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    raw = quality.bucket_counts(docs, 2, 1000)
    assert raw.sum() == sum(max(0, 2 * len(t.split()) - 1) for t in texts.values())
    ratio = quality.log_ratio(np.ones(4), np.array([1.0, 1, 1, 5]), prior=1.0)
    assert ratio[3] < 0 < ratio[0]
    assert QUERIES["op1_importance_resampling"](spark, sf).count() == len(texts) and labels.count() > 0


@pytest.mark.parametrize("k", [0, 1, 7, 100, 599, 600, 700])
def test_gumbel_top_k_keeps_k(spark, k):
    docs, labels = corpus(spark)
    rows = quality.resample(docs, labels, k=k).collect()
    kept = [r["sample_key"] for r in rows if r["keep"]]
    assert len(kept) == min(k, 600)
    assert not kept or min(kept) >= max((r["sample_key"] for r in rows if not r["keep"]), default=float("-inf"))


def test_kth_largest_with_ties(spark):
    values = [5.0] * 10 + [1.0, 2.0, 9.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in range(1, len(values)):
        assert quality.kth_largest(df, "v", k, bins=4) == sorted(values, reverse=True)[k - 1]


def test_odd_rows(spark, odd, none, sf):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.resample(odd, labels).collect()
    assert len(out) == odd.count() and all(r["keep"] for r in out)
    assert quality.kept(odd, labels).columns == odd.columns and quality.kept(odd, labels).count() == odd.count()
    assert quality.resample(none, labels).count() == 0 and quality.resample(odd, labels.limit(0)).count() == odd.count()


def test_log_weights_as_plain_python(spark, sf, texts):
    """Counts of both models and every document's log weight, recomputed word by word."""
    import math
    from collections import Counter

    from plain import ngram_hash, word_hash, words

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = {}

    def buckets(text):
        h = [known.setdefault(w, word_hash(w)) for w in words(text)]
        return [x % 1000 for x in h] + [ngram_hash(h[k : k + 2]) % 1000 for k in range(len(h) - 1)]

    of = {i: Counter(buckets(t)) for i, t in texts.items()}
    raw, target = Counter(), Counter()
    for i, c in of.items():
        raw.update(c)
        if i % 3 == 0:
            target.update(c)
    got_raw, got_target = quality.bucket_counts(docs, 2, 1000), quality.bucket_counts(docs.where("doc_id % 3 = 0"), 2, 1000)
    assert all(got_raw[b] == raw[b] and got_target[b] == target[b] for b in range(1000))
    n, m = sum(raw.values()), sum(target.values())
    p_raw = [(raw[b] + 1) / (n + 1000) for b in range(1000)]
    ratio = [math.log((target[b] + quality.PRIOR * 1000 * p_raw[b]) / (m + quality.PRIOR * 1000)) - math.log(p_raw[b]) for b in range(1000)]
    out = quality.with_weights(quality.noised(docs, 1).drop("whole"), quality.log_ratio(got_target, got_raw), 2, 1, ["doc_id"])
    for r in out.collect():
        assert math.isclose(r["log_weight"], sum(c * ratio[b] for b, c in of[r["doc_id"]].items()), rel_tol=1e-9, abs_tol=1e-6)


def test_a_long_text_in_pieces_weighs_as_a_whole(spark):
    text = " ".join(f"w{k % 4999}" for k in range(600_000))  # over three pieces
    ratio = quality.log_ratio(quality.np.arange(1.0, 101.0), quality.np.arange(100.0, 0.0, -1.0))
    from tidemark.llm.common import Words

    data = quality.np.frombuffer(text.encode(), quality.np.uint8)
    whole = Words(data, quality.np.array([0, len(data)]), True)
    want = ratio[quality.features(whole, 2, 100)[1]].sum()
    out = quality.with_weights(quality.noised(spark.createDataFrame([(1, text)], "doc_id long, text string"), 1).drop("whole"), ratio, 2, 1, ["doc_id"]).first()
    assert abs(out["log_weight"] - want) < 1e-6 * abs(want) + 1e-6
