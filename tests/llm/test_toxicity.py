import random

import numpy as np

from tidemark.llm import toxicity


def corpus(spark, n=900):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(60)]
        grade = 0 if i % 4 else 1 + i % 8 // 4
        for _ in range(grade * 3):
            words[rng.randrange(60)] = rng.choice(["nasty", "vile", "scornful"]) + rng.choice(["", ",", "ly"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(grade > 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_are_told_apart(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit(docs, labels.where("doc_id < 600"))
    out = {r["doc_id"]: r for r in toxicity.graded(docs, model).where("doc_id >= 600").collect()}
    assert len(out) == 300 and sum(r["toxic"] == (i % 4 == 0) for i, r in out.items()) >= 294
    mean = lambda g: np.mean([r["expected_severity"] for i, r in out.items() if (0 if i % 4 else 1 + i % 8 // 4) == g])
    assert mean(0) < mean(1) < mean(2)
    assert all(sorted(r["exceed"], reverse=True) == r["exceed"] and abs(sum(r["exceed"]) - r["expected_severity"]) < 1e-9 for r in out.values())


def test_the_fit_is_a_minimum():
    """No small step of the weights or thresholds lowers the penalised loss much."""
    rng = np.random.default_rng(3)
    n, m = 200, 12
    x = rng.random((n, m)) < 0.3
    score = x @ np.r_[2.0, 1.5, np.zeros(m - 2)] + rng.logistic(size=n)
    grade = (score > 1).astype(int) + (score > 3)
    index, owner = np.nonzero(x)[1], np.nonzero(x)[0]
    start = np.searchsorted(owner, np.arange(n))
    weights, cuts = toxicity.fit_ordinal(index, start, grade, np.ones(n), m, l1=1e-3, rounds=2000)
    assert cuts[0] < cuts[1] and weights[0] > 1 and weights[1] > 0.5

    def loss(w, c):
        s = 1 / (1 + np.exp(-(np.r_[-50, c, 50][:, None] - x @ w)))
        return -np.log(np.diff(s, axis=0)[grade, np.arange(n)]).mean() + 1e-3 * np.abs(w).sum()

    base = loss(weights, cuts)
    for _ in range(200):
        assert loss(weights + rng.normal(scale=0.02, size=m), cuts + rng.normal(scale=0.02, size=2)) > base - 2e-4


def test_odd_rows(spark, odd, none):
    docs, labels = corpus(spark, 200)
    model = toxicity.fit(docs, labels)
    assert toxicity.graded(odd, model).count() == odd.count() and toxicity.graded(odd, model).where("toxic").count() == 0
    assert toxicity.graded(none, model).count() == 0
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None and toxicity.fit(none, labels) is None
    assert toxicity.graded(odd, None).where("expected_severity > 0").count() == 0
    messy = spark.createDataFrame([(None, 1, 1), (1, 1, None), (2, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, messy) is None


def test_exceedances_as_plain_python(spark, sf, texts):
    """The score of every document from its words and their beginnings, one by one, under the fitted weights."""
    import math

    from plain import word_hash, words

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.selected.hashes.tolist(), model.weights.tolist()))
    known = {}

    def features(w):
        return {word_hash(w)} | {word_hash(w[:n]) ^ n for n in toxicity.PREFIXES if len(w) > n}

    for r in toxicity.graded(docs, model).collect():
        mine = set()
        for w in set(words(texts[r["doc_id"]])):
            mine |= known.setdefault(w, features(w))
        score = sum(weight.get(h, 0.0) for h in mine)
        want = [1 / (1 + math.exp(c - score)) for c in model.cuts]
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(r["exceed"], want))
        assert math.isclose(r["expected_severity"], sum(want), rel_tol=1e-9) and r["toxic"] == (want[0] >= 0.5)
