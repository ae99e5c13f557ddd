import collections

import numpy as np
import pytest

from tidemark.llm import mixing


def filled(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by sharing the excess again and again."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    caps, goal = [most * s for s in sizes], [share * sum(sizes) * x / sum(w) for x in w]
    free = set(range(len(sizes)))
    while over := [i for i in free if goal[i] > caps[i] + 1e-9]:
        excess = sum(goal[i] - caps[i] for i in over)
        for i in over:
            goal[i] = caps[i]
            free.discard(i)
        for i in free:
            goal[i] += excess * w[i] / sum(w[j] for j in free)
    return goal


@pytest.mark.parametrize("sizes", [[10], [10, 1, 1], [1, 100, 100, 3], [5, 5, 5, 0, 7], [1, 2, 3, 4, 5, 6, 7, 800]])
def test_targets_as_shared_by_hand(spark, sizes):
    df = spark.createDataFrame([(f"s{i:02d}", s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = [r["target"] for r in mixing.targets(df).orderBy("source").collect()]
    assert np.allclose(got, filled(sizes))


def test_budgets_are_fitted_as_well_as_any_subset_can():
    rng = np.random.default_rng(1)
    for _ in range(300):
        sizes = np.unique(rng.integers(1, 25, rng.integers(1, 6)))
        counts = rng.integers(1, 4, len(sizes))
        budget = int(rng.integers(0, (sizes * counts).sum()))
        taken = mixing.fit_counts(sizes, counts, budget, fitted=10**6)
        sums = {0}
        for s, n in zip(sizes, counts):
            sums = {x + s * k for x in sums for k in range(n + 1)}
        assert (taken <= counts).all() and (taken * sizes).sum() == max(x for x in sums if x <= budget)


def test_the_mix_meets_its_targets(spark, sf, texts):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mixed(docs).collect()
    taken, goal, size = collections.Counter(), {}, collections.Counter()
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].encode().split()) and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        goal[r["source"]] = r["target"]
    names = sorted(size)
    assert len(rows) == len(texts) and np.allclose([goal[s] for s in names], filled([size[s] for s in names]))
    for s in names:
        assert abs(taken[s] - goal[s]) <= max(40, 0.05 * goal[s])
    again = mixing.mixed(docs.repartition(7)).collect()
    assert {(r["doc_id"], r["taken"]) for r in again} == {(r["doc_id"], r["taken"]) for r in rows}


def test_large_groups_are_ordered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ORDERED", 8)
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b", "x y") for i in range(300)], "doc_id long, source string, text string")
    rows = mixing.mixed(docs).collect()
    taken = collections.Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
    goal = {r["source"]: r["target"] for r in rows}
    assert all(abs(taken[s] - goal[s]) <= 2 for s in goal)


def test_odd_rows(odd, none):
    out = mixing.mixed(odd).collect()
    assert len(out) == odd.count() and all(r["taken"] == 0 for r in out if r["size"] == 0)
    assert all(r["taken"] <= 2 * r["size"] for r in out)
    assert mixing.mixed(none).count() == 0
    with pytest.raises(ValueError):
        mixing.mixed(odd, share=3.0)
