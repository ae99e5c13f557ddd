import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, simhash


def united(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def brute(fps):
    pairs = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3) if j < i]
    return united(pairs, range(len(fps)))


@pytest.mark.parametrize("rows", [512, 4])
def test_components_as_brute_force(spark, rows):
    rng = random.Random(1)
    fps = set()
    for _ in range(25):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(rng.choice([0, 1, 3, 50])):
            x = base
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    arr = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(arr.view(np.int64))], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.components_of(df, bucket_rows=rows).collect()}
    assert got == brute(arr)


@pytest.mark.parametrize("rows", [512, 4])
def test_real_pairs_span_the_components(spark, rows):
    rng = random.Random(6)
    fps = set()
    for _ in range(20):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 4, 30])):  # chains: most of a group lies beyond the radius
            fps.add(x)
            for _ in range(rng.randint(1, 6)):
                x ^= 1 << rng.randrange(64)
    arr = np.array(sorted(fps), np.uint64)
    pairs = [(i, int(j)) for i in range(len(arr)) for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 5) if j < i]
    df = spark.createDataFrame([(int(x),) for x in arr.view(np.int64)], "fp long")
    place = {int(x): k for k, x in enumerate(arr.view(np.int64))}
    for forests in (1, 3):
        got = {(place[r["u"]], place[r["v"]]) for r in simhash.links_within(df, 5, bucket_rows=rows, forests=forests).collect()}
        assert all((arr[i] ^ arr[j]).item().bit_count() <= 5 for i, j in got)
        assert united(got, range(len(arr))) == united(pairs, range(len(arr)))


def test_lightest_forest_and_majorities():
    rng = np.random.default_rng(4)
    i, j, w = rng.integers(0, 60, 300), rng.integers(0, 60, 300), rng.integers(0, 6, 300)
    tree = simhash.lightest_forest(60, i, j, w)
    label, want = list(range(60)), []  # Kruskal's
    for k in np.argsort(w, kind="stable"):
        a, b = label[i[k]], label[j[k]]
        if a != b:
            label = [a if x == b else x for x in label]
            want.append(k)
    assert len(tree) == len(want) and w[tree].sum() == w[want].sum()
    assert len(set(united(zip(i[tree].tolist(), j[tree].tolist()), range(60)).values())) == len(set(label))
    h, bounds = rng.integers(0, 1 << 64, 30, dtype=np.uint64), np.array([0, 1, 5, 30])
    want = [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[p:q]) > q - p) for p, q in zip(bounds, bounds[1:])]
    assert simhash.majorities(bounds, h).tolist() == want and len(simhash.majorities(bounds[:1], h[:0])) == 0


def test_fingerprints_are_spark_hash_majorities(spark, texts):
    text = next(t for t in texts.values() if 30 < len(t.split()) < 300)
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
    shingles = spark.createDataFrame([(" ".join(words[k : k + 3]),) for k in range(len(words) - 2)], "s string")
    h = [r[0] % (1 << 64) for r in shingles.select(F.xxhash64("s")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(text.encode()) == want
    assert simhash.fingerprint(b" \n") == 0 and simhash.fingerprint(b"A  b") == simhash.xxhash.xxh64_intdigest(b"a b", 42)


def test_whole_table_as_brute_force(spark, sf, texts):
    ids = sorted(texts)
    fps = np.array([simhash.fingerprint(texts[i].encode()) for i in ids], np.uint64)
    roots = brute(fps)
    out = {r["doc_id"]: r for r in simhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert all(out[i]["component_id"] == ids[roots[k]] and int(out[i]["fingerprint"], 16) == int(fps[k]) for k, i in enumerate(ids))
    kept = simhash.one_of_each(spark.read.parquet(f"{sf}/documents.parquet"))
    assert {r["doc_id"] for r in kept.collect()} == {ids[r] for r in roots.values()}


def test_chains_and_stars(spark):
    rng = random.Random(2)
    pairs = [(k, k + 1) for k in range(200)] + [(500, 501 + k) for k in range(100)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(7, 7)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(df).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {n: r for n, r in united(pairs, {x for p in pairs for x in p}).items() if n in linked}
    assert components.connected_components(df.limit(0)).count() == 0
    for few in (1, 270, 10**6):  # rounds alone, rounds until so few links are left, one pass
        assert {r["node"]: r["root"] for r in components.connected_components(df, few=few).collect()} == got
        assert components.connected_components(df.limit(0), few=few).count() == 0


def test_odd_rows(odd, none):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == odd.count()
    zero = {r["component_id"] for r in out if r["fingerprint"] == "0" * 16}
    assert zero == {2} and {r["component_id"] for r in out if r["doc_id"] in (1, 6)} == {1}
    kept = simhash.one_of_each(odd).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 1, 2, 4] and simhash.one_of_each(odd).columns == odd.columns
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0
