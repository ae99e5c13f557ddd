import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import near, stages
from tidemark.llm.common import words_of
from tidemark.llm.components import connected_components


def sets_of(texts):
    return [set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else {tuple(w)} for w in ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).split() for t in texts)]


def first_of_each(ids, texts):
    """The ids that a comparison of all pairs keeps."""
    s = sets_of(texts)
    root = list(range(len(s)))
    for i in range(len(s)):
        for j in range(i):
            if 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    least = {}
    for r, i in zip(root, ids):
        least[r] = min(i, least.get(r, i))
    return set(least.values())


def changed(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"other{rng.randrange(10**6)}"
    return " ".join(out)


def test_stage_as_all_pairs(spark, sf):
    rng = random.Random(3)
    texts = []
    for _ in range(30):
        words = [f"w{rng.randrange(4000)}" for _ in range(100)]
        texts += [" ".join(words), *(changed(rng, words, n) for n in (1, 2, 2, 6))]
    hub = [f"hub{k}" for k in range(150)]
    texts += [" ".join(hub), *(changed(rng, hub, rng.choice([1, 2, 3])) for _ in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = first_of_each(range(len(texts)), texts)
    assert len(want) < 100
    for kept in (stages.drop_near_duplicates(spark, docs, sf), near.one_of_each(docs, 1)):
        assert {r["doc_id"] for r in kept.collect()} == want


def word_bits(text):
    """The majority bits of a text's distinct words, one at a time."""
    ((_, words),) = words_of(pa.array([text]))
    hashes = {int(h) for h in words.ngrams(1)[1]}
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_pivot_search_pairs_without_the_join(spark, monkeypatch):
    """With no bands to suspect texts and no join after it, the search alone joins what is similar and within its radius."""
    rng = random.Random(11)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(4000)}" for _ in range(90)]
        texts += [" ".join(words), *(changed(rng, words, n) for n in (1, 1, 2, 9)[: rng.randrange(5)])]
    bits, s = [word_bits(t) for t in texts], sets_of(texts)
    root = list(range(len(texts)))
    beyond = 0
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]):
                if (bits[i] ^ bits[j]).bit_count() <= near.RADIUS:
                    a, b = root[i], root[j]
                    root = [min(a, b) if r in (a, b) else r for r in root]
                else:
                    beyond += 1
    assert beyond and len(set(root)) < len(root) - 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r["doc_id"] for r in near.one_of_each(docs).collect()}
    assert whole == first_of_each(range(len(texts)), texts)  # the join adds those beyond the radius
    sketches = near.sketches
    monkeypatch.setattr(near, "sketches", lambda *a: sketches(*a).withColumn("bands", F.array(F.col("row"))))
    monkeypatch.setattr(near, "similar_roots", lambda members, sets, links, centres: connected_components(links))
    assert {r["doc_id"] for r in near.one_of_each(docs).collect()} == set(root) >= whole


def test_equal_fingerprints_of_different_texts(spark):
    """Texts of the same words in another order have one fingerprint: only those that the check finds similar are joined."""
    words = [f"v{k}" for k in range(120)]
    texts = [" ".join(words), " ".join(words[::-1]), " ".join(words[100:] + words[:100]), " ".join(words[7:] + words[:7][::-1]), " ".join(words[::-1][3:] + words[::-1][:3])]
    assert len({word_bits(t) for t in texts}) == 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in near.one_of_each(docs).collect()} == first_of_each(range(5), texts) == {0, 1}


def test_rounds_link_what_is_still_apart(spark, monkeypatch):
    """What a round has joined takes no part in later ones: each round's links lead from one group to another, and all of them come together once."""
    rng = random.Random(5)
    sets, members = [], []
    for key in range(3):
        shingles = list(range(key << 20, (key << 20) + 100))
        for n in range(40):  # a chain of sets in one bucket: its ends are not similar
            sets.append(np.sort(np.array(shingles, np.uint64)))
            shingles[(n * 7) % 100 : (n * 7) % 100 + 3] = [rng.randrange(1 << 40, 1 << 50) for _ in shingles[(n * 7) % 100 : (n * 7) % 100 + 3]]
            members.append((key, len(members), len(sets[-1]), 0))
    want = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if near.similar(sets[i].tobytes(), sets[j].tobytes()):
                x, y = want[i], want[j]
                want = [min(x, y) if r in (x, y) else r for r in want]
    root, calls, stars = {}, [], []

    def spy(links, **options):
        rows = [tuple(r) for r in links.collect()]
        calls.append([root.get(a, a) != root.get(b, b) for a, b in rows])
        out = connected_components(links, **options)
        now = {r["node"]: r["root"] for r in out.collect()}
        for k in {*root, *now}:
            root[k] = now.get(root.get(k, k), root.get(k, k))
        stars.append(now)
        return out

    monkeypatch.setattr(near, "connected_components", spy)
    rows = spark.createDataFrame(members, "key long, fp long, n long, pos long").coalesce(1)
    held = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(sets)], "of_fp long, shingles binary").coalesce(1)
    got = {r["node"]: r["root"] for r in near.similar_roots(rows, held, None, 1).collect()}
    assert [got.get(k, k) for k in range(len(sets))] == want and len(set(want)) < 20
    assert len(calls) > 2 and all(all(c) for c in calls[:-1])
    assert len(calls[-1]) == sum(len(x) for x in stars[:-1])


def test_long_texts_in_pieces(spark):
    """A text's fingerprint and set do not depend on how it is cut."""
    text = " ".join(f"word{k * k % 7919}" for k in range(400_000))
    (shingles, words), = near.row_sets(pa.array([text]), near.SHINGLE, 1)
    assert len(text) > 2 << 20 and len(words[1]) == len(set(text.split()))
    assert int(near.majorities(*words)[0]) == int(near.majorities(np.array([0, len(words[1])]), words[1][::-1].copy())[0])
    assert len(shingles[1]) == len(set(zip(*[text.split()[k:] for k in range(5)])))


def test_many_pairs_and_any_order(spark, monkeypatch):
    """The result is the same where pairs are too many to be sent along, and whatever the sketch says of frequencies."""
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(900)}" for _ in range(60)]
        texts += [" ".join(words), *(changed(rng, words, 1) for _ in range(rng.randrange(4)))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = first_of_each(range(len(texts)), texts)
    assert {r["doc_id"] for r in near.one_of_each(docs).collect()} == want
    monkeypatch.setattr(near, "FEW_PAIRS", 0)
    noise = np.random.default_rng(1).integers(0, 9, near.CELLS).astype(np.uint8)
    monkeypatch.setattr(near, "frequencies", lambda sets: noise)
    assert {r["doc_id"] for r in near.one_of_each(docs).collect()} == want


def test_sketch_counts_shingles(spark):
    keys = np.sort(np.array([5 << 60, 3 << 50, 7, 1 << 63], np.uint64))
    sets = spark.createDataFrame([(i, bytearray(keys[: 2 + i % 3].tobytes())) for i in range(30)], "of_fp long, shingles binary")
    levels = near.frequencies(sets)
    want = {int(c): 0 for c in near.cell_of(keys)}
    for i in range(30):
        for c in near.cell_of(keys[: 2 + i % 3]):
            want[int(c)] += 1
    assert {c: int(levels[c]) for c in want} == {c: int(4 * np.log2(1 + n)) for c, n in want.items()} and (levels > 0).sum() == len(want)
    assert near.rarest(keys, levels).tolist() == [int(np.argmin(levels[near.cell_of(keys)]))]


def test_similarity_is_exact():
    texts = ["a b c d e f g h i j k l m", "a b c d e f g h i j k l m n", "A b  c", "", " \n", None, "x y z", "a b c d e f g h i j k l", "z " * 50]
    got = []
    for _, words in words_of(pa.array(texts, pa.string())):
        bounds, hashes = near.shingle_sets(words)
        got += [hashes[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
    want = sets_of([t or "" for t in texts])
    assert [len(g) // 8 for g in got] == [len(w) for w in want]
    for a, x in zip(want, got):
        for b, y in zip(want, got):
            assert near.similar(x, y) == (5 * len(a & b) >= 4 * len(a | b))
    assert len(np.unique(near._FACTORS)) == near.BANDS * near.ROWS


def test_odd_rows(odd, none):
    kept = near.one_of_each(odd).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 1, 2, 4] and near.one_of_each(odd).columns == odd.columns
    assert near.one_of_each(none).count() == 0
