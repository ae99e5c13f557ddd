import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import exact

BLANK = " \t\n\v\f\r"


def brute(rows):
    """(doc_id, keep_id, group_size, kept, sha) of each (doc_id, text), as a sorted list of text."""
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault("".join(c for c in t or "" if c not in BLANK), []).append((-len(t or ""), i is None, i or 0, k))
    out = []
    for text, members in groups.items():
        first = min(members)
        out += [(rows[m[3]][0], rows[first[3]][0], len(members), m == first, hashlib.sha256(text.encode()).hexdigest()) for m in members]
    return sorted(map(str, out))


def listed(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


@pytest.mark.parametrize("cells", [exact.MAX_CELLS, exact.SEGMENT])
def test_planted_copies_as_brute_force(spark, cells):
    rng = random.Random(3)
    rows = [(i, f"text {rng.randrange(3000)} é") for i in range(4000)] + [(9000 + i, "hot text" + " " * rng.randrange(4)) for i in range(2500)]
    rows += [(i, t) for i, t in [(None, None), (7001, ""), (7002, " \n "), (None, "text 1 é"), (5, "x y"), (5, "x y"), (6, "xy")]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert listed(exact.marked(df, max_cells=cells)) == brute(rows)


def test_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert listed(exact.marked(odd)) == brute(rows)
    assert exact.marked(none).count() == 0 and exact.unique(none).count() == 0
    kept = exact.unique(odd)
    assert kept.columns == odd.columns
    want = {(r["doc_id"], r["text_sha256"]) for r in exact.marked(odd).where("kept").collect()}
    got = [(r["doc_id"], hashlib.sha256(exact.normalised((r["text"] or "").encode())).hexdigest()) for r in kept.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_ids_of_other_types(spark):
    df = spark.createDataFrame([("b", "x y"), ("a", "xy "), (None, "x y"), ("c", "z")], "doc_id string, text string")
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact.marked(df).collect()} == {("b", "a", False), ("a", "a", True), (None, "a", False), ("c", "c", True)}


def test_only_possible_repeats_shuffle(spark):
    df = spark.createDataFrame([(i, f"t{i % 4500}") for i in range(5000)], "doc_id long, text string")
    digests = exact.digested(df.selectExpr("struct(doc_id) AS row", "text")).persist()
    both = exact.flagged(digests, exact.repeated_cells(digests, exact.filter_cells(5000)))
    suspects = {r["row"]["doc_id"] for r in both.where("suspect").collect()}
    copies = {i for i in range(5000) if i < 500 or i >= 4500}
    assert copies <= suspects and len(suspects - copies) < 45  # a hundredth of the 4,000 others at most
    assert both.count() == 5000


def test_filter_counts_to_two():
    cells = exact.cells_of(np.array([5, -3], np.int64), np.array([1 << 40 | 7, -1], np.int64), 4)
    assert all(len(set(r)) == exact.HASHES and len({c >> exact.SEGMENT_BITS for c in r}) == 1 for r in cells.tolist())
    assert exact.filter_cells(0) == exact.SEGMENT and exact.filter_cells(10**12) == exact.MAX_CELLS and exact.filter_cells(100_000) == 1 << 21
