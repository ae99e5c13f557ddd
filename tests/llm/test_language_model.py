import collections
import math
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import language_model as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


@pytest.mark.parametrize(("block", "part"), [(6_000_000, 3_000_000), (40_000, 5_000)])
def test_base_scores_and_counts_are_exact(spark, sf, texts, block, part):
    out = lm.scored(spark.read.parquet(f"{sf}/documents.parquet"), block_bytes=block, part_ngrams=part).collect()
    counts = collections.Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    assert len(out) == len(texts)
    for r in out:
        t = tokens(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(counts[x] > 0 for x in t), n)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), rel_tol=1e-9)


def test_scores_are_the_interpolated_model(spark):
    """Against a plain count of bigrams with the weights that the operator learned."""
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 23}" for k in range(40))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learned = {}
    original = lm.em_weights

    def spy(*args, **kwargs):
        learned["w"] = original(*args, **kwargs)
        return learned["w"]

    lm.em_weights = spy
    try:
        out = {r["doc_id"]: r["score"] for r in lm.scored(docs).collect()}
    finally:
        lm.em_weights = original
    uni, bi, ctx = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            seq = ["<s>", *tokens(t)]
            uni.update(seq[1:])
            ctx.update(seq[:-1])
            bi.update(zip(seq, seq[1:]))
    n, v = sum(uni.values()), len(uni)
    for i, t in rows[:40]:
        seq, want = ["<s>", *tokens(t)], 0.0
        for a, b in zip(seq, seq[1:]):
            w = learned["w"][int(lm.bucket_of(np.array([ctx[a]]))[0])]
            want += math.log10(w[0] * (bi[a, b] / ctx[a] if ctx[a] else 0) + w[1] * uni[b] / n + w[2] / (v + 1))
        assert math.isclose(out[i], want, rel_tol=1e-9)


def test_em_finds_the_mixture():
    cells = np.array([[3, -8.0, 8.0, 900.0], [3, np.nan, 8.0, 100.0]])
    w = lm.em_weights(cells, tokens=1000, words=50)
    assert np.allclose(w.sum(axis=1), 1) and w[3, 0] > 0.8 and w[0, 0] == 0 and (w[:, 2] > 0).all()


def test_held_out_text_that_repeats_training_text_scores_better(spark, sf):
    out = lm.scored(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert out["sum(score)"] > out["sum(base_score)"]


def test_odd_rows(odd, none):
    out = lm.scored(odd).collect()
    assert len(out) == odd.count() and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in out)
    assert {r["n_tokens"] for r in out if r["doc_id"] in (2, 3, 5)} == {1}
    assert lm.scored(none).count() == 0
