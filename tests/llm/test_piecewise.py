import hashlib
import random

import pytest

from tidemark.llm import piecewise as P


def test_rows_as_by_hand(spark, sf, texts):
    ids = sorted(texts, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    out = P.fingerprinted(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert len(out) == len(texts)
    for r in out:
        own, nxt = texts[r["doc_id"]], texts[after[r["doc_id"]]]
        k = len(own) // 2
        edited = own[: len(own) - k] + nxt[:k]
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == P.fingerprint(own.encode()) and r["edited_fingerprint"] == P.fingerprint(edited.encode())
        assert r["near_edited"] == P.likeness(r["fingerprint"], r["edited_fingerprint"]) and r["near_next"] == P.likeness(r["fingerprint"], P.fingerprint(nxt.encode()))
    assert sum(r["near_edited"] for r in out) > 20 * sum(r["near_next"] for r in out)


def test_likeness():
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(800)).encode()
    other = bytes(reversed(text))
    a = P.fingerprint(text)
    assert P.likeness(a, a) == 1.0 and P.fingerprint(text) == a and P.likeness(a, P.fingerprint(other)) == 0.0
    assert P.likeness(a, P.fingerprint(text[:2000] + b"xyz" + text[2000:])) > 0.85
    assert 0.3 < P.likeness(a, P.fingerprint(text[: len(text) // 2])) < 1  # half as long: block sizes that still meet
    assert P.fingerprint(b"") == "3::" and all(len(x) <= 64 for x in P.fingerprint(b"a" * 10**6).split(":"))


@pytest.mark.parametrize("seed", range(5))
def test_common_length(seed):
    rng = random.Random(seed)
    a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 64))) for _ in range(2))
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    assert P.common_length(a, b) == row[-1]


def test_odd_rows(odd, none):
    out = P.fingerprinted(odd).collect()
    assert len(out) == odd.count() and all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in out)
    assert P.fingerprinted(none).count() == 0
    lone = P.fingerprinted(odd.where("doc_id = 6")).collect()
    assert len(lone) == 1 and lone[0]["near_next"] == 1.0
