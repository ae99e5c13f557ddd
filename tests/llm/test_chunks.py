import random

import numpy as np
import pytest

from tidemark.llm import chunks


def text(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqré") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_chunks_cover_the_text_and_resist_insertions():
    rng = random.Random(2)
    data = text(rng, 2000).encode()
    for d in (data, b"", b"a", b"a" * 5000, data[:17]):
        ends = chunks.cuts(np.frombuffer(d, np.uint8))
        sizes = np.diff(ends, prepend=0)
        assert sizes.sum() == len(d) and (not len(d) or (ends[-1] == len(d) and sizes.max() <= chunks.MAX_CHUNK and sizes.min() > 0))
    parts = lambda d: {d[a:b] for a, b in zip([0, *chunks.cuts(np.frombuffer(d, np.uint8))[:-1]], chunks.cuts(np.frombuffer(d, np.uint8)))}
    changed = data[:3000] + b"some inserted words" + data[3000:]
    assert len(parts(data) & parts(changed)) >= 0.95 * len(parts(data))
    ends = chunks.cuts(np.frombuffer(data, np.uint8))
    whole = chunks.digests(np.frombuffer(data, np.uint8), ends)
    assert len(set(whole.tolist())) == len(parts(data))


def test_repeated_passages_go_once_and_clean_rows_stay(spark):
    rng = random.Random(5)
    passages = [text(rng, 55) for _ in range(20)]
    rows, planted = [], {}
    for i in range(300):
        t = text(rng, 80)
        if i % 2 == 0:
            p = passages[i // 2 % 20]
            t = f"{t} {p}\n{text(rng, 60)}"
            planted.setdefault(p, []).append(i)
        rows.append((i, t))
    out = {r["doc_id"]: r for r in chunks.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    original = dict(rows)
    for i in range(300):
        assert out[i]["dedup"]["repeated"] == (i % 2 == 0)
        if i % 2:
            assert out[i]["text"] == original[i]
    for p, ids in planted.items():
        middle = p[len(p) // 3 : 2 * len(p) // 3]
        assert [i for i in ids if middle in out[i]["text"]] == ids[:1]
        for i in ids[1:]:
            assert out[i]["dedup"]["removed_chars"] >= 0.6 * len(p)
            assert set(out[i]["text"].split()) <= set(original[i].split())


def test_brute_force_on_whole_copies(spark):
    rng = random.Random(6)
    a, b = text(rng, 200), text(rng, 200)
    docs = spark.createDataFrame([(3, a), (1, a), (2, b), (9, f"{b} {a}")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in chunks.dedup(docs).collect()}
    assert out[1] == a and out[2] == b and out[3] == "" and len(out[9]) < 0.2 * len(f"{b} {a}")


def test_odd_rows(odd, none):
    with pytest.raises(ValueError):
        chunks.dedup(odd)
    out = chunks.dedup(odd, named="cut").collect()
    assert len(out) == odd.count()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r["text"])
    assert by[2] == [None] and by[3] == [""] and by[1] == ["a b c", "a b c"]
    assert chunks.dedup(none, named="cut").count() == 0
    assert chunks.dedup(odd, named="cut").columns == [*odd.columns, "cut"]


def test_repeats_inside_one_text(spark):
    rng = random.Random(7)
    p, mid = text(rng, 60), text(rng, 60)
    out = chunks.dedup(spark.createDataFrame([(1, f"{p} {mid} {p}")], "doc_id long, text string")).first()
    assert out["text"].startswith(p) and out["dedup"]["removed_chars"] > 0.6 * len(p) and mid in out["text"]


def test_rows_without_an_id_are_documents_of_their_own(spark):
    rng = random.Random(8)
    passages = [text(rng, 70) for _ in range(3)]
    rows, original = [], []
    for i in range(1200):  # of 1,200 texts, about ten pairs agree in 16 bits of a hash
        t = f"{text(rng, 5 + i % 90)} {passages[i % 3]} {text(rng, 20)}"
        rows.append((None, t, i))
        original.append(t)
    rows += [((1 << 63) - 1, f"{passages[0]} end", 1200), (7, f"{text(rng, 9)} {passages[1]}", 1201)]
    out = {r["n"]: r for r in chunks.dedup(spark.createDataFrame(rows, "doc_id long, text string, n long")).collect()}
    middle = [p[len(p) // 3 : 2 * len(p) // 3] for p in passages]
    assert middle[0] in out[1200]["text"] and middle[1] in out[1201]["text"]
    assert [sum(m in out[i]["text"] for i in range(1200)) for m in middle] == [0, 0, 1]
    for i in range(1200):
        start = original[i].index(passages[i % 3])
        for s in out[i]["dedup"]["spans"]:
            assert start - 70 <= s["start"] < s["end"] <= start + len(passages[i % 3].encode()) + len(original[i].encode()) - len(original[i]) + 70


def test_a_group_is_one_text(spark):
    rng = random.Random(9)
    p = text(rng, 70)
    docs = spark.createDataFrame([(k, f"{p} {text(rng, 30)}") for k in (None, None, None, 4, 4)], "id long, text string").selectExpr("id", "xxhash64(text) AS key", "text")
    found = chunks.repeated_chunks(docs)
    assert found.count() == 5 and found.where("size(chunks) > 60").count() == 0


def shared_windows(rows, n=51, different=6):
    """Ids of the rows that hold a window of ``n`` words, so many of them different, which stands elsewhere too."""
    where = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - n + 1):
            if len(set(w[k : k + n])) >= different:
                where.setdefault(" ".join(w[k : k + n]), []).append(i)
    return {i for ids in where.values() if len(ids) > 1 for i in ids}


def test_words_decide_what_a_passage_is_in_any_script(spark):
    """Against all windows of 51 words; passages of 30 and 40 words are none, whatever bytes a word has."""
    rng = random.Random(11)
    kinds = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщ", "digits": "0123456789"}
    most = {"latin": 9, "cyrillic": 7, "digits": 4}
    rows, long, short = [], set(), set()
    for kind, letters in kinds.items():
        said = lambda n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, most[kind]))) for _ in range(n))  # noqa: B023, E731
        for n, ids in ((56, long), (30, short), (35, short)):
            for _ in range(25):
                p = said(n)
                for _ in range(3):
                    rows.append((len(rows), f"{said(50)} {p} {said(50)}"))
                    ids.add(len(rows) - 1)
        rows += [(len(rows) + k, said(150)) for k in range(50)]
    want = shared_windows(rows)
    got = {r["doc_id"] for r in chunks.dedup(spark.createDataFrame(rows, "doc_id long, text string")).where("dedup.repeated").collect()}
    assert want == long and len(got & want) >= 0.98 * len(want) and len(got & short) <= 0.03 * len(short) and not got - long - short


def test_whole_table_as_all_windows(spark, sf, texts):
    """Every text with a window of 51 words that stands elsewhere is found, but for windows of one phrase over and over, which may be; what is found holds such a window."""
    want = shared_windows(texts.items())
    got = {r["doc_id"] for r in chunks.dedup(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).where("dedup.repeated").collect()}
    assert len(want & got) >= 0.99 * len(want) and len(got - shared_windows(texts.items(), 40, different=1)) <= 0.01 * len(texts)
