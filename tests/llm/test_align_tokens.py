import hashlib
import os
import random
from collections import Counter
from urllib.parse import urlparse

import pyarrow.parquet as pq
import pytest

from tidemark.llm import align_tokens as at

SPECIAL = ["<|endoftext|> <s> x </s>", "a  b   c\n\n d ", "mark ▁ inside", "\x00 nul", "émoji 👩‍👩‍👧 汉字漢字かな", "<0x41> don't I'LL", "x" * 3000, " lead", "tab\tend\t"]


def brute(rows):
    """The contract's columns for (doc_id, text) rows, token by token."""
    from tokenizers import Tokenizer
    import sentencepiece

    t = Tokenizer.from_file(os.path.join(at.VOCABULARIES, at.BYTE_LEVEL))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=os.path.join(at.VOCABULARIES, at.PIECES))
    chars = at.byte_of_char()
    out, held = [], []
    for _, text in rows:
        want = (" " + (text or "")).encode()
        a = [(i, bytes(chars[c] for c in t.id_to_token(i))) for i in t.encode(" " + (text or ""), add_special_tokens=False).ids] if text else []
        b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)] if text else []
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            a = b = []
        spans = []
        for side in (a, b):
            p, s = 0, []
            for i, x in side:
                s.append((p, p + len(x), i))
                p += len(x)
            spans.append(s)
        links, lo = [], 0
        for s, e, i in spans[0]:
            while lo < len(spans[1]) and spans[1][lo][1] <= s:
                lo += 1
            k = lo
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [";".join("|".join(",".join(str(i) for s, e, i in side if lo <= s < hi) for side in spans) for lo, hi in zip([0, *cuts], cuts))] if len(want) < 5000 else [None]
        out.append((len(a), len(b), len(cuts), links, groups[0]))
        held.append(set(links))
    counts = Counter(p for h in held for p in h)
    most = {}
    for (i, _), n in counts.items():
        most[i] = max(n, most.get(i, 0))
    return [
        (doc_id, na, nb, ng, len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), None if g is None else hashlib.sha256(g.encode()).hexdigest() if na else "")
        for (doc_id, _), (na, nb, ng, links, g) in zip(rows, out)
    ]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:7] == w[:7] and (w[7] is None or g[7] == w[7]), (g, w)


@pytest.mark.parametrize("batch, block", [(at.BATCH_BYTES, at.BLOCK_BYTES), (300, 2000)])
def test_as_brute_force(spark, texts, batch, block):
    rows = [(i, t) for i, t in sorted(texts.items()) if len(t or "") < 3000][:90] + [(1000 + k, t) for k, t in enumerate(SPECIAL)]
    rows += [(1000, SPECIAL[0]), (None, "null id"), (2000, None), (2001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(at.aligned(df, batch_bytes=batch, block_bytes=block).collect(), brute(rows))


def test_readers_hold_one_block_at_a_time(spark, texts, monkeypatch):
    # A task may read hundreds of blocks, and readers decode a row group's rows together.
    files, written = {}, at.written
    monkeypatch.setattr(at, "written", lambda df, name, **how: files.setdefault(name, written(df, name, **how)))
    rows = [(i, t) for i, t in sorted(texts.items()) if len(t or "") < 3000][:90]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    same(at.aligned(df, block_bytes=2000).collect(), brute(rows))
    tables = [pq.ParquetFile(urlparse(f).path).metadata for f in files["blocks"].inputFiles()]
    assert sum(t.num_rows for t in tables) > 20
    assert max(t.row_group(k).num_rows for t in tables for k in range(t.num_row_groups)) == 1


def test_parts_join_to_the_whole(texts):
    rng = random.Random(2)
    a, b = at.sides(at.VOCABULARIES)
    for text in [t for t in texts.values() if t and len(t) > 500][:40] + SPECIAL:
        text = text + "".join(rng.choice([" ", "  ", "\n", "▁", "é", "x", " 1", "'s", ".", " ", "漢"]) for _ in range(300))
        parts = list(at.parts_of(text, 60))
        assert " ".join(parts) == text
        if "▁" not in text:
            for side in (a, b):
                assert sum(side.encode(parts), []) == side.encode([text])[0]


def test_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    same(at.aligned(odd).collect(), brute(rows))
    assert at.aligned(none).count() == 0
    named = at.aligned(spark.createDataFrame([("a", "some text"), ("b", "")], "doc_id string, text string")).collect()
    assert {(r["doc_id"], r["n_groups"] > 0, r["groups_sha256"] == "") for r in named} == {("a", True, False), ("b", False, True)}


def test_the_quick_coder_is_the_vocabulary(texts):
    rng = random.Random(5)
    side, _ = at.sides(at.VOCABULARIES)
    assert side.quick is not None
    odd = ["".join(chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x20000), 32, 32, 10, 39])) for _ in range(60)) for _ in range(400)]
    many = [t for t in texts.values() if t][:60] + SPECIAL + odd + [" " * 5000, "\n" * 3000 + "x"]
    assert [e.ids for e in side.coder.encode_batch_fast([" " + t for t in many], add_special_tokens=False)] == side.encode(many)
