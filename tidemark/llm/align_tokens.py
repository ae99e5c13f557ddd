"""Alignment of two tokenizers' tokens over the bytes of a text.

Both tokenizers cut the same bytes. The start of each token finds the other side's token that covers it (``merge_asof`` on
byte offsets, keyed by document); the union of both directions is every pair of tokens that overlap, and offsets at which
both sides end a token cut the text into groups. A pair of ids counts by the documents that hold it linked: blocks of
documents send each of their pairs once and get the counts of the whole corpus back.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, text_or_empty, written

#: The folder of the vocabulary files, which every executor must find; ``vocabularies`` or TIDEMARK_VOCABULARIES names another.
VOCABULARIES = os.environ.get("TIDEMARK_VOCABULARIES", "/opt/tokenizers")
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are aligned at once, and that a block holds before it is closed; a document is never in two blocks.
BATCH_BYTES = 1 << 19
BLOCK_BYTES = 1 << 22
#: Ids of either side are under this.
SIDE = 1 << 16
# Fixed value: how byte-level vocabularies of this kind cut words.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# A single space between two characters that are not white space (nor the mark that stands for a space among pieces): the
# byte-level pattern starts a new word there, and no piece has a space after another character, so neither joins over it.
_CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


def byte_of_char() -> dict[str, int]:
    """What a byte-level vocabulary writes for each byte: printable ones as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Side:
    """One tokenizer: ids of texts, and the bytes of ids."""

    def __init__(self, table: list[bytes]):
        self.lengths = np.array([len(x) for x in table], np.int64)
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def joined(self, ids: np.ndarray) -> bytes:
        """The bytes of tokens in a row."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        return self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[ids] - ends + sizes, sizes)].tobytes()


class ByteLevel(Side):
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.coder.encode_special_tokens = True
        self.quick = None
        decode = byte_of_char()
        names = sorted((i, t) for t, i in self.coder.get_vocab().items())
        table = [b""] * (names[-1][0] + 1)
        for i, name in names:
            table[i] = bytes(decode[c] for c in name) if all(c in decode for c in name) else name.encode()
        super().__init__(table)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        merged = [x if isinstance(x, str) else " ".join(x) for x in model["model"]["merges"]]
        ids = [model["model"]["vocab"][x.replace(" ", "")] for x in merged]
        if ids == sorted(ids) and model["pre_tokenizer"].get("use_regex") and not model["normalizer"] and not model["pre_tokenizer"]["add_prefix_space"]:
            # Ids are in the order of the merges, so they can serve as ranks: the same vocabulary, four times as fast.
            import tiktoken

            ranks = {table[i]: i for i in {*ids, *(model["model"]["vocab"][c] for c in decode)}}
            self.quick = tiktoken.Encoding("quick", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.quick is None:
            return [x.ids for x in self.coder.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        return [self.quick.encode_ordinary(" " + t) for t in texts]


class Pieces(Side):
    """A sentence-piece vocabulary, which puts the space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.coder = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.coder.id_to_piece(i) for i in range(self.coder.vocab_size())]
        super().__init__([bytes([int(x[3:5], 16)]) if self.coder.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.coder.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def sides(folder: str) -> tuple[Side, Side]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return ByteLevel(os.path.join(folder, BYTE_LEVEL)), Pieces(os.path.join(folder, PIECES))


@lru_cache(maxsize=1)
def _decimals() -> tuple[np.ndarray, np.ndarray]:
    """Each id's decimal digits from the left, with room for a mark after them, and their number."""
    ids = np.arange(SIDE)
    width = np.searchsorted(10 ** np.arange(1, 5), ids, side="right") + 1
    place = width[:, None] - 1 - np.arange(6)
    digits = ids[:, None] // 10 ** np.maximum(place, 0) % 10 + ord("0")
    return digits.astype(np.uint8), width


def parts_of(text: str, size: int = BATCH_BYTES) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters between which neither tokenizer joins anything; the space at a cut goes, as each part gets one."""
    begin = 0
    while len(text) - begin > size:
        cut = _CUT.search(text, begin + size)
        if cut is None:
            break
        yield text[begin : cut.start()]
        begin = cut.end()
    yield text[begin:]


@dataclass
class Aligned:
    """Parts' tokens, links and groups: arrays over all of them, and bounds of each part."""

    a: np.ndarray
    b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    link_part: np.ndarray
    links: np.ndarray  # a id * SIDE + b id of each
    groups: np.ndarray  # of each part
    marks: bytes  # groups written out, parts joined
    first_mark: np.ndarray


def align(parts: list[tuple[np.ndarray, np.ndarray]], a_side: Side, b_side: Side) -> Aligned:
    """Links and groups of parts, given both sides' ids, whose bytes are equal."""
    sizes = np.array([[len(x), len(y)] for x, y in parts], np.int64).reshape(-1, 2)
    a, b = (np.concatenate([np.empty(0, np.int32), *(p[k] for p in parts)]).astype(np.int64) for k in (0, 1))
    doc_a, doc_b = (np.repeat(np.arange(len(parts)), sizes[:, k]) for k in (0, 1))
    end_a, end_b = np.cumsum(a_side.lengths[a]), np.cumsum(b_side.lengths[b])
    start_a, start_b = end_a - a_side.lengths[a], end_b - b_side.lengths[b]

    left = pd.DataFrame({"at": start_a, "doc": doc_a, "i": np.arange(len(a))})
    right = pd.DataFrame({"at": start_b, "doc": doc_b, "j": np.arange(len(b))})
    covers_a = pd.merge_asof(left, right, on="at", by="doc")["j"].to_numpy()
    covers_b = pd.merge_asof(right, left, on="at", by="doc")["i"].to_numpy()
    new = start_a[covers_b] != start_b  # equal starts were met from the other side
    link_a, link_b = np.r_[np.arange(len(a)), covers_b[new]], np.r_[covers_a, np.flatnonzero(new)]

    total = int(end_a[-1]) if len(a) else 0
    ends = np.zeros(total + 1, np.int8)  # 1 where A ends a token, 2 where B does
    ends[end_a] = 1
    ends[end_b] += 2
    last_a, last_b = ends[end_a] == 3, ends[end_b] == 3
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    groups = np.bincount(doc_a[last_a], minlength=len(parts))
    ids, mark = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
    upto_a, upto_b = np.flatnonzero(last_a) + 1, np.r_[0, np.flatnonzero(last_b) + 1]  # tokens in and before each group, and before it
    at_a, at_b = np.arange(len(a)) + upto_b[group_a], np.arange(len(b)) + upto_a[group_b]
    ids[at_a], ids[at_b] = a, b
    mark[at_a], mark[at_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
    digits, width = _decimals()
    rows, width = digits[ids], width[ids]
    rows[np.arange(len(ids)), width] = mark
    marks = rows[np.arange(6) <= width[:, None]].tobytes()
    ends = np.r_[0, np.cumsum(width + 1)]
    first = np.r_[np.zeros((1, 2), np.int64), np.cumsum(sizes, axis=0)]
    return Aligned(a, b, first[:, 0], first[:, 1], doc_a[link_a], a[link_a] * SIDE + b[link_b], groups, marks, ends[first.sum(axis=1)])


@dataclass
class Row:
    """A document as its parts are met."""

    doc_id: object
    n: list[int] = field(default_factory=lambda: [0, 0, 0, 0])  # tokens of either side, groups, links
    sha: object = None
    pairs: list[np.ndarray] = field(default_factory=list)
    times: list[np.ndarray] = field(default_factory=list)
    whole: bool = True


def aligned_rows(ids: list, texts: Iterator[str], folder: str, batch_bytes: int = BATCH_BYTES) -> Iterator[Row]:
    """Each text's row, parts of about ``batch_bytes`` at a time; a text with a part whose bytes differ has no tokens."""
    a_side, b_side = sides(folder)
    held, size = [], 0

    def flush() -> Iterator[Row]:
        strings = [t for _, t, _ in held]
        coded = [(np.array(x, np.int32), np.array(y, np.int32)) for x, y in zip(a_side.encode(strings), b_side.encode(strings))]
        want = [(" " + t).encode() for t in strings]
        same = [all(s.joined(c) == w for s, c in zip((a_side, b_side), both)) for both, w in zip(coded, want)]
        for (row, _, _), ok in zip(held, same):
            row.whole &= ok
        good = [k for k, (row, _, _) in enumerate(held) if row.whole]
        out = align([coded[k] for k in good], a_side, b_side)
        keys, times = np.unique(out.link_part << 32 | out.links, return_counts=True)
        first = np.searchsorted(keys, np.arange(len(good) + 1) << 32)
        n_links = np.bincount(out.link_part, minlength=len(good))
        for p, k in enumerate(good):
            row = held[k][0]
            row.n = [x + int(y) for x, y in zip(row.n, (out.first_a[p + 1] - out.first_a[p], out.first_b[p + 1] - out.first_b[p], out.groups[p], n_links[p]))]
            if row.sha is None:
                row.sha = hashlib.sha256()
            else:
                row.sha.update(b";")
            row.sha.update(out.marks[out.first_mark[p] : out.first_mark[p + 1] - 1])
            row.pairs.append(keys[first[p] : first[p + 1]] & 0xFFFFFFFF)
            row.times.append(times[first[p] : first[p + 1]])
        yield from (row for row, _, last in held if last)

    for doc_id, text in zip(ids, texts):
        row, rest = Row(doc_id), parts_of(text, batch_bytes) if text else iter(())
        part = next(rest, None)
        if part is None:
            row.whole = False
            held.append((row, "", True))
        while part is not None:
            after = next(rest, None)
            held.append((row, part, after is None))
            size += len(part)
            if size >= batch_bytes:
                yield from flush()
                held, size = [], 0
            part = after
    if held:
        yield from flush()


def _block(rows: list[Row], number: int, id_type: pa.DataType) -> pa.RecordBatch:
    """A block as one row: its documents' figures, its distinct pairs with how many of its documents hold each, and each document's pairs as places among them."""
    for r in rows:
        if not r.whole:
            r.n, r.sha, r.pairs, r.times = [0, 0, 0, 0], None, [], []
        elif len(r.pairs) > 1:
            pairs, back = np.unique(np.concatenate(r.pairs), return_inverse=True)
            r.pairs, r.times = [pairs], [np.bincount(back, np.concatenate(r.times)).astype(np.int64)]
    sizes = [len(r.pairs[0]) if r.pairs else 0 for r in rows]
    pairs, place, holders = np.unique(np.concatenate([np.empty(0, np.int64), *(x for r in rows for x in r.pairs)]), return_inverse=True, return_counts=True)
    times = np.concatenate([np.empty(0, np.int64), *(x for r in rows for x in r.times)])
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    figures = [one([r.n[k] for r in rows], pa.int64()) for k in range(4)]
    sha = [r.sha.hexdigest() if r.sha else "" for r in rows]
    lists = [one(np.r_[0, np.cumsum(sizes)], pa.int64()), one(place, pa.int32()), one(times, pa.int32()), one(pairs, pa.int64()), one(holders, pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), one([r.doc_id for r in rows], id_type), *figures, one(sha, pa.string()), *lists], _BLOCK_NAMES)


_BLOCK_NAMES = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "first", "place", "times", "pairs", "holders"]
_BLOCK_TYPE = "block long, doc_id array<{id}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, first array<bigint>, place array<int>, times array<int>, pairs array<bigint>, holders array<bigint>"


def blocks_of(docs: DataFrame, folder: str, batch_bytes: int, block_bytes: int) -> DataFrame:
    """Every document of ``docs`` (doc_id, text) in one block of about ``block_bytes``, a row each."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, size, id_type = TaskContext.get().partitionId() << 32, [], 0, None
        for batch in batches:
            id_type = batch.column("doc_id").type
            text = batch.column("text")
            for row in aligned_rows(batch.column("doc_id").to_pylist(), (x.as_py() for x in text), folder, batch_bytes):
                rows.append(row)
                size += 256 + 4 * row.n[0]
                if size >= block_bytes:
                    yield _block(rows, number, id_type)
                    number, rows, size = number + 1, [], 0
        if rows:
            yield _block(rows, number, id_type)

    return docs.mapInArrow(run, _BLOCK_TYPE.format(id=kind))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best): how many documents hold each pair of ids linked, and whether no pair of its A id has more."""
    sent = blocks.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p")).select("p.pairs", "p.holders")
    counts = sent.groupBy(F.col("pairs").alias("pair")).agg(F.sum("holders").alias("count"))
    most = counts.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("count").alias("most"))  # one row an id of A at most
    return counts.join(most, F.shiftright("pair", 16) == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, vocabularies: str = VOCABULARIES, batch_bytes: int = BATCH_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level vocabulary over a space and the text, B a vocabulary of pieces that puts the space there itself;
    special tokens' strings are plain text. Null and empty texts, and those whose bytes either side does not give back (a
    text that holds the pieces' mark for a space), have no tokens: zeros and an empty digest, and they count for no pair.
    n_links counts occurrences, n_best those whose pair no other of its A id exceeds, ties included, and count_sum adds
    their pairs' documents. Rows are documents, equal ones and those with equal or null ids too; ids may be of any type,
    columns of other names are not read, and an empty table gives no rows. Long texts are cut where neither tokenizer joins,
    so that memory stays bounded but for the text itself and its distinct pairs; a text without such a place is held whole.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    blocks = written(blocks_of(rows, vocabularies, batch_bytes, block_bytes), "blocks", group_rows=1)
    counts = written(pair_counts(blocks.select("pairs", "holders")), "counts")
    asked = blocks.select(F.col("block").alias("asker"), F.posexplode("pairs").alias("at", "pair"))
    found = asked.join(counts, "pair").select("asker", "at", "count", "best")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def answer(block: pa.Table, found: pa.Table) -> pa.Table:
        flat = {c: block.column(c).combine_chunks().flatten() for c in block.column_names if c != "block"}
        first, place, times = (flat[c].to_numpy(zero_copy_only=False) for c in ("first", "place", "times"))
        order = np.argsort(found.column("at").to_numpy())
        count, best = (found.column(c).to_numpy()[order] for c in ("count", "best"))
        sums = [np.r_[0, np.cumsum(x)] for x in (times * best[place].astype(np.int64), times * count[place])]
        n_best, count_sum = (s[first[1:]] - s[first[:-1]] for s in sums)
        return pa.table([*(flat[c] for c in _BLOCK_NAMES[1:6]), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), flat["groups_sha256"]], [*_BLOCK_NAMES[1:6], "n_best", "count_sum", "groups_sha256"])

    return (
        blocks.drop("pairs", "holders")
        .groupBy("block")
        .cogroup(found.groupBy("asker"))
        .applyInArrow(answer, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    )
