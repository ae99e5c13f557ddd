"""Language-model scoring by deleted interpolation.

Bigram, unigram and uniform maximum-likelihood estimates are mixed with weights that depend on how often the context was
seen. Counts come from one part of the training documents, and expectation-maximisation over the tokens of the other part
learns the weights; the scores then use the counts of both.

Counting is a shuffle of packed arrays. Documents are dealt to blocks; a block sends the sorted hashes of its distinct
n-grams, with its own counts, to parts of the hash space, and each part sends back what the other blocks had. A block so
sends every n-gram once however often it occurs, nothing is dropped, and no n-gram or word is too frequent for one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, row_hash, text_or_empty, words_of, written

#: Bytes of text in a block, and n-grams of all blocks that meet in a part: what a task holds at once.
BLOCK_BYTES = 6_000_000
PART_NGRAMS = 3_000_000
#: One training document in so many is held out for the mixture weights.
HELD_OUT = 10
FIT, DEV, OTHER = 0, 1, 2
#: Steps to an octave in which the estimates of held-out tokens are tallied, and rounds of expectation-maximisation.
STEPS = 8
ROUNDS = 100

_END = np.uint64(0x5851F42D4C957F2D)
_BEGIN = np.uint64(0x14057B7EF767814F)
_ONE = np.uint64(1)
_PAIR = np.uint64(0xA24BAED4963EE407)


def unigram_key(token: np.ndarray) -> np.ndarray:
    return mix(np.asarray(token, np.uint64) + _PAIR) & ~_ONE


def bigram_key(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(before * _PAIR + token) | _ONE


_BEGIN_KEY = unigram_key(np.array([_BEGIN]))[0]


def block_tokens(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token, token before) of all words of a block's texts and an end after each text; before the first stands a mark."""
    rows, tokens, befores, base = [], [], [], 0
    for chunk in texts.chunks:
        for lo, words in words_of(chunk):
            row, token = with_ends(words)
            before = np.empty_like(token)
            before[1:] = token[:-1]
            before[np.flatnonzero(np.diff(row, prepend=-1))] = _BEGIN
            if words.before and len(token):  # a later piece of a long text goes on after the last one's words
                before[0] = words.hashes[words.lead - 1]
            rows.append(row + (base + lo))
            tokens.append(token)
            befores.append(before)
        base += len(chunk)
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(rows), np.concatenate(tokens), np.concatenate(befores)


def with_ends(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of the words with an end token after each row's; a text in pieces ends with its last one."""
    if words.lead or words.more:
        token = words.hashes[words.fresh]
        token = token if words.more else np.append(token, _END)
        return np.zeros(len(token), np.int64), token
    n = len(words.hashes)
    token, row = np.empty(n + words.rows, np.uint64), np.empty(n + words.rows, np.int64)
    at = np.arange(n) + words.row
    token[at], row[at] = words.hashes, words.row
    ends = words.first[1:] + np.arange(words.rows)
    token[ends], row[ends] = _END, np.arange(words.rows)
    return row, token


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted keys as differences in planes of bytes, of which the high ones are empty and compress away."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel())


def pack_counts(counts: np.ndarray) -> bytes:
    return counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel()


def part_bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of the hash space begins in sorted ``keys``, and their end."""
    at = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(at, np.arange(parts + 1).astype(np.uint64))


def block_ngrams(token: np.ndarray, before: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of a block and how often each occurs; the mark before a text counts as a context only."""
    keys = np.concatenate([unigram_key(token), bigram_key(before, token), np.full(texts, _BEGIN_KEY)])
    return np.unique(keys, return_counts=True)


def requests(docs: DataFrame, parts: int) -> DataFrame:
    """(part, block, kind, keys, counts): what each block (block, kind, text) holds in each part."""

    def run(table: pa.Table) -> pa.Table:
        block, kind = table.column("block")[0].as_py(), table.column("kind")[0].as_py()
        _, token, before = block_tokens(table.column("text"))
        keys, counts = block_ngrams(token, before, table.num_rows)
        bounds = part_bounds(keys, parts)
        full = np.flatnonzero(np.diff(bounds))
        spans = [slice(bounds[p], bounds[p + 1]) for p in full]
        return pa.table(
            {
                "part": pa.array(full, pa.int64()), "block": pa.array(np.full(len(full), block), pa.int64()), "kind": pa.array(np.full(len(full), kind), pa.int32()),
                "keys": pa.array([pack_sorted(keys[s]) for s in spans], pa.binary()), "counts": pa.array([pack_counts(counts[s]) for s in spans], pa.binary()),
            }
        )

    return docs.select("block", "kind", "text").groupBy("block").applyInArrow(run, "part long, block long, kind int, keys binary, counts binary")


def replies(asked: DataFrame) -> DataFrame:
    """(block, part, seen, fitted, totals): counts over all training blocks, and over the fitted ones for held-out blocks.

    They stand in the order of the block's keys. Rows with a null block carry a part's totals: tokens and distinct words
    of the training documents and of the fitted ones.
    """

    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        keys = [unpack_sorted(x.as_py()) for x in table.column("keys")]
        counts = [unpack_counts(x.as_py()) for x in table.column("counts")]
        sizes = [len(k) for k in keys]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        n, kind = np.concatenate(counts), np.repeat(kinds, sizes)
        fitted = np.bincount(at, weights=n * (kind == FIT), minlength=len(distinct)).astype(np.int64)
        seen = np.bincount(at, weights=n * (kind != OTHER), minlength=len(distinct)).astype(np.int64)
        word = ((distinct & _ONE) == 0) & (distinct != _BEGIN_KEY)
        totals = [[int(c[word].sum()), int((c[word] > 0).sum())] for c in (seen, fitted)]
        ends = np.cumsum(sizes)
        own = [at[e - s : e] for s, e in zip(sizes, ends)]
        part = table.column("part")[0].as_py()
        return pa.table(
            {
                "block": pa.array([*table.column("block").to_pylist(), None], pa.int64()), "part": pa.array(np.full(len(own) + 1, part), pa.int64()),
                "seen": pa.array([*(pack_counts(seen[i] - (c if k != OTHER else 0)) for i, c, k in zip(own, counts, kinds)), None], pa.binary()),
                "fitted": pa.array([*(pack_counts(fitted[i]) if k == DEV else None for i, k in zip(own, kinds)), None], pa.binary()),
                "totals": pa.array([*[None] * len(own), [*totals[0], *totals[1]]], pa.list_(pa.int64())),
            }
        )

    return asked.groupBy("part").applyInArrow(run, "block long, part long, seen binary, fitted binary, totals array<long>")


class Block:
    """A block's tokens with the counts that came back for its n-grams."""

    def __init__(self, texts: pa.Table, answer: pa.Table, column: str, training: bool):
        self.row, token, before = block_tokens(texts.column("text"))
        uni, bi = unigram_key(token), bigram_key(before, token)
        keys, counts = block_ngrams(token, before, texts.num_rows)
        answer = answer.sort_by("part")
        total = np.concatenate([unpack_counts(x.as_py()) for x in answer.column(column)])
        if column == "seen" and training:
            total = total + counts
        look = lambda k: total[np.searchsorted(keys, k)]
        self.unigram, self.bigram, self.context = look(uni), look(bi), look(unigram_key(before))


def bucket_of(context: np.ndarray) -> np.ndarray:
    """Bucket of a context's count: 0 if it is new, else 1 more than the logarithm's whole part."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0)


N_BUCKETS = 64


def held_out_tally(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """(bucket, bi, uni, n): held-out tokens by context bucket and by their bigram and unigram estimates, on a logarithmic grid.

    bi: STEPS * log2(bigram estimate), uni: STEPS * log2(unigram count), rounded; null where the count is 0.
    """

    def run(texts: pa.Table, answer: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("bucket", "bi", "uni", "n")})
        b = Block(texts, answer, "fitted", False)
        none = -(1 << 30)
        with np.errstate(divide="ignore"):
            bi = np.where(b.bigram > 0, np.rint(STEPS * (np.log2(np.maximum(b.bigram, 1)) - np.log2(np.maximum(b.context, 1)))), none)
            uni = np.where(b.unigram > 0, np.rint(STEPS * np.log2(np.maximum(b.unigram, 1))), none)
        cells, n = np.unique(np.stack([bucket_of(b.context), bi.astype(np.int64), uni.astype(np.int64)]), axis=1, return_counts=True)
        signed = lambda x: pa.array(x, pa.int64(), mask=x == none)
        return pa.table({"bucket": pa.array(cells[0]), "bi": signed(cells[1]), "uni": signed(cells[2]), "n": pa.array(n.astype(np.int64))})

    left, right = docs.select("block", "text").groupBy("block"), answers.select("block", "part", "fitted").groupBy("block")
    cells = left.cogroup(right).applyInArrow(run, "bucket long, bi long, uni long, n long")
    return cells.groupBy("bucket", "bi", "uni").agg(F.sum("n").alias("n"))


def em_weights(cells: np.ndarray, tokens: int, words: int, rounds: int = ROUNDS) -> np.ndarray:
    """(bucket, weights of the bigram, unigram and uniform estimates), from cells (bucket, bi, uni, n) with NaN for null."""
    weights = np.full((N_BUCKETS, 3), 1 / 3)
    bucket, n = cells[:, 0].astype(np.int64), cells[:, 3]
    p = np.stack([np.nan_to_num(2.0 ** (cells[:, 1] / STEPS)), np.nan_to_num(2.0 ** (cells[:, 2] / STEPS)) / max(tokens, 1), np.full(len(cells), 1 / (words + 1))], axis=1)
    p[bucket == 0, 0] = 0
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        total = np.stack([np.bincount(bucket, weights=share[:, k], minlength=N_BUCKETS) for k in range(3)], axis=1)
        some = total.sum(axis=1) > 0
        weights[some] = total[some] / total[some].sum(axis=1, keepdims=True)
    some = np.bincount(bucket, minlength=N_BUCKETS) > 0
    known = np.flatnonzero(some)
    for b in np.flatnonzero(~some):  # a bucket without held-out tokens takes the nearest one's weights
        if len(known):
            weights[b] = weights[known[np.argmin(np.abs(known - b))]]
    weights[0] += [0, weights[0, 0], 0]  # a new context has no bigram estimate
    weights[0, 0] = 0
    weights = np.maximum(weights, [0, 0, 1e-7])
    return weights / weights.sum(axis=1, keepdims=True)


def scored(docs: DataFrame, seed: int = 2, block_bytes: int = BLOCK_BYTES, part_ngrams: int = PART_NGRAMS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs`` (doc_id, text).

    Training documents are those whose crc32(doc_id as text) mod 5 is not 1; a null doc_id trains too. A-Z are lowered,
    words are split at ASCII white space, and an end follows each text; a null text is empty, which leaves its end.
    n_known: tokens seen in training; base_score: log10 of add-half unigram probabilities; score: log10 of the model's.
    Without training documents both are those of one unseen token type. Repeated rows count, and are scored, each; they
    are dealt to one block, as is a text of any length, whose tokens (some 60 bytes for a word) a task holds at once. There
    are no ties. Other columns are not read; an empty table gives an empty one.
    """
    base = docs.select("doc_id", text_or_empty().alias("text"))
    base = base.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False)))
    size, rows = base.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    blocks = max(1, -(-(size or 0) // block_bytes))
    parts = max(1, -(-((size or 0) // 3 + 2 * rows) // part_ngrams))  # about two n-grams to six bytes
    draw = row_hash("doc_id", "text", seed=seed)
    # A block holds documents of one kind.
    kind = F.when(F.col("held_out"), OTHER).when(F.pmod(draw, F.lit(HELD_OUT)) == 0, DEV).otherwise(FIT)
    base = base.withColumn("kind", kind).withColumn("block", F.pmod(F.shiftrightunsigned(draw, 16), F.lit(blocks)) * 3 + F.col("kind"))
    answers = written(replies(requests(base, parts)), "counts")
    totals = answers.where("block is null").agg(*[F.sum(F.col("totals")[k]).alias(str(k)) for k in range(4)]).first()
    tokens, words, fit_tokens, fit_words = (int(x or 0) for x in totals)
    answers = answers.where("block is not null")
    tally = held_out_tally(base.where(F.col("kind") == DEV), answers.where(F.col("fitted").isNotNull())).toPandas()  # the grid bounds it
    tally = tally.sort_values(["bucket", "bi", "uni"])  # the same sums in every run
    weights = em_weights(tally[["bucket", "bi", "uni", "n"]].to_numpy(float), fit_tokens, fit_words)

    def run(texts: pa.Table, answer: pa.Table) -> pa.Table:
        b = Block(texts, answer, "seen", texts.column("kind")[0].as_py() != OTHER)
        w = weights[np.minimum(bucket_of(b.context), N_BUCKETS - 1)]
        p = w[:, 0] * b.bigram / np.maximum(b.context, 1) + w[:, 1] * b.unigram / max(tokens, 1) + w[:, 2] / (words + 1)
        by_row = lambda x=None: np.bincount(b.row, weights=x, minlength=texts.num_rows)
        plain = np.log10((b.unigram + 0.5) / (tokens + 0.5 * (words + 1)))
        return pa.table(
            {
                "doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": pa.array(by_row().astype(np.int64)),
                "n_known": pa.array(by_row((b.unigram > 0).astype(float)).astype(np.int64)), "train_tokens": pa.array(np.full(texts.num_rows, tokens)),
                "base_score": pa.array(by_row(plain)), "score": pa.array(by_row(np.log10(p))),
            }
        )

    schema = f"doc_id {base.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return base.groupBy("block").cogroup(answers.select("block", "part", "seen").groupBy("block")).applyInArrow(run, schema)
