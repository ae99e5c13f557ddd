"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last bytes ends a piece wherever it hits a value that comes once in a block size; each piece gives
one character of a signature. A fingerprint holds the signatures at a block size and at twice that. Fingerprints compare
at equal or doubled block sizes, by the edit distance of insertions and deletions between signatures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import digests
from .common import shuffle_parts, text_or_empty

WINDOW = 7
LEAST_BLOCK = 3
#: Characters of a signature, at the block size and at twice that.
LENGTH, HALF = 64, 32
#: Signatures without a common run of so many characters (or half the shorter one's) are unlike.
COMMON = 7

_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_FACTOR = 0x01000193


def rolling(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the last ``WINDOW`` bytes at each place; bytes before the text count as absent."""
    byte = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    h = byte.copy()
    for k in range(1, min(WINDOW, len(data))):
        h[k:] += byte[:-k] * np.uint32(pow(_FACTOR, k, 1 << 32))
    h ^= h >> np.uint32(15)
    return h


def signature(data: np.ndarray, ends: np.ndarray, most: int) -> str:
    """One character for each piece; pieces beyond ``most`` join the last one."""
    ends = ends[: most - 1]
    if not len(ends) or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    return _ALPHABET[(digests(data, ends) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: bytes) -> str:
    """``block size:signature:signature at twice the block size``."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return f"{LEAST_BLOCK}::"
    size = LEAST_BLOCK
    while size * LENGTH < len(data):
        size *= 2
    h = rolling(data)
    while True:
        at = np.flatnonzero(h % np.uint32(size) == size - 1)
        if size == LEAST_BLOCK or len(at) + 1 >= LENGTH // 2:
            break
        size //= 2
    twice = at[h[at] % np.uint32(2 * size) == 2 * size - 1]
    return f"{size}:{signature(data, at + 1, LENGTH)}:{signature(data, twice + 1, HALF)}"


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of ``a``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        met = row & where.get(c, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def signature_likeness(a: str, b: str) -> float:
    """1 less the edit distance (insertions and deletions) over the signatures' lengths."""
    if a == b:
        return 1.0
    short = min(len(a), len(b))
    if not short:
        return 0.0
    n = min(COMMON, max(1, short // 2))
    if {a[i : i + n] for i in range(len(a) - n + 1)}.isdisjoint(b[i : i + n] for i in range(len(b) - n + 1)):
        return 0.0
    return 2 * common_length(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """From 0 to 1; 1 for equal fingerprints, 0 at block sizes that do not meet."""
    if a == b:
        return 1.0
    size_a, one_a, two_a = a.split(":")
    size_b, one_b, two_b = b.split(":")
    size_a, size_b = int(size_a), int(size_b)
    if size_a == size_b:
        return max(signature_likeness(one_a, one_b), signature_likeness(two_a, two_b))
    if size_a == 2 * size_b:
        return signature_likeness(one_a, two_b)
    if size_b == 2 * size_a:
        return signature_likeness(two_a, one_b)
    return 0.0


def in_order(docs: DataFrame) -> DataFrame:
    """(run, guest, doc_id, text): runs of documents by descending doc_id, sorted within partitions, each with the next run's first one after it as a guest.

    The last run's guest is the very first document. Nulls come last; equal doc_ids stand by their texts' hashes.
    """
    base = docs.select("doc_id", text_or_empty().alias("text")).withColumn("number", F.col("doc_id").cast("double"))
    parts = 2 * shuffle_parts(docs.sparkSession)
    marks = base.select("number").approxQuantile("number", [k / parts for k in range(1, parts)], 0.2 / parts)
    splits = [float("-inf"), *(sorted(set(marks)) or [0.0]), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="number", outputCol="bucket", handleInvalid="keep")
    place = F.when(F.col("number").isNull(), F.lit(len(splits))).otherwise(F.lit(len(splits)) - 1 - F.col("bucket"))
    based = cut.transform(base).select(place.cast("int").alias("run"), "doc_id", "text")
    firsts = {r["run"]: r["doc_id"] for r in based.groupBy("run").agg(F.max("doc_id").alias("doc_id")).collect()}  # one row for each run
    runs = sorted(firsts)
    table = docs.sparkSession.createDataFrame([(r, firsts[r], runs[k - 1]) for k, r in enumerate(runs)], f"first_run int, first_id {base.schema['doc_id'].dataType.simpleString()}, before int")
    met = based.join(F.broadcast(table), (F.col("run") == F.col("first_run")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
    here = F.struct(F.col("run").alias("run"), F.lit(0).alias("guest"))
    there = F.struct(F.col("before").alias("run"), F.lit(1).alias("guest"))
    both = met.select(F.explode(F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("at"), "doc_id", "text").select("at.run", "at.guest", "doc_id", "text")
    dealt = both.repartition(shuffle_parts(docs.sparkSession), "run")
    return dealt.sortWithinPartitions("run", "guest", F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text")), "text")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of ``docs`` (doc_id, text).

    Edited: the last floor(n_chars / 2) code points replaced by the first as many, or all, of the next document by
    descending doc_id (after the last one: the first). near_*: likeness of the fingerprint to the edited text's and to the
    next document's. A null text is empty; equal doc_ids stand by their texts' hashes, null ones last; a lone row is its
    own next one. Repeated rows stand next to each other and give a row each. A long text takes some 30 bytes of memory for
    each of its own. Other columns are not read; an empty table gives an empty one.
    """
    ordered = in_order(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held = None  # (run, doc_id, text, fingerprint) of the row that waits for its next one
        for batch in batches:
            kinds[0] = batch.column("doc_id").type
            rows: list[tuple] = []
            for at, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("run", "guest", "doc_id", "text"))):
                if guest and (held is None or held[0] != at):
                    continue  # a second guest: only the first one is next
                mark = fingerprint(text.encode())
                if held is not None:
                    _, own, mine, print_ = held
                    k = len(mine) // 2
                    edited = (mine[: len(mine) - k] + text[:k]).encode()
                    other = fingerprint(edited)
                    rows.append((own, len(mine), hashlib.sha256(edited).hexdigest(), print_, other, likeness(print_, other), likeness(print_, mark)))
                held = None if guest else (at, doc_id, text, mark)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
