"""Shared helpers: written tables in the cluster's shared folder, and vectorised word hashing inside tasks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


# ------------------------------------------------------------------ tables in the shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset a local session gets a temporary folder; on a cluster, whose machines have disks of their own, that
    would lose tables, so it is an error there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: the lineage ends there.

    The table goes with ``forget``, or when the application ends. Readers decode up to some thousand rows of a row group at
    once, so tables of large rows say how many a group may hold.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.options(**{"parquet.block.row.count.limit": group_rows} if group_rows else {}).parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(schema).parquet(path)
    out.__dict__["_written_to"] = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete tables that ``written`` returned and that nothing unwritten depends on any more."""
    for table in tables:
        path = None if table is None else table.__dict__.pop("_written_to", None)
        if path:
            spark = table.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_hash(*columns: str, seed: int = 0) -> Column:
    """A 64-bit digest of a row that reruns and lost executors reproduce."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns])


# ------------------------------------------------------------------ Arrow batches


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` over each Arrow batch; it keeps no state between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is None:
                continue
            yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """Each row's text as UTF-8; null counts as empty."""
    for value in column.cast(pa.binary()).to_pylist():
        yield value or b""


# ------------------------------------------------------------------ vectorised words

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_NEXT = np.uint64(0xD6E8FEB86659FD93)


#: Bytes whose running hash stands in memory at once.
SEGMENT = 1 << 20


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BASE_INVERSE):
        p = np.full(SEGMENT + 1, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of ``h`` can choose a bucket."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans of ``buf``, both bounds in ascending order: equal bytes give equal hashes wherever they stand.

    The running sum of the bytes' terms is taken segment by segment, so that memory does not grow with the text.
    """
    powers, inverse = _powers()
    at_start, at_end, unit = np.zeros(len(starts), np.uint64), np.zeros(len(ends), np.uint64), np.ones(len(starts), np.uint64)
    total = np.uint64(0)
    with np.errstate(over="ignore"):
        for a in range(0, max(1, len(buf)), SEGMENT):
            part = buf[a : a + SEGMENT]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE_VALUE[part] * powers[: len(part)], out=sums[1:])
            ahead = _power(_BASE, a)
            i, j = np.searchsorted(starts, [a, a + SEGMENT])
            at_start[i:j] = total + ahead * sums[starts[i:j] - a]
            unit[i:j] = inverse[starts[i:j] - a] * _power(_BASE_INVERSE, a)
            i, j = np.searchsorted(ends, [a, a + SEGMENT])
            at_end[i:j] = total + ahead * sums[ends[i:j] - a]
            total = total + ahead * sums[-1]
        at_end[np.searchsorted(ends, len(buf)) :] = total
        return mix((at_end - at_start) * unit + (ends - starts).astype(np.uint64))


class Words:
    """The words of some consecutive rows: byte bounds, row number (from 0) and a 64-bit hash each.

    A long text comes in pieces, each of one row: ``lead`` words at the beginning of a piece are the last ones of the piece
    before, which windows over the seam need, and ``before`` words of the text came in earlier pieces, those ``lead``
    included; ``more`` says that another piece follows. ``fresh`` selects the words that no earlier piece had.
    """

    def __init__(self, buf: np.ndarray, bounds: np.ndarray, lower: bool, lead: int = 0, before: int = 0, more: bool = False):
        self.rows = len(bounds) - 1
        self.raw = buf
        self.buf = buf = _LOWER[buf] if lower else buf
        word = ~_SPACE[buf]
        opens, closes = word.copy(), word.copy()
        inner = np.zeros(len(buf) + 1, bool)
        inner[bounds] = True
        opens[1:] &= ~word[:-1] | inner[1:-1]
        closes[:-1] &= ~word[1:] | inner[1:-1]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.row = np.searchsorted(bounds, self.starts, side="right") - 1
        self.first = np.searchsorted(self.starts, bounds)  # of each row, in words; one more at the end
        self.hashes = self.span_hash(self.starts, self.ends)
        self.lead, self.before, self.more = lead, before, more
        self.fresh = slice(lead, None)

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return span_hashes(self.buf, starts, ends)

    def ngrams(self, n: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each n words in a row, those of an earlier piece left out."""
        at, h = ngram_hashes(self.hashes if hashes is None else hashes, self.row, n)
        known = int(np.searchsorted(at, self.lead - n + 1))
        return at[known:], h[known:]


def ngram_hashes(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    h = hashes[at] + np.uint64(n)
    for k in range(1, n):
        h = mix(h * _NEXT) + hashes[at + k]
    return at, mix(h)


#: Words that two pieces of a text share: windows hold one word more at most.
LEAD = 8


def byte_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column's texts; null counts as empty."""
    column = column.cast(pa.binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), offsets


def pieces_of(text: np.ndarray, lower: bool, piece: int) -> Iterator[Words]:
    """A text's words in pieces of about ``piece`` bytes, cut at white space; a word is held whole, however long."""
    begin, lead, before, at = 0, 0, 0, 0
    while True:
        at = at + piece
        while at < len(text):
            blank = np.flatnonzero(_SPACE[text[at : at + piece]])
            if len(blank):
                at += int(blank[0])
                break
            at += piece
        at = min(at, len(text))
        words = Words(text[begin:at], np.array([0, at - begin]), lower, lead, before, at < len(text))
        yield words
        if at == len(text):
            return
        n = len(words.starts)
        lead_next = min(LEAD, n)
        before += n - lead
        lead = lead_next
        begin = begin + int(words.starts[n - lead]) if lead else at


def words_of(column: pa.Array, lower: bool = True, piece: int = SEGMENT) -> Iterator[tuple[int, Words]]:
    """(first row, its and the next rows' words), some ``piece`` bytes of text at a time.

    A text of over twice as many comes in several pieces with the same row number, so that memory stays bounded.
    """
    data, offsets = byte_rows(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + piece, side="right")) - 1)
        part = data[offsets[lo] : offsets[hi]]
        if len(part) > 2 * piece:
            for words in pieces_of(part, lower, piece):
                yield lo, words
        else:
            yield lo, Words(part, offsets[lo : hi + 1] - offsets[lo], lower)
        lo = hi
