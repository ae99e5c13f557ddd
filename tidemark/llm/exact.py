"""Exact dedup in two passes over a Bloom filter.

The first pass hashes every text and counts, up to two, how many rows set each cell of a filter. In the second pass a row
whose cells were not all set twice has no equal: it passes straight through. Only the other rows, the possible repeats,
shuffle; their full digests tell them apart exactly. A false positive costs a shuffled row and changes no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, shuffle_parts, text_or_empty, written

#: The characters that do not count: ASCII white space.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
#: Cells that a row sets, all in one segment of the filter.
HASHES = 3
SEGMENT_BITS = 16
SEGMENT = 1 << SEGMENT_BITS
#: Cells of the filter for each row, and the most it ever has. The second pass sends one bit a cell to each task, so 32 MB at
#: most, whatever the size of the table. Beyond some 30 million rows the cells get fuller and more rows without an equal
#: shuffle, in the end all of them, as (digest, length, id) without their texts: a plain aggregation.
CELLS_PER_ROW = 16
MAX_CELLS = 1 << 28
#: Rows whose cells a task of the first pass holds before it sends them on.
ROWS_HELD = 1 << 20
#: Groups with over this share of the possible repeats, of which there are at most 1,000, get their result by broadcast.
HOT_SHARE = 1000

_DIGEST = T.StructType([T.StructField("sha", T.BinaryType()), T.StructField("chars", T.LongType()), T.StructField("h", T.LongType()), T.StructField("g", T.LongType())])


def normalised(text: bytes) -> bytes:
    return text.translate(None, BLANKS)


def digested(rows: DataFrame) -> DataFrame:
    """``rows`` (row, text) as (row, sha, chars, h, g): the normalised text's SHA-256, its first two words as numbers, and the original's code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            shas = [hashlib.sha256(normalised(x)).digest() for x in text.cast(pa.binary()).to_pylist()]
            words = np.frombuffer(b"".join(shas), np.int64).reshape(-1, 4)
            chars = pc.utf8_length(text).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(shas, pa.binary()), chars, pa.array(words[:, 0]), pa.array(words[:, 1])], ["row", "sha", "chars", "h", "g"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *_DIGEST.fields]))


def cells_of(h: np.ndarray, g: np.ndarray, segments: int) -> np.ndarray:
    """(rows, HASHES) cells of rows by their hashes: h chooses the segment, g the cells in it, which differ from each other."""
    segment = (h.view(np.uint64) % np.uint64(segments)).astype(np.int64)
    first, step = g & (SEGMENT - 1), (g >> 32) & (SEGMENT - 1) | 1
    return (segment << SEGMENT_BITS)[:, None] | (first[:, None] + step[:, None] * np.arange(HASHES)) & (SEGMENT - 1)


def filter_cells(rows: int, most: int = MAX_CELLS) -> int:
    """The size of a filter for so many rows: a power of two."""
    return int(min(most, max(SEGMENT, 1 << (max(1, rows) * CELLS_PER_ROW - 1).bit_length())))


def repeated_cells(digests: DataFrame, cells: int) -> np.ndarray:
    """The first pass: a bit for each cell that at least two rows set, as packed bytes (``cells`` / 8 of them).

    A task sends each segment's cells once, with those that it has met twice; one task merges a segment's pieces as they come.
    """
    spark, segments = digests.sparkSession, cells >> SEGMENT_BITS

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> pa.RecordBatch:
            cell, times = np.unique(np.concatenate(held), return_counts=True)
            segment = cell >> SEGMENT_BITS
            at = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            low = (cell & (SEGMENT - 1)).astype(np.uint16)
            parts = [(low[a:b], low[a:b][times[a:b] > 1]) for a, b in zip(at, [*at[1:], len(cell)])]
            return pa.RecordBatch.from_arrays([pa.array(segment[at], pa.int32()), *(pa.array([p[k].tobytes() for p in parts], pa.binary()) for k in (0, 1))], ["segment", "once", "again"])

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(cells_of(*(batch.column(c).to_numpy() for c in ("h", "g")), segments).ravel())
                n += batch.num_rows
            if n >= ROWS_HELD:
                yield sent()
                held, n = [], 0
        if n:
            yield sent()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, one, two = None, np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(two).tobytes()], pa.binary())], ["segment", "bits"])
        for batch in batches:
            for segment, once, again in zip(*(batch.column(c).to_pylist() for c in ("segment", "once", "again"))):
                if segment != now:
                    if two.any():
                        yield row()
                    now, one[:], two[:] = segment, False, False
                cell = np.frombuffer(once, np.uint16)
                two[cell[one[cell]]] = True
                two[np.frombuffer(again, np.uint16)] = True
                one[cell] = True
        if two.any():
            yield row()

    pieces = digests.select("h", "g").mapInArrow(sets, "segment int, once binary, again binary")
    sorted_pieces = pieces.repartition(min(segments, shuffle_parts(spark)), "segment").sortWithinPartitions("segment")
    bits = np.zeros(cells // 8, np.uint8)
    for segment, part in sorted_pieces.mapInArrow(merged, "segment int, bits binary").collect():  # 32 MB at most
        bits[segment * SEGMENT // 8 : (segment + 1) * SEGMENT // 8] = np.frombuffer(part, np.uint8)
    return bits


def flagged(digests: DataFrame, bits: np.ndarray) -> DataFrame:
    """The second pass: ``digests`` with ``suspect``, whether all of a row's cells are set twice. Rows with an equal always are."""
    sent, segments = digests.sparkSession.sparkContext.broadcast(bits), len(bits) * 8 >> SEGMENT_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = cells_of(*(batch.column(c).to_numpy() for c in ("h", "g")), segments)
            suspect = (sent.value[cell >> 3] >> (7 - (cell & 7)) & 1).astype(bool).all(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(suspect)], [*batch.schema.names, "suspect"])

    return digests.mapInArrow(run, T.StructType([*digests.schema.fields, T.StructField("suspect", T.BooleanType())]))


def _order(id_field: str) -> list:
    """Of equal texts the row with the most code points stays, then the smallest id (null last), then one and the same of equal rows."""
    return [(-F.col("chars")).alias("less"), F.col(id_field).isNull().alias("no_id"), F.col(id_field).alias("id")]


def marked(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_cells: int = MAX_CELLS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``, dropped ones too.

    Texts are equal when they are after ASCII white space is deleted; null is the empty text, which white space alone equals
    too. The row with the most code points in the original stays, then the one with the smallest id; a null id comes after
    all others, and of rows equal in both exactly one stays. Ids may be of any type and repeat; columns of other names are
    not read; an empty table gives no rows. A text is held whole while it is hashed, and read once: digests are written to
    the shared folder, from which both passes read. Groups of any size are counted before they shuffle.
    """
    digests = digested(docs.select(F.struct(F.col(doc_id).alias("id")).alias("row"), text_or_empty(text).alias("text")))
    digests = written(digests.select("row.id", "sha", "chars", "h", "g", F.monotonically_increasing_id().alias("at")), "digests")
    both = flagged(digests, repeated_cells(digests, filter_cells(digests.count(), max_cells)))
    out = [F.col("id").alias("doc_id"), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("keep.at") == F.col("at")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")]
    straight = both.where(~F.col("suspect")).select(F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), out[-1])
    suspects = written(both.where("suspect").select("id", "sha", "chars", "at"), "suspects")
    groups = written(suspects.groupBy("sha").agg(F.count("*").alias("n"), F.min(F.struct(*_order("id"), "at")).alias("keep")), "groups")
    least = max(1000, suspects.count() // HOT_SHARE)
    hot = F.broadcast(groups.where(F.col("n") > least))  # HOT_SHARE rows at most
    in_hot = suspects.join(hot, "sha").select(*out)
    rest = suspects.join(hot.select("sha"), "sha", "left_anti").join(groups.where(F.col("n") <= least), "sha").select(*out)
    return straight.unionByName(in_hot).unionByName(rest)


def unique(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_cells: int = MAX_CELLS) -> DataFrame:
    """The rows of ``docs`` that ``marked`` keeps, with all their columns, whatever their names.

    Rows without a possible equal never leave their task; the others shuffle with their texts, one of a group from each
    task. Of rows equal in text length and id the one with the smallest digest of all its columns stays.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_or_empty(text).alias("text"))
    digests = digested(rows)
    hashes = written(digests.select("h", "g"), "hashes")
    both = flagged(digests, repeated_cells(hashes, filter_cells(hashes.count(), max_cells)))
    forget(hashes)
    stay = both.where("suspect").groupBy("sha").agg(F.min_by("row", F.struct(*_order(f"row.`{doc_id}`"), F.xxhash64(F.to_json("row")).alias("at"))).alias("row"))
    return both.where(~F.col("suspect")).select("row").unionByName(stay.select("row")).select("row.*")
