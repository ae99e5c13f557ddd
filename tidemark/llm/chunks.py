"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of each text and proposes a cut where it is small; a proposal with another one closely
before it is passed over. Cuts so depend on the bytes just before them alone, and an insertion moves none but its own.
Chunks are deduplicated by digest: those of the document with the smallest id stay, later ones go where they stand in a run
of ``least_words`` repeated words, which leaves chance repeats of phrases and single lines alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, row_hash, span_hashes, text_or_empty

#: Bytes that the gear hash sees.
WINDOW = 16
#: Mean bytes between proposed cuts, and the fewest between a cut and the proposal before it: chunks have 25 bytes on average.
MEAN_BYTES = 14
LEAST_CHUNK = 8
MAX_CHUNK = 1024  # a place has 11 bits for it
#: Words of a passage. Cuts outside a passage take its ends off the run of chunks that it leaves, ``END_BYTES`` on either side
#: as a rule, so a run is measured with as many bytes about it.
LEAST_WORDS = 47
END_BYTES = 22
#: A unit is a word, or so many bytes of a longer one: in scripts that part no words, units stand in for words.
UNIT_BYTES = 12

_GEAR = np.random.default_rng(1009).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: np.ndarray) -> np.ndarray:
    """Chunk ends in ``data`` (uint8), the last one its length; chunks over ``MAX_CHUNK`` bytes are cut evenly from their start."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    h = _GEAR[data]
    step = 1
    while step < WINDOW and step < n:  # h[i] = sum of gear[data[i - j]] << j over the last 2 * step bytes
        shifted = h.copy()
        shifted[step:] += h[:-step] << np.uint32(step)
        h, step = shifted, 2 * step
    h[: WINDOW - 1] = 0xFFFFFFFF
    ends = np.flatnonzero(h < np.uint32((1 << 32) // MEAN_BYTES)) + 1
    ends = ends[np.diff(ends, prepend=-LEAST_CHUNK) >= LEAST_CHUNK]
    if not len(ends) or ends[-1] != n:
        ends = np.append(ends, n)
    size = np.diff(ends, prepend=0)
    if size.max() > MAX_CHUNK:
        ends = np.concatenate([np.append(np.arange(e - s + MAX_CHUNK, e, MAX_CHUNK), e) for e, s in zip(ends, size)])
    return ends


def digests(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each chunk's bytes."""
    return span_hashes(data, np.concatenate([[0], ends[:-1]]), ends) if len(ends) else np.empty(0, np.uint64)


#: A chunk's place in a long: byte offset, size, whether its digest stood before in the text.
_AT, _SIZE, _AGAIN = 12, 1, 0


def chunk_rows(docs: DataFrame) -> DataFrame:
    """(id, key, digest, place): every chunk of every text (id, key, text)."""

    def run(batch: pa.RecordBatch) -> pa.Table | None:
        owner, digest, place = [], [], []
        for i, value in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            if not value:
                continue
            data = np.frombuffer(value, np.uint8)
            ends = cuts(data)
            at = np.concatenate([[0], ends[:-1]])
            digest.append(digests(data, ends).view(np.int64))
            again = np.ones(len(ends), np.int64)
            again[np.unique(digest[-1], return_index=True)[1]] = 0
            owner.append(np.full(len(ends), i))
            place.append(at << _AT | (ends - at) << _SIZE | again << _AGAIN)
        if not owner:
            return None
        owner = pa.array(np.concatenate(owner))
        return pa.Table.from_arrays(
            [batch.column("id").take(owner), batch.column("key").take(owner), pa.array(np.concatenate(digest)), pa.array(np.concatenate(place))], ["id", "key", "digest", "place"]
        )

    return map_arrow(docs.select("id", "key", "text"), run, "id long, key long, digest long, place long")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(of_id, of_key, chunks): of each text the places of its chunks whose digest occurs more than once, twice the place and 1 if no earlier document has it.

    Documents with an id come first, by it; those without are told apart, and ordered, by their text's hash.
    """
    chunks = chunk_rows(docs)
    least = [F.count("*").alias("n"), F.min("id").alias("first_id"), F.min(F.when(F.col("id").isNull(), F.col("key"))).alias("first_key")]
    repeated = chunks.groupBy("digest").agg(*least).where("n > 1").select(F.col("digest").alias("known"), "first_id", "first_key")
    met = chunks.join(repeated, F.col("digest") == F.col("known"))
    first = F.when(F.col("first_id").isNull(), F.col("key") == F.col("first_key")).otherwise(F.coalesce(F.col("id") == F.col("first_id"), F.lit(False)))
    place = F.shiftleft("place", 1).bitwiseOR(first.cast("long"))
    texts = met.select("id", "key", place.alias("place")).groupBy("id", "key").agg(F.collect_set("place").alias("chunks"))
    return texts.withColumnRenamed("id", "of_id").withColumnRenamed("key", "of_key")


_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\v\f\r")] = True


def units_in(text: bytes, start: int, end: int) -> int:
    """Words of a byte span, those over ``UNIT_BYTES`` bytes counted by their length."""
    blank = np.concatenate([[-1], np.flatnonzero(_SPACE[np.frombuffer(text, np.uint8)[start:end]]), [end - start]])
    sizes = np.diff(blank) - 1
    return int((-(-sizes // UNIT_BYTES))[sizes > UNIT_BYTES * 2].sum() + ((sizes > 0) & (sizes <= UNIT_BYTES * 2)).sum())


def touching(text: bytes, at: np.ndarray, size: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of runs of touching spans, sorted by start, that have ``least`` words with ``END_BYTES`` on either side."""
    if not len(at):
        return []
    breaks = np.flatnonzero(at[1:] != at[:-1] + size[:-1]) + 1
    starts = at[np.concatenate([[0], breaks])]
    last = np.concatenate([breaks - 1, [len(at) - 1]])
    runs = ((int(a), int(b)) for a, b in zip(starts, at[last] + size[last]))
    # A word takes a letter and a space, or more.
    return [(a, b) for a, b in runs if b - a >= 2 * (least - END_BYTES) and units_in(text, max(0, a - END_BYTES), min(len(text), b + END_BYTES)) >= least]


_BLANK = frozenset(b" \t\n\v\f\r")


def whole_words(text: bytes, start: int, end: int) -> tuple[int, int]:
    """The part of a span that ends at white space or the text's own ends, so that no word (or character) is cut."""
    while 0 < start < end and text[start - 1] not in _BLANK:
        start += 1
    while start < end < len(text) and text[end] not in _BLANK:
        end -= 1
    return start, end


def spans_to_cut(text: bytes, chunks: np.ndarray, least: int) -> tuple[bool, list[tuple[int, int]]]:
    """Whether the text holds a repeated passage, and the byte spans of those that stand earlier: in an earlier document or before in this text."""
    chunks = np.sort(chunks)
    first, place = chunks & 1, chunks >> 1
    at, size, again = place >> _AT, place >> _SIZE & 0x7FF, place >> _AGAIN & 1
    passages = touching(text, at, size, least)
    gone = (again == 1) | (first == 0)
    spans = [whole_words(text, a, b) for a, b in touching(text, at[gone], size[gone], least)]
    return bool(passages), [s for s in spans if s[0] < s[1]]


def dedup(docs: DataFrame, least_words: int = LEAST_WORDS, named: str = "dedup") -> DataFrame:
    """The rows of ``docs`` with ``text`` rid of repeated passages, plus a struct ``named``, which no column of ``docs`` may be called.

    The struct: repeated (the text holds a passage that also stands elsewhere, or twice), spans (start and end of each part
    taken out, in bytes of the UTF-8 text) and removed_chars. A null text counts as empty and stays null; nothing of an
    empty one can go. Rows of one doc_id count as one document, so neither of two loses what both have. Rows with a null
    doc_id come after all others, and only equal texts among them count as one document. Columns of any other name pass
    through. doc_id: any integer type, or a string of a number. A text's chunks, eight bytes for some 25, are held together
    in one task; an empty table gives an empty one. A chunk that two documents have is the first one's, so there are no ties.
    """
    if named in docs.columns:
        raise ValueError(f"docs has a column {named!r}: give the struct another name")
    rest = [c for c in docs.columns if c != "text"]
    base = docs.select(
        F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text"), F.col("text").isNull().alias("void"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")
    ).withColumn("key", row_hash("text"))
    found = repeated_chunks(base)
    both = base.join(found, base["id"].eqNullSafe(found["of_id"]) & (base["key"] == found["of_key"]), "left").select("text", "void", "rest", "chunks")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, flags, spans, removed = [], [], [], []
        lists = batch.column("chunks")
        flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        valid = lists.is_valid().to_numpy(zero_copy_only=False)
        for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            gone: list[tuple[int, int]] = []
            flag = False
            if valid[i]:
                flag, gone = spans_to_cut(text, flat[offsets[i] : offsets[i + 1]], least_words)
            kept, last, n = [], 0, 0
            for a, b in gone:
                kept.append(text[last:a])
                n += len(text[a:b].decode())
                last = b
            texts.append(b"".join([*kept, text[last:]]))
            flags.append(flag)
            spans.append([{"start": a, "end": b} for a, b in gone])
            removed.append(n)
        texts = pa.array(texts, pa.binary()).cast(pa.string())
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays(
            [texts, batch.column("void"), batch.column("rest"), pa.array(flags, pa.bool_()), pa.array(spans, span), pa.array(removed, pa.int64())], ["text", "void", "rest", "repeated", "spans", "removed_chars"]
        )

    kind = base.schema["rest"].dataType.simpleString()
    out = map_arrow(both.select("text", "void", "rest", "chunks"), run, f"text string, void boolean, rest {kind}, repeated boolean, spans array<struct<start:int,end:int>>, removed_chars long")
    kept = {"text": F.when(~F.col("void"), F.col("text")).alias("text")}
    return out.select(*[kept.get(c, F.col(f"rest.`{c}`").alias(c)) for c in docs.columns], F.struct("repeated", "spans", "removed_chars").alias(named))
