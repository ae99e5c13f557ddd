"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question asked again with other values keeps its template.
Windows of the templates are hash-joined with those of the benchmark; a match counts only where its slots agree: along one
alignment each value of the item stands for one value of the document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Words, map_arrow, mix, row_hash, text_or_empty, words_of, written

#: Words of a window, and how many of them at least are not placeholders.
WINDOW = 5
LEAST_LITERALS = 3
#: Share of an item's windows that a document must hold.
COVERAGE = 0.8
#: Bits of the filter that windows pass before the join; its size does not depend on the benchmark.
FILTER_BITS = 22

# Words that count as a unit after a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz ton tons ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years % percent degree degrees celsius fahrenheit "
    "dollar dollars euro euros cent cents pound pounds meter meters metre metres gram grams kilogram kilograms kilometer kilometers kmh mph "
    "v w kw kwh hz khz mhz ghz kb mb gb tb"
).split()

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b".,;:!?\"'()[]{}")] = True
_SIGN = np.zeros(256, bool)
_SIGN[list(b"$#+-~")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
NUMBER, NAME, UNIT = 1, 2, 3
_VERBATIM = np.uint64(0x9AE16A3B2F90404F)


def _unit_hashes() -> np.ndarray:
    text = " ".join(UNITS).encode()
    return np.sort(Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), True).hashes)


_UNITS = _unit_hashes()


def canonical(words: Words, quoted: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, hash, value) of each word: kind 0 for a literal; hash: of the word without outer punctuation, or of its kind; value: of the word itself.

    quoted: read a text's first word as it would be read inside a sentence, where a capital letter makes it a name.
    """
    starts, ends = words.starts.copy(), words.ends.copy()
    for _ in range(3):
        ends = ends - ((ends - starts > 1) & _PUNCTUATION[words.buf[ends - 1]])
        starts = starts + ((ends - starts > 1) & _PUNCTUATION[words.buf[starts]])
    value = words.span_hash(starts, ends)
    if not len(starts):
        return np.empty(0, np.int8), value, value
    b0 = words.raw[starts]
    b1 = words.raw[np.minimum(starts + 1, ends - 1)]
    number = _DIGIT[b0] | (_SIGN[b0] & _DIGIT[b1])
    # A name: capital letter (Latin with its accents, Greek, Cyrillic), the next letter small, not at the start of a sentence or line.
    capital = ((b0 >= 65) & (b0 <= 90)) | ((b0 == 0xC3) & (b1 >= 0x80) & (b1 <= 0x9E)) | ((b0 == 0xCE) & (b1 >= 0x91) & (b1 <= 0xA9)) | ((b0 == 0xD0) & (b1 >= 0x80) & (b1 <= 0xAF))
    second = words.raw[np.minimum(starts + 1 + (b0 >= 0x80), ends - 1)]
    capital &= (ends - starts > 1) & ~((second >= 65) & (second <= 90))
    inside = np.full(len(starts), quoted)
    inside[1:] = quoted & (words.row[1:] != words.row[:-1]) | (words.row[1:] == words.row[:-1]) & ~_STOP[words.raw[words.ends[:-1] - 1]]
    breaks = np.searchsorted(np.flatnonzero(words.raw == 10), words.starts)
    inside[1:] &= (breaks[1:] == breaks[:-1]) | (words.row[1:] != words.row[:-1])
    name = capital & inside & ~number
    after = np.zeros(len(starts), bool)
    after[1:] = number[:-1] & (words.row[1:] == words.row[:-1])
    at = np.minimum(np.searchsorted(_UNITS, value), len(_UNITS) - 1)
    unit = after & (_UNITS[at] == value) & ~number
    kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, 0))).astype(np.int8)
    return kind, np.where(kind > 0, mix(kind.astype(np.uint64)), value), value


def window_hashes(words: Words, window: int, least: int, quoted: bool = False, verbatim: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the first word, hash) of the windows with enough literals; and kind and value of all words. verbatim: placeholders stand for themselves, so that any window is one."""
    kind, h, value = canonical(words, quoted)
    if verbatim:
        kind, h = np.zeros_like(kind), value ^ _VERBATIM
    at, hashes = words.ngrams(window, h)
    literal = np.concatenate([[0], np.cumsum(kind == 0)])
    good = literal[at + window] - literal[at] >= least
    return at[good], hashes[good], kind, value


def windows(texts: DataFrame, window: int = WINDOW, least: int = LEAST_LITERALS, passes: np.ndarray | None = None, bits: int = FILTER_BITS, quoted: bool = False, verbatim: bool = False) -> DataFrame:
    """(id, row, hash, pos, slots): template windows of every whole text (id, row, text), those only that the filter ``passes``.

    pos: number of the window's first word; slots: values of its placeholders, in order, null if it has none.
    """
    packed = None if passes is None else np.packbits(passes)

    def run(batch: pa.RecordBatch) -> pa.Table:
        owner, hashes, pos, slots = [], [], [], []
        known = None if packed is None else np.unpackbits(packed)
        for lo, words in words_of(batch.column("text")):
            at, h, kind, value = window_hashes(words, window, least, quoted, verbatim)
            if known is not None:
                hit = np.flatnonzero(known[(h >> np.uint64(64 - bits)).astype(np.int64)])
                at, h = at[hit], h[hit]
            owner.append(words.row[at] + lo)
            hashes.append(h)
            pos.append(at - words.first[words.row[at]] + (words.before - words.lead))
            filled = np.concatenate([[0], np.cumsum(kind > 0)])
            some = filled[at + window] > filled[at]
            signed = value.view(np.int64)
            slots += [signed[a : a + window][kind[a : a + window] > 0].tolist() if s else None for a, s in zip(at.tolist(), some.tolist())]
        owner = pa.array(np.concatenate(owner) if owner else np.empty(0, np.int64), pa.int64())
        hashes = np.concatenate(hashes).view(np.int64) if hashes else np.empty(0, np.int64)
        pos = np.concatenate(pos).astype(np.int32) if pos else np.empty(0, np.int32)
        return pa.Table.from_arrays(
            [batch.column("id").take(owner), batch.column("row").take(owner), pa.array(hashes), pa.array(pos), pa.array(slots, pa.list_(pa.int64()))], ["id", "row", "hash", "pos", "slots"]
        )

    kind = texts.schema["id"].dataType.simpleString()
    return map_arrow(texts.select("id", "row", "text"), run, f"id {kind}, row long, hash long, pos int, slots array<long>")


def window_filter(items: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """One bit for each of ``2**bits`` ranges of hashes: whether an item has a window there."""
    ranges = items.select(F.shiftrightunsigned("hash", 64 - bits).alias("range")).distinct().toPandas()["range"]
    out = np.zeros(1 << bits, bool)
    out[ranges.to_numpy(np.int64)] = True
    return out


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), text_or_empty().alias("text")).withColumn("row", row_hash("text"))


ITEM = ["of_item", "of_item_row"]
TEXT = ["id", "row"]


def item_windows(items: DataFrame, window: int, least: int) -> DataFrame:
    """(of_item, of_item_row, item_hash, item_pos, item_slots, verbatim): the windows of the items (id, row, text).

    A first word with a capital letter has its window in both readings. Items none of whose windows has enough literals get
    all their windows as they stand; they count only where all of those are met.
    """
    named = [F.col("id").alias("of_item"), F.col("row").alias("of_item_row"), F.col("hash").alias("item_hash"), F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots")]
    both = windows(items, window, least).union(windows(items, window, least, quoted=True).where("pos = 0")).distinct().select(*named, F.lit(False).alias("verbatim"))
    known = both.select(F.col("of_item").alias("id"), F.col("of_item_row").alias("row")).distinct()
    bare = items.alias("i").join(known.alias("k"), F.col("i.id").eqNullSafe(F.col("k.id")) & (F.col("i.row") == F.col("k.row")), "left_anti")
    return both.union(windows(bare, window, 0, verbatim=True).select(*named, F.lit(True).alias("verbatim")))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST_LITERALS, coverage: float = COVERAGE) -> DataFrame:
    """(id, row, item_id, share) of each text of ``docs`` (id, row, text) and item whose template it holds with consistent slots.

    A text must hold ``coverage`` of an item's windows, so it holds one of any ``floor((1 - coverage) * n) + 1`` of them: those
    of each item that the fewest items have meet the texts, and a beginning that many items share pairs none off. Only the
    pairs so met are held against all windows. Where along one alignment a value of the item stands for two values of the
    text, only the windows with the item's own values count.
    """
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").alias("id"), F.col("text").cast("string").alias("text"))
    items = items.distinct().withColumn("row", row_hash("text"))
    asked = written(item_windows(items, window, least), "items")
    passes = window_filter(asked.select(F.col("item_hash").alias("hash")))
    found = windows(docs, window, least, passes)
    if not asked.where("verbatim").isEmpty():
        found = found.union(windows(docs, window, 0, passes, verbatim=True))
    found = written(found, "found")
    size = asked.groupBy(*ITEM).agg(F.count_distinct("item_pos").alias("n_windows"), F.max("verbatim").alias("all_of_it"))
    spread = asked.groupBy("item_hash").agg(F.count("*").alias("n_items")).withColumnRenamed("item_hash", "of_hash")
    least_spread = asked.join(spread, asked["item_hash"] == spread["of_hash"]).groupBy(*ITEM, "item_pos").agg(F.max("n_items").alias("n_items"), F.collect_set("item_hash").alias("hashes"))
    place = F.row_number().over(W.partitionBy(*ITEM).orderBy("n_items", "item_pos"))  # of one item's windows
    rarest = least_spread.withColumn("place", place)
    sized = size.select(F.col("of_item").alias("s_item"), F.col("of_item_row").alias("s_row"), "n_windows")
    rarest = rarest.join(sized, F.col("of_item").eqNullSafe(F.col("s_item")) & (F.col("of_item_row") == F.col("s_row")))
    rarest = rarest.where(F.col("place") <= F.floor((1 - coverage) * F.col("n_windows") + 1e-9) + 1).select(*ITEM, F.explode("hashes").alias("of_hash"))
    pairs = found.select("id", "row", "hash").join(rarest, F.col("hash") == F.col("of_hash")).select(*TEXT, *ITEM).distinct()
    every = pairs.alias("p").join(asked.alias("a"), F.col("p.of_item").eqNullSafe(F.col("a.of_item")) & (F.col("p.of_item_row") == F.col("a.of_item_row")))
    every = every.select(F.col("id").alias("of_id"), F.col("row").alias("of_row"), F.col("p.of_item").alias("of_item"), F.col("p.of_item_row").alias("of_item_row"), "item_hash", "item_pos", "item_slots")
    pair = F.transform(F.arrays_zip("item_slots", "slots"), lambda z: F.struct(z["item_slots"].alias("item"), z["slots"].alias("doc")))
    met = found.join(every, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("row") == F.col("of_row")) & (F.col("hash") == F.col("item_hash")))
    met = met.select(*TEXT, *ITEM, "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"), F.coalesce(pair, F.array().cast("array<struct<item:bigint,doc:bigint>>")).alias("pairs"))
    met = written(met, "met")
    line = [*TEXT, *ITEM, "shift"]
    values = met.select(*line, F.explode("pairs").alias("pair")).groupBy(*line, F.col("pair.item").alias("item")).agg((F.min("pair.doc") < F.max("pair.doc")).alias("two"))
    values = values.groupBy(*line).agg(F.max("two").alias("two"))
    both = met.alias("m").join(values.alias("v"), [F.col(f"m.{c}").eqNullSafe(F.col(f"v.{c}")) for c in line], "left").select("m.*", "two")
    good = both.where(~F.coalesce("two", F.lit(False)) | F.forall("pairs", lambda p: p["item"] == p["doc"]))
    covered = good.groupBy(*TEXT, *ITEM).agg(F.count_distinct("item_pos").alias("n"))
    sized = size.select(F.col("of_item").alias("item_id"), F.col("of_item_row").alias("item_row"), "n_windows", "all_of_it")
    share = covered.join(sized, F.col("of_item").eqNullSafe(F.col("item_id")) & (F.col("of_item_row") == F.col("item_row")))
    enough = F.when(F.col("all_of_it"), F.col("n") == F.col("n_windows")).otherwise(F.col("n") >= coverage * F.col("n_windows"))
    return share.where(enough).select("id", "row", "item_id", (F.col("n") / F.col("n_windows")).alias("share"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, contaminated, items) for every row of ``docs``: items are the ids whose template the text holds, sorted.

    Null and empty texts hold nothing; texts of any length are read whole, in pieces. Items that are null, or too short for
    one window, match nothing: so few words are no evidence. A null item_id counts as an item but is not listed; repeated
    items are one, ids of any type do. Repeated rows get a row each. An empty table gives an empty one, an empty benchmark
    no matches. There are no ties to settle: all of a text's items are listed. Other columns are not read.
    """
    base = keyed(docs)
    kind = benchmark.schema["item_id"].dataType.simpleString()
    found = matches(base, benchmark, **options).groupBy("id", "row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found = found.select(F.col("id").alias("of_id"), F.col("row").alias("of_row"), "items")
    both = base.select("id", "row").join(found, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("row") == F.col("of_row")), "left")
    return both.select(F.col("id").alias("doc_id"), F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast(f"array<{kind}>")).alias("items"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, whatever their columns, whose text holds no item."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    base = docs.select(whole.alias("whole"), F.col("doc_id").alias("id"), F.xxhash64(F.lit(0), text_or_empty()).alias("row"))
    found = matches(keyed(docs), benchmark, **options).select(F.col("id").alias("of_id"), F.col("row").alias("of_row")).distinct()
    return base.join(found, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("row") == F.col("of_row")), "left_anti").select("whole.*")
