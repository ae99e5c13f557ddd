"""Near-duplicates at a Jaccard similarity of word shingles, for the pipeline: SimHash and pivot tables, then an exact check.

Pairs come from the operator of ``simhash``, by its cells, pivot tables and bit runs, over fingerprints of each text's distinct
words: an edit changes five shingles but one word, so that most pairs at 0.8 differ by five bits or fewer. What the search
pairs is held against the exact similarity of the two whole sets of shingles, and what is similar is joined.

No radius holds every pair at 0.8, so an exact join over the groups of the search adds those that lie further apart. Texts
whose least hashes agree in one of ``BANDS`` bands of ``ROWS`` with some other text's, or that the search paired, are suspects.
Suspects are joined by prefix filtering, which loses no similar pair: shingles stand in one order, the rarest first, and two
sets at 0.8 share one of the first fifth of either. What texts have of their own is rare and comes first, so texts that merely
share passages do not meet. Pairs that met are held against bounds on their sizes and on the places where they met, then
against the exact similarity.

A shingle's bucket is not paired off at once: each round holds some of its rows (centres) against those that are not yet
joined with them, and takes the centres out. A bucket is done when all its rows are joined or all its pairs are settled, so a
large group of copies costs a few rows for each member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Words, forget, map_arrow, mix, shuffle_parts, words_of, written
from .components import connected_components
from .simhash import first_rows, links_within, majorities

#: Words of a shingle, and the similarity of near-duplicates as a fraction.
SHINGLE = 5
SIMILAR = (4, 5)
#: Differing bits of two texts' fingerprints within which the pivot search pairs them.
RADIUS = 5
#: Times that pairs of the search span its groups: where one pair is not similar, another one may be.
FORESTS = 4
#: Bands and the least hashes of each: a pair at 0.8 meets in none of them once in 2,800 times.
BANDS, ROWS = 20, 5
#: Shingles that are sent on from a task at once.
SENT = 1 << 20
#: Pairs, of sixteen bytes each, that are sent to all tasks at most.
FEW_PAIRS = 1 << 19
#: Cells of the sketch by which shingles are ordered: 4 MB are sent to all tasks.
CELL_BITS = 22
CELLS, SEGMENT = 1 << CELL_BITS, 1 << 16
#: Centres of a bucket in the first round; a round has eight times as many as the one before, 16 times if that found no link, 64 times if no pair met.
CENTRES = 4
#: Links, of sixteen bytes each, that one pass joins.
FEW_LINKS = 1 << 18
#: Rows of a task that writes one of the small tables, where so many make fewer tasks than a shuffle has.
PART_ROWS = 1 << 12

_RNG = np.random.default_rng(509)
_FACTORS = _RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(words: Words, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): each row's distinct shingle hashes, sorted; a shorter text is one shingle, and so is one without words."""
    count = np.diff(words.first)
    rows, hashes = [np.flatnonzero(count == 0)], [np.zeros(int((count == 0).sum()), np.uint64)]
    for n in range(1, shingle + 1):
        at, h = words.ngrams(n)
        row = words.row[at]
        keep = slice(None) if n == shingle else count[row] == n
        rows.append(row[keep])
        hashes.append(h[keep])
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return np.searchsorted(row[new], np.arange(words.rows + 1)), h[new]


def row_sets(column: pa.Array, *lengths: int) -> Iterator[tuple[tuple[np.ndarray, np.ndarray], ...]]:
    """``shingle_sets`` of some rows after another, for shingles of each of ``lengths``; of a long text, which comes in pieces, the sets are united."""
    held: list[tuple[np.ndarray, ...]] = []
    for _, words in words_of(column):
        if words.lead or words.more:
            held.append(tuple(np.unique(words.ngrams(n)[1]) for n in lengths))
            if not words.more:
                united = [np.unique(np.concatenate(h)) for h in zip(*held)]
                held = []
                yield tuple((np.array([0, len(h)]), h) if len(h) else shingle_sets(words, n) for n, h in zip(lengths, united))
        else:
            yield tuple(shingle_sets(words, n) for n in lengths)


def set_digest(bounds: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each row's set; equal digests are taken for equal sets."""
    return mix(np.add.reduceat(mix(hashes ^ _SHIFTS[0]), bounds[:-1]) + np.diff(bounds).astype(np.uint64))


def sketches(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, the digest ``fp`` of the text's shingle set, ``bits``, the SimHash of its distinct words, and ``bands``, one key for each band."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp, bits, bands = [], [], []
        for (bounds, hashes), words in row_sets(batch.column("text"), SHINGLE, 1):
            rows = len(bounds) - 1
            fp.append(set_digest(bounds, hashes))
            bits.append(majorities(*words))
            key = np.empty((rows, BANDS), np.uint64)
            for b in range(BANDS):
                total = np.full(rows, b + 1, np.uint64)
                for k in range(b * ROWS, (b + 1) * ROWS):
                    x = hashes * _FACTORS[k] + _SHIFTS[k]
                    x ^= x >> np.uint64(32)
                    total = mix(total) + np.minimum.reduceat(x * _FACTORS[k - 1], bounds[:-1])
                key[:, b] = mix(total)
            bands.append(key.reshape(-1))
        fp, bits, bands = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (fp, bits, bands))
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(bands) + 1, BANDS, dtype=np.int32)), pa.array(bands.view(np.int64)))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fp.view(np.int64)), pa.array(bits.view(np.int64)), bands], [*keep, "fp", "bits", "bands"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_arrow(docs.select(*dict.fromkeys([*keep, "text"])), run, f"{schema}, fp long, bits long, bands array<long>")


def whole_sets(docs: DataFrame) -> DataFrame:
    """(of_fp, shingles): the sorted hashes of each text (fp, text), eight bytes each."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = []
        for ((bounds, hashes),) in row_sets(batch.column("text"), SHINGLE):
            sets += [hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        return pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(sets, pa.binary())], ["of_fp", "shingles"])

    return map_arrow(docs.select("fp", "text"), run, "of_fp long, shingles binary")


def similar(a: bytes, b: bytes, least: tuple[int, int] = SIMILAR) -> bool:
    """Whether two shingle sets have at least the similarity ``least``, in whole numbers."""
    n, m = len(a) // 8, len(b) // 8
    if least[1] * min(n, m) < least[0] * max(n, m):
        return False
    both = n + m - len(np.unique(np.concatenate([np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)])))
    return least[1] * both >= least[0] * (n + m - both)


def compact(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most so many rows, in fewer partitions if ``PART_ROWS`` a partition allow it: no small table becomes hundreds of files."""
    return df.coalesce(max(1, min(shuffle_parts(df.sparkSession), -(-rows // PART_ROWS))))


def _verified(pairs: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """The written ``pairs`` (u, v, any other columns), ``n`` in number, that are similar. Up to ``FEW_PAIRS`` of them go to the sets, so that only sets that a pair names shuffle."""
    left = sets.select(F.col("of_fp").alias("u"), F.col("shingles").alias("left_set"))
    right = sets.select(F.col("of_fp").alias("v"), F.col("shingles").alias("right_set"))
    if n <= FEW_PAIRS:
        left = left.join(F.broadcast(pairs), "u")
        right = right.join(F.broadcast(pairs.select("v").distinct()), "v", "left_semi")
    else:
        left = left.join(pairs, "u")
    names = pairs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = batch.column("left_set").to_pylist(), batch.column("right_set").to_pylist()
        return batch.select(names).filter(pa.array([similar(x, y) for x, y in zip(a, b)], pa.bool_()))

    met = left.join(right, "v").select(*names, "left_set", "right_set")
    return compact(map_arrow(met, run, ", ".join(f"{c} {kind}" for c, kind in pairs.dtypes)), n)


def frequencies(sets: DataFrame) -> np.ndarray:
    """A level for each of ``CELLS`` cells: four times the logarithm of how many shingles of ``sets`` fall into it.

    A task sends the cells that it has met with their counts; what comes back is a byte a cell, however many sets there are.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> pa.RecordBatch:
            count = np.bincount(np.concatenate(held), minlength=CELLS).reshape(-1, SEGMENT)
            rows = [(k, at.astype(np.uint16).tobytes(), np.minimum(count[k, at], 65535).astype(np.uint16).tobytes()) for k in range(len(count)) for at in [np.flatnonzero(count[k])] if len(at)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], ["segment", "at", "n"])

        held, size = [], 0
        for batch in batches:
            for value in batch.column("shingles"):
                held.append(cell_of(np.frombuffer(value.as_buffer(), np.uint64)))
                size += len(held[-1])
                if size >= 4 * SENT:
                    yield sent()
                    held, size = [], 0
        if size:
            yield sent()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, at, n in zip(*(batch.column(c).to_pylist() for c in ("segment", "at", "n"))):
                total.setdefault(segment, np.zeros(SEGMENT, np.int64))[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint16)
        rows = [(k, np.minimum(4 * np.log2(1 + v), 255).astype(np.uint8).tobytes()) for k, v in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["segment", "levels"])

    parts = sets.select("shingles").mapInArrow(counted, "segment int, at binary, n binary").repartition(min(CELLS // SEGMENT, shuffle_parts(sets.sparkSession)), "segment")
    levels = np.zeros((CELLS // SEGMENT, SEGMENT), np.uint8)
    for segment, part in parts.mapInArrow(summed, "segment int, levels binary").collect():  # a byte a cell
        levels[segment] = np.frombuffer(part, np.uint8)
    return levels.ravel()


def cell_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def rarest(keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Places of the first fifth, and one more, of a set's sorted shingles in the order of rarity."""
    few, many = SIMILAR
    order = (levels[cell_of(keys)].astype(np.uint64) << np.uint64(56)) | (keys >> np.uint64(8))
    return np.argsort(order, kind="stable")[: len(keys) * (many - few) // many + 1]  # equal ones stay sorted by themselves


def rare_shingles(sets: DataFrame) -> DataFrame:
    """(key, fp, n, pos): each set's first fifth in the order of rarity; pos counts from 0.

    Two sets at 0.8 have a first common shingle, and it stands in this part of both, whatever the order, as long as it is one
    for all sets. It is by the levels of ``frequencies``, then by hash: frequent shingles come last however many there are,
    and nothing but this fifth leaves a task.
    """
    sent = sets.sparkSession.sparkContext.broadcast(frequencies(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp, held in zip(batch.column("of_fp").to_pylist(), batch.column("shingles")):
                keys = np.frombuffer(held.as_buffer(), np.uint64)
                first = keys[rarest(keys, sent.value)].view(np.int64)
                for a in range(0, len(first), SENT):
                    part = first[a : a + SENT]
                    columns = [part, np.full(len(part), fp, np.int64), np.full(len(part), len(keys), np.int64), np.arange(a, a + len(part))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "fp", "n", "pos"])

    return sets.mapInArrow(run, "key long, fp long, n long, pos long")


def pivot_pairs(each: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v) of ``each`` (fp, bits; written), u < v: pairs of sets that join all whose fingerprints differ by ``radius`` bits or fewer, the closest first.

    Sets of one fingerprint are paired with the next ``FORESTS`` of them, and the least one stands for them before others.
    """
    least = written(compact(each.groupBy("bits").agg(F.min("fp").alias("least"), F.count("*").alias("n")), each.count()), "fingerprints")
    found = links_within(least.select(F.col("bits").alias("fp")), radius, forests=FORESTS).distinct()
    left = least.select(F.col("bits").alias("u"), F.col("least").alias("a"))
    right = least.select(F.col("bits").alias("v"), F.col("least").alias("b"))
    apart = found.join(left, "u").join(right, "v")
    equal = each.join(least.where("n > 1").select("bits"), "bits", "left_semi")
    ahead = [F.lead("fp", k).over(W.partitionBy("bits").orderBy("fp")) for k in range(1, FORESTS + 1)]
    equal = equal.select(F.col("fp").alias("a"), F.array(*ahead).alias("ahead")).select("a", F.explode("ahead").alias("b")).where("b is not null")
    return apart.select("a", "b").union(equal).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def similar_roots(members: DataFrame, sets: DataFrame, links: DataFrame | None = None, centres: int = CENTRES) -> DataFrame | None:
    """(node, root) of the components of all similar pairs among ``sets``, given their ``rare_shingles`` and the ``links`` known so far; None without any.

    Rows carry the least set that theirs is known to be joined with, their label. A round links labels, not sets: what was
    joined before takes no part again, and the rounds' links come together once, at the end.
    """
    few, many = SIMILAR
    live, found, old = members.withColumn("label", F.col("fp")), links, ()
    stars: list[DataFrame] = []
    size = members.count()
    while True:
        if found is not None:
            stars.append(connected_components(found, few=FEW_LINKS))
            moved = stars[-1].select(F.col("node").alias("label"), "root")
            live = live.join(moved, "label", "left").select("key", "fp", "n", "pos", F.coalesce("root", "label").alias("label"))
        live = written(compact(live, size), "live")
        forget(*old)
        open_keys = live.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
        now = written(compact(live.join(open_keys, "key", "left_semi"), size), "open")
        forget(live)
        size = now.count()
        if not size:
            forget(now)
            break
        part = F.pmod(F.xxhash64("fp"), F.lit(centres))
        # The rarest labels come first: a large group's members need no centre of their own. Among them those with the least of their own.
        # Counts and least members are taken by label before they meet, so that a large label is a few rows.
        mine = now.groupBy("key", "label", part.alias("part")).agg(F.count("*").alias("rows"), F.min(F.struct("pos", "fp", "n")).alias("m"))
        centre = mine.groupBy("key", "part").agg(F.min(F.struct("rows", "m.pos", "m.fp", "m.n", "label")).alias("c"))
        centre = centre.select("key", *[F.col(f"c.{c}").alias(f"centre_{c}") for c in ("fp", "n", "pos", "label")])
        centre = written(compact(centre, size), "centres")
        alike = F.least("n", "centre_n") * many >= F.greatest("n", "centre_n") * few
        # Where two sets meet first, all that they share lies from there on.
        room = F.least(F.col("n") - F.col("pos"), F.col("centre_n") - F.col("centre_pos")) * (few + many) >= (F.col("n") + F.col("centre_n")) * few
        met = now.join(centre, "key").where((F.col("label") != F.col("centre_label")) & alike & room)
        ahead = F.col("fp") < F.col("centre_fp")
        ends = [F.when(ahead, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("fp", "centre_fp", "u"), ("centre_fp", "fp", "v"), ("label", "centre_label", "a"), ("centre_label", "label", "b"))]
        pairs = written(compact(met.select(*ends).distinct(), size), "pairs")  # a set has one label
        n = pairs.count()
        grow, found = 64, None  # without pairs there is little left to meet
        if n:
            labels = written(_verified(pairs, sets, n).select("a", "b"), "similar")
            grow = 16  # without links no pair gets settled by joining others
            if not labels.isEmpty():
                grow, found = 8, labels
        old = (now, centre, pairs)
        live = now.join(centre.select("key", F.col("centre_fp").alias("fp")), ["key", "fp"], "left_anti")
        centres *= grow
    if len(stars) < 2:
        return stars[0] if stars else None
    union = stars[0]
    for s in stars[1:]:
        union = union.union(s)
    return connected_components(union, few=FEW_LINKS)


def one_of_each(docs: DataFrame, centres: int = CENTRES) -> DataFrame:
    """The rows of ``docs``, whatever their columns, that come first among their near-duplicates: by doc_id, nulls last, then by a hash of the row.

    Texts of fewer than five words are one shingle, those without words all alike; long texts are read in pieces. Equal rows
    stay once. An empty table gives an empty one.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    base = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"), whole.alias("whole")).withColumn("row", F.xxhash64("whole"))
    known = written(sketches(base, ["id", "row"]), "sketches")
    first = F.min(F.struct(F.col("id").isNull().alias("void"), "id", "row"))
    each = known.groupBy("fp").agg(F.first("bits").alias("bits"), F.first("bands").alias("bands"), first.alias("one"))
    each = written(compact(each, known.count()), "distinct")  # copies are one row from here on
    close = written(compact(pivot_pairs(each.select("fp", "bits")), each.count()), "close")
    keys = each.select(F.explode("bands").alias("key"), "fp")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    suspects = keys.join(shared, "key", "left_semi").select("fp")
    suspects = suspects.union(close.select("u")).union(close.select("v")).distinct()
    one = each.join(suspects, "fp", "left_semi").select("fp", F.col("one.id").alias("one_id"), F.col("one.row").alias("one_row"))
    texts = base.join(one, F.col("id").eqNullSafe(F.col("one_id")) & (F.col("row") == F.col("one_row"))).select("fp", "text").dropDuplicates(["fp"])
    sets = written(whole_sets(texts), "sets")
    links = written(_verified(close, sets, close.count()), "similar")
    forget(close)
    joined = similar_roots(written(rare_shingles(sets), "members"), sets, None if links.isEmpty() else links, centres)
    distinct = each.select("fp")
    if joined is None:
        roots = distinct.select(F.col("fp").alias("known_fp"), F.col("fp").alias("root"))
    else:
        joined = joined.select(F.col("node").alias("linked"), "root")
        roots = distinct.join(joined, distinct["fp"] == joined["linked"], "left").select(F.col("fp").alias("known_fp"), F.coalesce("root", "fp").alias("root"))
    return first_rows(base, known.select("id", "row", "fp"), roots)
