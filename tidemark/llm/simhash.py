"""SimHash near-duplicates found through pivot distance tables.

Each distinct fingerprint gets a table row: its Hamming distances to many reference fingerprints. By the triangle
inequality two fingerprints within ``radius`` differ by at most ``radius`` in every coordinate. Ranges of a few coordinates
make cells, and only rows of one cell can be a pair; within a cell, rows are sorted by a coordinate, those further apart in
it are never paired, pairs with another coordinate too far apart are discarded, and only the survivors are compared.

Cells are coarse, as distances to any reference crowd about 32 bits. A cell that fills up is not compared pair by pair: its
rows go to buckets by one of ``radius + 1`` runs of bits, one of which is equal in any pair, and a full bucket's rows to
finer ones, by a run of their remaining bits, until a bucket is small or its remaining bits bound it. Buckets are searched
through the pivot table as cells are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow, shuffle_parts, text_bytes, written
from .components import connected_components, merged

RADIUS = 3
#: Bytes of a text whose words stand in memory at once.
PIECE = 1 << 20
N_PIVOTS = 32
#: Pivots whose distances, in ranges of ``CELL``, make a cell.
CELL_PIVOTS, CELL = 4, 8
#: Rows of a bucket that are compared with each other; a bucket with more goes to finer buckets.
BUCKET_ROWS = 512
#: Buckets that share all but so many bits are compared whatever they hold: 2**14 distinct fingerprints at most.
LEAST_BITS = 14


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit majority of the shingles' XXH64, words split at ASCII white space and A-Z lowered; 0 without words."""
    ones, total, seam, at = np.zeros(64, np.int64), 0, [], 0
    digest = xxhash.xxh64_intdigest
    while at < len(text):
        cut = at + PIECE
        while cut < len(text) and text[cut] not in b" \t\n\v\f\r":
            cut += 1
        words = seam + text[at:cut].lower().split()
        at = cut
        if len(words) >= shingle:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = [0, *ends[:-1].tolist()]
            ends = (ends - 1).tolist()
            h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :])), np.uint64, len(words) - shingle + 1)
            for k in range(0, len(h), 1 << 16):
                part = h[k : k + (1 << 16)]
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(h)
        seam = words[1 - shingle :] if shingle > 1 else []
    if not total:
        return digest(b" ".join(seam), seed) if seam else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def majorities(bounds: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The 64-bit majority of each row's hashes, ``hashes[bounds[k] : bounds[k + 1]]``, of which none is empty."""
    count, out = np.diff(bounds), np.zeros(len(bounds) - 1, np.uint64)
    for b in range(64):
        ones = np.add.reduceat((hashes >> np.uint64(b)) & np.uint64(1), bounds[:-1])
        out |= (2 * ones.astype(np.int64) > count).astype(np.uint64) << np.uint64(b)
    return out


def with_fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``fp``, the fingerprint's 64 bits as a long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.fromiter((fingerprint(t) for t in text_bytes(batch.column("text"))), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fp.view(np.int64))], [*keep, "fp"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_arrow(docs.select(*dict.fromkeys([*keep, "text"])), run, f"{schema}, fp long")


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """Reference fingerprints: random ones, about 32 bits from most fingerprints."""
    return np.random.default_rng(7).integers(0, 1 << 64, n, dtype=np.uint64)


def pivot_table(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)


def lightest_forest(n: int, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the links (i, j) that join what all of them join among ``n`` nodes, as light as can be (Boruvka's rounds)."""
    order = np.lexsort((j, i, weight))
    i, j = i[order], j[order]
    label, chosen = np.arange(n), np.zeros(len(i), bool)
    while True:
        apart = np.flatnonzero(label[i] != label[j])
        if not len(apart):
            return order[chosen]
        best = np.full(n, len(i))  # the lightest link that leaves a group
        np.minimum.at(best, label[i[apart]], apart)
        np.minimum.at(best, label[j[apart]], apart)
        best = np.unique(best[best < len(i)])
        chosen[best] = True
        label = merged(label, i[best], j[best])


def bucket_links(bucket: np.ndarray, fp: np.ndarray, refs: np.ndarray, radius: int, forests: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that join, bucket by bucket, what ``radius`` joins there: a spanning set, not all pairs.

    bucket: sorted; fp: distinct within a bucket. Links lead to a group's first row. With ``forests`` they are pairs within
    ``radius``: the closest that span the groups, then the closest others that span what they can, so many times.
    """
    table = pivot_table(fp, refs)
    order = np.lexsort((table[:, 0], bucket))  # by the first coordinate: what lies further on than the radius is never paired
    bucket, fp, table = bucket[order], fp[order], table[order]
    left, right = [], []
    at, step = np.arange(len(fp)), 1
    while True:
        at = at[at + step < len(fp)]
        at = at[(bucket[at] == bucket[at + step]) & (table[at + step, 0] - table[at, 0] <= radius)]
        if not len(at):
            break
        i, j = at, at + step
        for c in range(1, table.shape[1], 8):  # a pair falls at its first coordinates that are too far apart
            near = np.abs(table[i, c : c + 8] - table[j, c : c + 8]).max(axis=1) <= radius
            i, j = i[near], j[near]
        near = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        left.append(i[near])
        right.append(j[near])
        step += 1
    if not left:
        return fp[:0], fp[:0]
    i, j = np.concatenate(left), np.concatenate(right)
    if forests:
        bits, taken = np.bitwise_count(fp[i] ^ fp[j]), np.zeros(len(i), bool)
        for _ in range(forests):
            rest = np.flatnonzero(~taken)
            taken[rest[lightest_forest(len(fp), i[rest], j[rest], bits[rest])]] = True
        return fp[i[taken]], fp[j[taken]]
    label = merged(np.arange(len(fp)), i, j)
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return fp[linked], fp[label[linked]]


def bit_blocks(bits: list[int], n: int) -> list[int]:
    """``bits`` cut into n runs of about equal length, as masks."""
    return [sum(1 << int(b) for b in run) for run in np.array_split(np.array(bits), n)]


def cell_rows(fps: DataFrame, radius: int, n_pivots: int) -> DataFrame:
    """(mask, key, fp): the cells of each ``fp``, all with mask 0.

    A cell is a range of ``CELL`` distances to each of the first ``CELL_PIVOTS`` pivots. A row whose distance lies within
    ``radius`` above a range's beginning also stands in the range before, so that any two rows within ``radius`` bits meet.
    """
    refs = pivots(n_pivots)[:CELL_PIVOTS]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        owner, key = np.arange(len(fp)), np.zeros(len(fp), np.int64)
        for distance in pivot_table(fp, refs).T.astype(np.int64):
            own = distance[owner]
            edge = (own % CELL < radius) & (own >= CELL)
            key = key * 64 + own // CELL
            owner, key = np.concatenate([owner, owner[edge]]), np.concatenate([key, key[edge] - 1])
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(owner), np.int64)), pa.array(key), pa.array(fp[owner].view(np.int64))], ["mask", "key", "fp"])

    return map_arrow(fps.select("fp"), run, "mask long, key long, fp long")


def finer_masks(mask: int, radius: int) -> list[int]:
    """``mask`` and one of ``radius + 1`` runs of its remaining bits: one of these runs is equal in any pair."""
    rest = [b for b in range(64) if not mask >> b & 1]  # of mask 0, a cell's, all bits
    return [mask | run for run in bit_blocks(rest, radius + 1)]


def _compare(keyed: DataFrame, radius: int, bucket_rows: int, n_pivots: int, forests: int) -> DataFrame:
    """(u, v, mask): links of the full buckets with mask null; rows (fp, null, mask) of the buckets to refine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots(n_pivots)
        held: list[np.ndarray] = [np.empty(0, np.uint64)] * 3
        over = None  # (mask, key) of the bucket that is passed on

        def done(m, k, f):
            """Results for whole buckets."""
            if not len(m):
                return
            new = np.concatenate([[True], (m[1:] != m[:-1]) | (k[1:] != k[:-1])])
            bucket = np.cumsum(new) - 1
            size = np.bincount(bucket)
            bounded = (m != 0) & (np.bitwise_count(~m) <= LEAST_BITS)
            small = (size[bucket] <= bucket_rows) | bounded
            u, v = bucket_links(bucket[small], f[small], refs, radius, forests)
            yield out(u, v, None)
            if not small.all():
                yield out(f[~small], None, m[~small])

        def out(u, v, m):
            signed = lambda x: pa.nulls(len(u), pa.int64()) if x is None else pa.array(x.view(np.int64))
            return pa.RecordBatch.from_arrays([signed(u), signed(v), signed(m)], ["u", "v", "mask"])

        for batch in batches:
            m, k, f = (np.concatenate([h, batch.column(c).to_numpy().astype(np.int64).view(np.uint64)]) for h, c in zip(held, ("mask", "key", "fp")))
            if not len(m):
                continue
            if over is not None:  # the rest of a bucket that is passed on
                same = (m == over[0]) & (k == over[1])
                if same.any():
                    yield out(f[same], None, m[same])
                m, k, f = m[~same], k[~same], f[~same]
                if not len(m):
                    held = [m, k, f]
                    continue
                over = None
            last = (m == m[-1]) & (k == k[-1])
            first = len(m) - int(last.sum())
            yield from done(m[:first], k[:first], f[:first])
            held = [m[first:], k[first:], f[first:]]
            if len(held[0]) > bucket_rows and np.bitwise_count(~held[0][:1])[0] > LEAST_BITS:
                over = (held[0][0], held[1][0])
                yield out(held[2], None, held[0])
                held = [x[:0] for x in held]
        yield from done(*held)

    return keyed.mapInArrow(run, "u long, v long, mask long")


def links_within(fps: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS, n_pivots: int = N_PIVOTS, forests: int = 0) -> DataFrame:
    """(u, v) links over the distinct ``fp`` of ``fps`` whose components are those of all pairs within ``radius`` bits.

    With ``forests`` the links themselves are such pairs, for a check that follows: see ``bucket_links``. Some may come twice.
    """
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    cells = cell_rows(fps, radius, n_pivots)
    # Distances crowd about their mean, so a middle cell may hold a tenth of all rows: crowded cells are told by their counts
    # and never meet in a task. There are at most (64 / CELL + 1) ** CELL_PIVOTS cells.
    crowded = F.broadcast(written(cells.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows).select("key"), "crowded"))
    full = written(cells.join(crowded, "key", "left_semi").select(F.col("fp").alias("u"), "mask").distinct(), "full")
    keyed, links = cells.join(crowded, "key", "left_anti").select("mask", "key", "fp"), None
    while True:
        keyed = keyed.repartition(shuffle_parts(fps.sparkSession), "mask", "key").sortWithinPartitions("mask", "key")
        found = written(_compare(keyed, radius, bucket_rows, n_pivots, forests), "pairs")
        here = found.where("mask is null").select("u", "v")
        full = found.where("mask is not null").select("u", "mask") if links is not None else full
        links = here if links is None else links.union(here)
        used = [r["mask"] for r in full.select("mask").distinct().collect()]  # masks, of which a level has few hundred
        if not used:
            return links
        finer = {m: [signed(x) for x in finer_masks(m % (1 << 64), radius)] for m in used}
        table = fps.sparkSession.createDataFrame([(m, x) for m, xs in finer.items() for x in xs], "mask long, finer long")
        rows = full.select(F.col("u").alias("fp"), "mask").distinct().join(F.broadcast(table), "mask").select("fp", F.col("finer").alias("mask"))
        keyed = rows.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp")


def roots_of(fps: DataFrame, radius: int = RADIUS, **options) -> DataFrame:
    """(known_fp, root) of every distinct ``fp`` of ``fps`` (written): root is the smallest one of its component."""
    distinct = written(fps.select("fp").distinct(), "distinct")
    roots = connected_components(links_within(distinct, radius, **options)).select(F.col("node").alias("linked"), "root")
    return distinct.join(roots, distinct["fp"] == roots["linked"], "left").select(F.col("fp").alias("known_fp"), F.coalesce("root", "fp").alias("root"))


def first_rows(base: DataFrame, fps: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows ``whole`` of ``base`` (id, row, whole) that come first in their component; fps: (id, row, fp), roots: (known_fp, root)."""
    first = F.min(F.struct(F.col("id").isNull().alias("void"), "id", "row"))
    one = fps.groupBy("fp").agg(first.alias("one"))  # a large group of copies is one row from here on
    firsts = one.join(roots, one["fp"] == roots["known_fp"]).groupBy("root").agg(F.min("one").alias("first"))
    firsts = firsts.select(F.col("first.id").alias("first_id"), F.col("first.row").alias("first_row")).distinct()
    met = base.select("id", "row", "whole").join(firsts, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("row") == F.col("first_row")), "left_semi")
    place = F.row_number().over(W.partitionBy("id", "row").orderBy("row"))  # equal rows stay once
    return met.withColumn("place", place).where("place = 1").select("whole.*")


def one_of_each(docs: DataFrame, radius: int = RADIUS, **options) -> DataFrame:
    """The rows of ``docs``, whatever their columns, that come first in their component: by doc_id, nulls last, then by a hash of the row."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    base = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"), whole.alias("whole")).withColumn("row", F.xxhash64("whole"))
    fps = written(with_fingerprints(base, ["id", "row"]), "fingerprints")
    roots = roots_of(fps, radius, **options)
    return first_rows(base, fps, roots)


def components_of(fps: DataFrame, radius: int = RADIUS, **options) -> DataFrame:
    """``fps`` (doc_id, fp; written) to (doc_id, fp, component_id)."""
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(links_within(distinct.select("fp"), radius, **options))
    member = written(roots.join(distinct, roots["node"] == distinct["fp"]).select("fp", "root", "least"), "members")
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    merged = member.join(least, "root").select(F.col("fp").alias("merged_fp"), "component_id")
    ids = distinct.join(merged, distinct["fp"] == merged["merged_fp"], "left")
    ids = ids.select(F.col("fp").alias("known_fp"), F.coalesce("component_id", "least").alias("component_id"))
    return fps.join(ids, fps["fp"] == ids["known_fp"]).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, **options) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text). Long texts are read in pieces; other columns are not read; an empty table gives an empty one.

    component_id is the smallest non-null doc_id of the component, null if it has none; null and empty texts have
    fingerprint zero and link like others. Repeated rows appear as often as they came.
    """
    fps = written(with_fingerprints(docs.select("doc_id", F.col("text").cast("string").alias("text")), ["doc_id"]), "fingerprints")
    out = components_of(fps, radius, **options)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
