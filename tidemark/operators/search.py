"""Search over the series catalog: by vector, by words, and the texts that both look at."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dims as D
from ..functions.text import tokens
from ..schema import ContractError

PHRASE_BONUS, LEXICAL_LEAST = 0.15, 0.60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null for a zero vector or unequal lengths."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


#: Rows whose products with all queries of a block are taken at once, and queries that are sent to all tasks at once.
ROW_BLOCK, QUERY_BLOCK = 1024, 4096
#: Similarities are told apart to so many decimals; equal ones go by key.
PLACES = 12


def _vectors(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, matrix, rows of another length) of the vectors with ``size`` components, none of them null."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == size)
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components as NaN
    return rows, flat.reshape(len(rows), size), np.flatnonzero((lengths >= 0) & (lengths != size))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero vector, or one with a null, has no direction: NaN."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cosine_top(catalog: DataFrame, query: list[float], k: int = 5, threshold: float = 0.45, embedding: str = "embedding", norm: str | None = None) -> DataFrame:
    """The ``k`` rows nearest to ``query`` with ``similarity`` of at least ``threshold``: one job, in which each task keeps its best ``k``.

    ``norm`` names a column that holds the vectors' lengths, which then are not computed. Null and zero vectors match
    nothing; a vector of another length than the query raises.
    """
    if not any(query):
        raise ContractError("zero_vector", "the query vector is zero")
    key, q = catalog.columns[0], np.array(query, np.float64)
    q = q / np.sqrt(q @ q)
    out = T.StructType([*catalog.schema.fields, T.StructField("similarity", T.DoubleType()), T.StructField("_odd", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            rows, x, odd = _vectors(batch.column(embedding), len(q))
            with np.errstate(invalid="ignore", divide="ignore"):
                lengths = batch.column(norm).to_numpy(zero_copy_only=False).astype(np.float64)[rows] if norm else np.sqrt(np.einsum("ij,ij->i", x, x))
                near = np.einsum("ij,j->i", x, q) / np.where(lengths > 0, lengths, np.nan)  # equal vectors come out equal
            good = np.flatnonzero(near >= threshold)
            rows, near = np.r_[rows[good], odd[:1]], np.r_[near[good], np.zeros(len(odd[:1]))]
            found = pa.Table.from_batches([batch]).take(pa.array(rows)).append_column("similarity", pa.array(near)).append_column("_odd", pa.array(np.arange(len(rows)) >= len(good)))
            best = found if best is None else pa.concat_tables([best, found])
            best = best.sort_by([("_odd", "descending"), ("similarity", "descending"), (key, "ascending")]).slice(0, k + 1)
        if best is not None:
            yield from best.combine_chunks().to_batches()

    top = catalog.mapInArrow(run, out).orderBy(F.desc("_odd"), F.desc("similarity"), key).limit(k + 1).toArrow()  # k + 1 rows
    if top.num_rows and top.column("_odd")[0].as_py():
        raise ContractError("dimension_mismatch", f"the query has {len(query)} dimensions")
    return catalog.sparkSession.createDataFrame(top.slice(0, k).drop_columns(["_odd"]), T.StructType(out.fields[:-1]))


def _best_of(found: pa.Table, key: str, k: int) -> pa.Table:
    """The first ``k`` rows of each query by similarity, then key."""
    found = found.sort_by([("query", "ascending"), ("similarity", "descending"), (key, "ascending")])
    query = found.column("query").to_numpy()
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return found.filter(pa.array(place < k))


def cosine_top_each(catalog: DataFrame, queries: DataFrame, key: str, query_key: str, k: int = 5, embedding: str = "embedding") -> DataFrame:
    """(query_key, key, similarity, rank): the nearest ``k`` rows to each of a stated set of queries, themselves left out.

    Queries go over all rows in blocks of about ``QUERY_BLOCK``. A task multiplies blocks of rows with the block of queries
    and keeps each query's best ``k``; these few rows shuffle and are ranked. Similarities are rounded to 12 places.
    """
    asked = queries.select(F.col(key).alias(query_key), F.col(embedding).alias("_query"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField(key, catalog.schema[key].dataType), T.StructField("similarity", T.DoubleType())])
    order = W.partitionBy(query_key).orderBy(F.desc("similarity"), key)
    out = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == b).toArrow()  # about QUERY_BLOCK rows
        names, sizes = block.column(query_key).combine_chunks(), block.column("_query").combine_chunks()
        sent = catalog.sparkSession.sparkContext.broadcast([(rows, _unit(x)) for n in sorted(set(sizes.value_lengths().drop_null().to_pylist())) for rows, x, _ in [_vectors(sizes, n)]])
        own: dict = {}
        for at, name in enumerate(names.to_pylist()):
            own.setdefault(name, []).append(at)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, own=own) -> Iterator[pa.RecordBatch]:
            best = None
            for batch in batches:
                order_ = pc.sort_indices(batch.column(key))
                batch, found = batch.take(order_), []
                for asked_at, q in sent.value:
                    rows, x, _ = _vectors(batch.column(embedding), q.shape[1])
                    for a in range(0, len(rows), ROW_BLOCK):
                        at = rows[a : a + ROW_BLOCK]
                        near = np.round(_unit(x[a : a + ROW_BLOCK]) @ q.T, PLACES)
                        for i, name in enumerate(batch.column(key).take(pa.array(at)).to_pylist()):
                            for j in own.get(name, ()):
                                near[i, np.flatnonzero(asked_at == j)] = np.nan
                        # Rows stand by key: a place's last bit less for each row lets equal ones go by it.
                        ranked = np.nan_to_num(near, nan=-9.0) - np.arange(len(at))[:, None] * 2.0**-52
                        few = min(k, len(at))
                        top = np.argpartition(-ranked, few - 1, axis=0)[:few]
                        column = np.broadcast_to(np.arange(q.shape[0]), top.shape)
                        kept = ~np.isnan(near[top, column])
                        found.append((asked_at[column[kept]], at[top[kept]], near[top, column][kept]))
                if found:
                    query, at, near = (np.concatenate(v) for v in zip(*found))
                    table = pa.table({"query": pa.array(query, pa.int64()), key: batch.column(key).take(pa.array(at)), "similarity": pa.array(near)})
                    best = _best_of(table if best is None else pa.concat_tables([best, table]), key, k)
            if best is not None:
                yield from best.combine_chunks().to_batches()

        named = catalog.sparkSession.createDataFrame(pa.table({query_key: names, "_at": pa.array(np.arange(len(names)))})) if len(names) else None
        if named is None:
            continue
        top = catalog.select(key, embedding).mapInArrow(run, schema).join(F.broadcast(named), F.col("query") == F.col("_at")).select(query_key, key, "similarity")
        top = top.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = top if out is None else out.unionByName(top)
    if out is None:
        return asked.join(catalog.select(key), F.lit(False)).select(query_key, key, F.lit(0.0).alias("similarity"), F.lit(0).alias("rank"))
    return out


def lexical_score(text: Column, query: str) -> Column:
    """Share of the query's words that ``text`` holds, and a bonus if it holds the whole query; 1 at most."""
    t, words = F.lower(text), tokens(F.lit(query))
    hits = F.size(F.filter(words, lambda w: F.contains(t, w)))
    bonus = F.when(F.contains(t, F.lit(query.lower().strip())), PHRASE_BONUS).otherwise(0.0)
    return F.coalesce(F.least(F.lit(1.0), F.try_divide(hits, F.size(words)) + bonus), F.lit(0.0))


def lexical_top(catalog: DataFrame, query: str, text: Column, k: int = 5, threshold: float = LEXICAL_LEAST) -> DataFrame:
    """The ``k`` rows that hold most of the query's words."""
    scored = catalog.withColumn("score", lexical_score(text, query)).where(F.col("score") >= max(threshold, LEXICAL_LEAST))
    return scored.orderBy(F.desc("score"), catalog.columns[0]).limit(k)


def find(catalog: DataFrame, query: str, text: Column, code: str, archived: Column, k: int = 10) -> DataFrame:
    """The ``k`` rows with most of the query's words, archived ones last, then by code."""
    words = tokens(F.lit(query))
    hits = F.size(F.filter(words, lambda w: F.contains(F.lower(text), w)))
    return catalog.withColumns({"hits": hits, "archived": archived}).where("hits > 0").orderBy(F.desc("hits"), "archived", code).limit(k)


def dims_summary(obs: DataFrame) -> DataFrame:
    """(series_id, dims_summary): the distinct ``key=value`` pairs of a series' dims, sorted, joined by ``; ``."""
    each = obs.select("series_id", "dims").distinct().select("series_id", F.explode_outer(D.pairs(F.col("dims"))).alias("pair"))
    return each.groupBy("series_id").agg(F.array_join(F.array_sort(F.collect_set("pair")), "; ").alias("dims_summary"))


def semantic_text(meta: DataFrame, obs: DataFrame, parts: list[str]) -> DataFrame:
    """``meta`` with dims_summary, n_obs, first_date, last_date and ``semantic_text``, the searchable text of its ``parts``."""
    span = obs.groupBy("series_id").agg(F.count("*").alias("n_obs"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    out = meta.join(span, "series_id", "left").join(dims_summary(obs), "series_id", "left")
    shown = [F.when(F.col(p).isNotNull() & (F.col(p) != ""), F.concat(F.lit(f"{p}: "), F.col(p))) for p in [*parts, "dims_summary"]]
    return out.withColumn("semantic_text", F.concat_ws(". ", *shown))


def hashed_embeddings(catalog: DataFrame, text: str = "semantic_text", size: int = 64) -> DataFrame:
    """``catalog`` with an ``embedding`` of hashed, inverse-document-frequency weighted words, for catalogs without a model's vectors."""
    from pyspark.ml.feature import IDF, HashingTF
    from pyspark.ml.functions import vector_to_array

    if catalog.limit(1).count() == 0:
        return catalog.withColumn("embedding", F.lit(None).cast("array<float>"))
    words = catalog.withColumn("_words", tokens(F.coalesce(F.col(text), F.lit(""))))
    counted = HashingTF(numFeatures=size, inputCol="_words", outputCol="_tf").transform(words)
    weighed = IDF(inputCol="_tf", outputCol="_v").fit(counted).transform(counted)
    return weighed.withColumn("embedding", vector_to_array("_v", "float32")).drop("_words", "_tf", "_v")
