"""Writers: whole tables, replaced series and newest rows, none of which overwrites what it reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the largest ``order`` (null the smallest), as one aggregation; of equal ones the one with the largest digest, so that reruns agree."""
    rest = [c for c in rows.columns if c not in keys]
    at = F.struct(order, F.xxhash64(*rest), F.xxhash64(F.lit(1), *rest))  # two digests: rows equal in both are equal rows
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("_row")).select(*keys, "_row.*").select(*rows.columns)


def merge_last(existing: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Both tables' rows, ``new`` ones in place of existing ones with their key; of several new ones that with the largest ``order``.

    Orders compare by their own type, so 10 comes after 9; a null one comes before all others.
    """
    kind = next((df.schema[order].dataType for df in (new, existing) if order and order in df.columns), None)
    known = lambda df: F.col(order).cast(kind) if order and order in df.columns else F.lit(None).cast(kind or "int")
    seq = lambda df, n: df.withColumn("_seq", F.struct(F.lit(n).alias("table"), known(df).alias("at")))
    return keep_last(seq(existing, 0).unionByName(seq(new, 1), allowMissingColumns=True), keys, "_seq").drop("_seq")


def replace_series(existing: DataFrame, new: DataFrame, key: str = "series_id") -> DataFrame:
    """``existing`` without the series of ``new``, and ``new``; columns as in ``existing``."""
    ids = new.select(key).distinct()
    return existing.join(ids, key, "left_anti").select(*existing.columns).unionByName(new.select(*existing.columns))


def set_status(catalog: DataFrame, updates: DataFrame, key: str = "series_id") -> DataFrame:
    """``catalog`` with the columns of ``updates`` in place of its own where a key has an update that is not null."""
    changed = [c for c in updates.columns if c != key]
    u = updates.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in changed])
    out = catalog.join(u, F.col(key) == F.col("_key"), "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in changed else F.col(c) for c in catalog.columns])


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Write a new version of a table under ``path`` and return its folder; readers go on with the old version until they are told."""
    target = f"{path.rstrip('/')}/v-{uuid.uuid4().hex}"
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(target)
    return target


def write_sorted(df: DataFrame, path: str, keys: list[str], partitions: int) -> str:
    """As ``write_table``, ranged and sorted by ``keys`` within files, so that scans of a key read few row groups."""
    return write_table(df.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys), path)


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upsert_both(spark: SparkSession, facts: str, series: str, new_facts: DataFrame, new_series: DataFrame, root: str) -> tuple[str, str]:
    """Replace series in the fact and the metadata table: both are staged as new versions and returned together, so a failure leaves the old pair.

    A ``publication.Log`` does the same for any number of tables, and shows them to all readers at once.
    """
    staged_facts = write_table(replace_series(spark.read.parquet(facts), new_facts), f"{root}/facts")
    staged_series = write_table(replace_series(spark.read.parquet(series), new_series), f"{root}/series")
    return staged_facts, staged_series


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the smallest ``order``."""
    w = W.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
