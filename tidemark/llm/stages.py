"""The stages of the corpus pipeline: each takes and, but for the last, returns rows with the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import chunks, mixing, near, quality, templates
from .common import text_or_empty, written

__all__ = ["STAGES", "written"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling against the labelled good ones keeps."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more), the one with the smallest doc_id.

    SimHash and pivot tables pair most of them before the exact check; an exact join adds what lies beyond their radius.
    """
    return near.one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in an earlier one; those of which nothing is left go. n_chars follows the text."""
    named = "dedup"
    while named in docs.columns:
        named += "_"
    out = chunks.dedup(docs, named=named)
    removed = F.col(f"`{named}`.removed_chars")
    blank = F.trim(F.regexp_replace(text_or_empty(), r"[\x09-\x0D]", " ")) == ""
    out = out.where((removed == 0) | ~blank)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(removed > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item's template."""
    return templates.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their texts and other columns, and copies, taken, source_size and target of each.

    Columns of ``docs`` by one of these names go. Rows that are equal in all columns come as one, with what they take together.
    """
    mine = ("copies", "taken", "source_size", "target")
    rest = [c for c in docs.columns if c not in mine]
    base = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("document")).withColumn("ref", F.xxhash64("document"))
    # Only hashes of rows go through the mixing; the texts are shuffled once, to what was taken of them.
    taken = mixing.mixed(base, carry="ref").where("copies > 0").groupBy("ref").agg(F.sum("copies").alias("copies"), F.sum("taken").alias("taken"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    met = base.select("document", F.col("ref").alias("of_ref")).join(taken, F.col("of_ref") == F.col("ref"))
    once = met.withColumn("place", F.row_number().over(W.partitionBy("ref").orderBy("ref"))).where("place = 1")
    return once.select("document.*", *mine)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]
