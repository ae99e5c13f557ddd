"""The registered ``opN_*`` queries: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align_tokens, chat, chunks, exact, hard_negatives, html_text, language_model, mixing, piecewise, quality, simhash, templates, toxicity

_SAID = "</s>[INST] ok [/INST]"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", F.round("log_weight", 6).alias("log_weight"), F.round("sample_key", 6).alias("sample_key"), "keep"
    )


@query
def op9_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "dedup.repeated", "dedup.removed_chars", F.size("dedup.spans").alias("n_spans"), "text")


@query
def op3_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_subset_sum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


@query
def op10_ordinal_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.graded(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.transform("exceed", lambda p: F.round(p, 6)).alias("exceed"), F.round("expected_severity", 6).alias("expected_severity"), "toxic")


@query
def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(table(spark, sf_dir, "documents"))


@query
def op4_scored_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


@query
def op7_piecewise_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.fingerprinted(table(spark, sf_dir, "documents"))


@query
def op8_prefix_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = _SAID
    extra = turns.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.packed(turns.unionByName(extra)))


@query
def op11_bloom_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.marked(table(spark, sf_dir, "documents"))


ORACLES["op11_bloom_exact_dedup"] = """
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS x, length(coalesce(text, '')) AS n FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY x) AS group_size, row_number() OVER w = 1 AS kept, sha256(x) AS text_sha256
FROM d WINDOW w AS (PARTITION BY x ORDER BY n DESC, doc_id NULLS LAST)"""


@query
def op12_covering_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens.aligned(table(spark, sf_dir, "documents"))


@query
def op13_anchor_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"))


ORACLES["op13_anchor_tree_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, v.vec_id, v.label, CAST(list_inner_product(a.v, v.v) AS BIGINT) AS score
  FROM v AS a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id
),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE label <> anchor_label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10"""


_CONTROL = "|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in chat.CONTROL)
#: Roles hold no backslash or line feed. A control string takes one character more when it is escaped.
ORACLES["op8_prefix_tree_chat"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_SAID}' UNION ALL SELECT -1, 1, 'assistant', '{_SAID}'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) AS turns_sha256,
  CAST(coalesce(sum(length(x)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat.BEGIN) + len(chat.END) + 2} + length(r) + length(x) + len(regexp_extract_all(x, '{_CONTROL}')) + len(regexp_extract_all(r, '{_CONTROL}'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""
