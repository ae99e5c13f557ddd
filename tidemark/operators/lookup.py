"""Finding series, choosing their dimension, and structured table queries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dims as D
from ..functions.text import identifier
from ..schema import ContractError

#: The value that stands for a total among several of a dimension.
TOTAL = "Toplam"
MAX_ROWS, DEFAULT_ROWS = 2000, 200
WRITES = ["DROP", "DELETE", "INSERT", "UPDATE", "ALTER", "CREATE", "ATTACH", "COPY"]
_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def resolve_series(ids: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query, series_id, layer) of each ``wanted`` (query) among ``ids`` (series_id, layer, layer_rank): gold before silver, an exact match before a suffix of either.

    Suffixes meet by their last part after a colon, so that no two tables are crossed.
    """
    tail = lambda c: F.element_at(F.split(c, ":"), -1)
    q = wanted.select("query", identifier(F.col("query")).alias("q")).withColumn("t", tail("q"))
    s = ids.select("series_id", "layer", "layer_rank", identifier(F.col("series_id")).alias("s")).withColumn("t", tail("s"))
    rank = F.when(F.col("q") == F.col("s"), 0).when(F.col("s").endswith(F.concat(F.lit(":"), F.col("q"))) | F.col("q").endswith(F.concat(F.lit(":"), F.col("s"))), 1)
    met = q.join(s, "t").withColumn("rank", rank).where("rank is not null")
    order = W.partitionBy("query").orderBy("layer_rank", "rank", "series_id")
    return met.withColumn("n", F.row_number().over(order)).where("n = 1").select("query", "series_id", "layer")


def choose_dimension(obs: DataFrame, key: str, requested: str | None = None) -> DataFrame:
    """(series_id, choice, n_values): the requested value if the series has it, else null without values, the only one, or the total; raises else.

    One aggregation; the choice of each series is a row.
    """
    value = D.get(F.col("dims"), key)
    found = obs.groupBy("series_id").agg(F.count_distinct(value).alias("n_values"), F.max(F.when(value == F.lit(requested), value)).alias("asked"), F.max(value).alias("any"), F.max(F.when(value == TOTAL, value)).alias("total"))
    fail = F.raise_error(F.concat(F.lit("ambiguous dimension of "), F.col("series_id"))).cast("string")
    choice = F.when(F.col("asked").isNotNull(), F.col("asked")).when(F.col("n_values") <= 1, F.col("any")).otherwise(F.coalesce("total", fail))
    return found.select("series_id", choice.alias("choice"), "n_values")


def in_dimension(obs: DataFrame, key: str, choices: DataFrame) -> DataFrame:
    """The rows of each series in its chosen dimension, or without one where the choice is null."""
    c = choices.select(F.col("series_id").alias("_id"), "choice")
    met = obs.join(c, F.col("series_id") == F.col("_id"))
    return met.where(D.get(F.col("dims"), key).eqNullSafe(F.col("choice"))).drop("_id", "choice")


def with_attribute(rows: DataFrame, table: DataFrame, column: str, default: str, key: str = "series_id") -> DataFrame:
    """``rows`` with ``column`` of the row of ``table`` that has their key, or ``default`` where there is none, or a null.

    Of several rows with a key the smallest value stands, so that rows neither multiply nor depend on an order; a null key has the default.
    """
    known = table.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(column).alias("_value"))
    return rows.drop(column).join(known, F.col(key) == F.col("_key"), "left").withColumn(column, F.coalesce("_value", F.lit(default))).drop("_key", "_value")


def read_only(sql: str) -> str:
    """``sql`` if it holds none of the words that write; raises else."""
    if m := re.search(r"\b(" + "|".join(WRITES) + r")\b", sql, re.I):
        raise ContractError("not_read_only", m.group(1).upper())
    return sql


def _column(df: DataFrame, name: str, dims: str) -> Column:
    """A column, or the value under that key of the dims; ``dimension`` means the key ``variable``."""
    if name in df.columns:
        return F.col(name)
    if dims in df.columns and _NAME.match(name):
        return D.get(F.col(dims), "variable" if name == "dimension" else name)
    raise ContractError("unknown_column", name)


def table_query(
    spark: SparkSession,
    table: str | DataFrame,
    columns: list[str] | None = None,
    filters: dict | None = None,
    start: str | None = None,
    end: str | None = None,
    date_column: str = "date",
    order_by: str | None = None,
    descending: bool = False,
    limit: int = DEFAULT_ROWS,
    dims: str = "dims",
) -> DataFrame:
    """Rows of a table: columns and dims keys to show, equality filters (a list means any of it, None means null), a date range, an order and at most 2,000 rows.

    Start and end come together. Everything is built of columns, so no text of the request is ever parsed as SQL.
    """
    if (start is None) != (end is None):
        raise ContractError("half_range", "start and end come together")
    if not 1 <= limit <= MAX_ROWS:
        raise ContractError("bad_limit", str(limit))
    if isinstance(table, str):
        if not spark.catalog.tableExists(table):
            raise ContractError("unknown_table", table)
        df = spark.table(table)
    else:
        df = table
    shown = [_column(df, c, dims).alias(c) for c in columns] if columns else [F.col(c) for c in df.columns]
    for name, value in (filters or {}).items():
        c = _column(df, name, dims)
        df = df.where(c.isNull() if value is None else c.isin(list(value)) if isinstance(value, (list, tuple, set)) else c == F.lit(value))
    if start is not None:
        d = _column(df, date_column, dims)
        df = df.where((d >= F.lit(start).cast("date")) & (d <= F.lit(end).cast("date")))
    if order_by:
        c = _column(df, order_by, dims)
        df = df.orderBy(c.desc() if descending else c.asc())
    return df.select(*shown).limit(limit)


def units_of(df: DataFrame) -> dict[str, str]:
    """The units in a table's column metadata."""
    return {f.name: f.metadata["unit"] for f in df.schema if "unit" in (f.metadata or {})}
