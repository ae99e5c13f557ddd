"""Layers as views of one namespace, the catalog of tables, and comments and units on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..schema import CATALOG, ContractError


@dataclass(frozen=True)
class Entry:
    """A table of a layer; ``path`` is its folder or null for a view over others."""

    name: str
    layer: str
    path: str | None
    description: str


def register(spark: SparkSession, tables: dict[str, DataFrame], layer: str | None = None) -> list[str]:
    """Views ``layer_name`` (or plain names) over the tables; they are lazy and shadow what had the name."""
    names = []
    for name, df in tables.items():
        view = f"{layer}_{name}" if layer else name
        df.createOrReplaceTempView(view)
        names.append(view)
    return names


def catalog_table(spark: SparkSession, entries: list[Entry]) -> DataFrame:
    """(table_name, layer, source_path, description), made from the registry; repeated names raise."""
    names = [e.name for e in entries]
    if len(set(names)) != len(names):
        raise ContractError("duplicate_table", str(sorted(n for n in set(names) if names.count(n) > 1)))
    return spark.createDataFrame([(e.name, e.layer, e.path, e.description) for e in entries], CATALOG)


def described(df: DataFrame, comments: dict[str, str], units: dict[str, str] | None = None) -> DataFrame:
    """``df`` with comments and units in its columns' metadata, which written tables keep."""
    if unknown := sorted({*comments, *(units or {})} - set(df.columns)):
        raise ContractError("unknown_column", str(unknown))
    for c in {*comments, *(units or {})}:
        df = df.withMetadata(c, {k: v for k, v in (("comment", comments.get(c)), ("unit", (units or {}).get(c))) if v})
    return df


def comment_table(spark: SparkSession, table: str, text: str) -> None:
    """A comment on a saved table."""
    if not spark.catalog.tableExists(table):
        raise ContractError("unknown_table", table)
    quoted = text.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"COMMENT ON TABLE {'.'.join(f'`{p}`' for p in table.split('.'))} IS '{quoted}'")
