"""Numbers in text, in Turkish and plain notation, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What stands for a missing number.
NULL_TOKENS = ["", "-", "—", "–", "n.a.", "n/a", "na", "null", "none", "nan"]
SOURCE_NULLS = ["", "-", "ND", "null", "None", "nan"]

#: Share of numbers with one dot and three digits after it from which a column's dots part thousands.
DOT_THOUSANDS = 0.70
#: Share of a column's values that must read as numbers for it to be one.
NUMERIC_COLUMN = 0.60


#: How a finite number is written once its signs are plain.
PLAIN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,2})?$"


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(x), lambda v: use(v)), F.lit(0))


def number(text: Column) -> Column:
    """A double from plain notation, null for anything else; what is no number is never cast."""
    return bound(text, lambda t: F.when(t.rlike(PLAIN), t.try_cast("double")))


def _dots(t: Column) -> Column:
    return F.length(t) - F.length(F.replace(t, F.lit("."), F.lit("")))


def _commas(t: Column) -> Column:
    return F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))


def tr_number(text: Column, mode: str = "mixed") -> Column:
    """A double from Turkish notation: a comma is the decimal sign, ``%`` is dropped, null tokens give null.

    mode: ``mixed`` takes dots for thousands if there is a comma or more than one dot; ``strict`` always does.
    """
    return bound(F.trim(text), lambda raw: F.when(~F.lower(raw).isin(NULL_TOKENS), bound(F.regexp_replace(raw, "[ \u00a0%]", ""), lambda t: _read(t, mode))))


def _read(t: Column, mode: str) -> Column:
    plain = F.replace(t, F.lit("."), F.lit(""))
    if mode == "strict":
        return number(_commas(t))
    return number(F.when(F.contains(t, F.lit(",")), _commas(t)).when(t.rlike(r"\..*\."), plain).otherwise(t))


def source_number(text: Column) -> Column:
    """A double from a source's field: null tokens give null, a comma stands for the decimal point."""
    return bound(F.trim(text), lambda t: F.when(~t.isin(SOURCE_NULLS), number(F.replace(t, F.lit(","), F.lit(".")))))


def value_or_parsed(value: Column, raw: Column) -> Column:
    """The number that a parser left, else the one in the raw text."""
    return F.coalesce(F.when(~F.isnan(value), value), tr_number(raw))


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, "[\\s\u00a0%]", "")


def dot_tail_share(text: Column) -> Column:
    """Aggregate: the share of texts with one dot and no comma that have three digits after it; null if none has."""
    t = _bare(text)
    one_dot = (_dots(t) == 1) & ~F.contains(t, F.lit(","))
    return F.avg(F.when(one_dot, t.rlike(r"^[^.]*\.\d{3}$").cast("double")))


def inline_number(text: Column, share: Column) -> Column:
    """A double from a user's column, ``share`` being its ``dot_tail_share``: where most dots part thousands, all that can do."""
    thousands = F.coalesce(share, F.lit(0.0)) >= DOT_THOUSANDS

    def read(t: Column) -> Column:
        plain = F.replace(t, F.lit("."), F.lit(""))
        return number(F.when(F.contains(t, F.lit(",")), _commas(t)).when(t.rlike(r"\..*\."), plain).when(thousands & t.rlike(r"^[^.]*\.\d{3}$"), plain).otherwise(t))

    return bound(_bare(text), read)


def is_numeric_cell(text: Column) -> Column:
    """Whether a cell is a number and not a date."""
    date = r"^\s*(\d{4}-\d{1,2}(-\d{1,2})?|\d{1,2}[./]\d{1,2}[./]\d{4})\s*$"
    return F.coalesce(tr_number(text).isNotNull() & ~text.rlike(date), F.lit(False))


def coerce_columns(df: DataFrame, columns: list[str], least: float = NUMERIC_COLUMN) -> DataFrame:
    """``df`` with those text columns as doubles of which ``least`` of the non-null values read as numbers. One aggregation decides."""
    cells = {c: F.when(~F.coalesce(F.trim(c), F.lit("")).isin(""), F.col(c)) for c in columns}
    shares = df.agg(*[(F.count(tr_number(x)) / F.nullif(F.count(x), F.lit(0))).alias(c) for c, x in cells.items()]).first() if columns else None
    return df.withColumns({c: tr_number(F.col(c)) for c in columns if (shares[c] or 0) >= least})


def tolerance(x: Column) -> Column:
    """How far a quoted number may lie from the true one, by its size."""
    return bound(F.abs(x), lambda a: F.when(a < 1, F.lit(0.005)).when(a < 100, F.lit(0.05)).otherwise(F.greatest(F.lit(0.5), a * 0.001)))
