"""Readers: series JSON, long and yearly CSV, messy CSV, wide sheets, nested JSON, grids, user rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates as T
from ..functions import numbers as N
from ..operators.ranges import hot_groups, numbered, with_groups
from ..schema import ContractError
from .scratch import written

# The fields of a source's records that are not its value, and the names that users give to dates and values.
NOT_VALUES = ["Tarih", "UNIXTIME", "YEARWEEK"]
DATE_KEYS = ["date", "tarih"]
VALUE_KEYS = ["value", "deger", "değer", "close", "kapanis", "kapanış"]
DELIMITERS = [";", ",", "\t", "|"]


def series_json(spark: SparkSession, path: str, folder_key: str | None = None) -> DataFrame:
    """(code, date_text, value_text, value, date) of files with one series each, an array of records; the code is the file's name, or its folder's ``folder_key=``.

    The value stands under the code with dots as underscores, else under the first key that is none of the known others.
    """
    code = F.col(folder_key).cast("string") if folder_key else F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1)
    text = spark.read.text(path, wholetext=True).select("value", code.alias("code"))
    rows = text.select("code", F.explode(F.from_json("value", "array<map<string,string>>")).alias("r"))
    own = F.try_element_at("r", F.replace("code", F.lit("."), F.lit("_")))
    other = F.try_element_at("r", F.get(F.filter(F.map_keys("r"), lambda k: ~k.isin(NOT_VALUES)), F.lit(0)))
    out = rows.select("code", F.try_element_at("r", F.lit("Tarih")).alias("date_text"), F.when(F.map_contains_key("r", F.replace("code", F.lit("."), F.lit("_"))), own).otherwise(other).alias("value_text"))
    return out.withColumns({"date": T.parse_source_date(F.col("date_text")), "value": N.source_number(F.col("value_text"))})


def long_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def annual_csv(spark: SparkSession, path: str, series_id: str, source: str, unit: str) -> DataFrame:
    """Observations of a CSV with a year and a value column, each at its year's end; other columns and repeated years raise."""
    df = spark.read.csv(path, header=True)
    if len(df.columns) != 2 or df.columns[0].strip().lower() != "year":
        raise ContractError("unexpected_columns", str(df.columns))
    rows = df.select(F.trim(df.columns[0]).try_cast("int").alias("year"), F.trim(df.columns[1]).try_cast("double").alias("value"))
    if rows.groupBy("year").count().where("count > 1 or year is null").first():
        raise ContractError("duplicate_year", path)
    end = F.make_date("year", F.lit(12), F.lit(31))
    return rows.select(F.lit(series_id).alias("series_id"), F.lit(source).alias("source"), end.alias("date"), F.make_date("year", F.lit(1), F.lit(1)).alias("period_start"), end.alias("period_end"), "value", F.lit("Y").alias("freq"), F.lit(unit).alias("unit"), F.lit("{}").alias("dims"))


def inline_series(rows: DataFrame, least: int = 3, least_share: float = 0.5, with_change: bool = False) -> DataFrame:
    """(date, value) of a user's text rows, sorted: known names of columns, dates and numbers in any of their notations, the last of equal dates.

    Raises with fewer than ``least`` good rows or less than ``least_share`` of all. with_change adds the change in percent.
    """
    names = {c.strip().lower(): c for c in rows.columns}
    pick = lambda keys: next((names[k] for k in keys if k in names), None)
    d, v = pick(DATE_KEYS), pick(VALUE_KEYS)
    if not d or not v:
        raise ContractError("missing_columns", f"no date or value among {rows.columns}")
    base = rows.select(F.col(d).cast("string").alias("d"), F.col(v).cast("string").alias("v"), F.monotonically_increasing_id().alias("n"))
    share = base.agg(N.dot_tail_share(F.col("v"))).scalar()
    read = base.withColumn("share", share).select(T.parse_inline_date(F.col("d")).alias("date"), N.inline_number(F.col("v"), F.col("share")).alias("value"), "n")
    good = read.where("date is not null and value is not null")
    total, n = base.count(), good.count()
    if n < least or n < least_share * total:
        raise ContractError("too_few_rows", f"{n} of {total} rows can be read")
    out = good.groupBy("date").agg(F.max_by("value", "n").alias("value"))
    if with_change:
        before = F.lag("value").over(W.orderBy("date"))  # one series
        out = out.withColumn("mom_pct_change", F.try_divide(F.col("value") - before, F.abs(before)) * 100)
    return out.orderBy("date")


def discover(spark: SparkSession, sources: dict[str, tuple[str | None, str | None]], fact_columns: list[str], series_columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(facts, series) of all sources' folder pairs; half a pair or missing columns raise."""
    facts = series = None
    for name, (a, b) in sorted(sources.items()):
        if a is None or b is None:
            raise ContractError("half_pair", name)
        f, s = spark.read.parquet(a), spark.read.parquet(b)
        for df, columns in ((f, fact_columns), (s, series_columns)):
            if missing := sorted(set(columns) - set(df.columns)):
                raise ContractError("missing_columns", f"{name} lacks {missing}")
        f, s = f.select(*fact_columns), s.select(*series_columns)
        facts, series = (f, s) if facts is None else (facts.unionByName(f), series.unionByName(s))
    return facts, series


def ragged_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files, blank lines left out; a file's lines are numbered within it."""
    return _placed_lines(spark, path).select("file", "line_no", "line")


def _placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, line_no, line): a file's lines from 0, blank ones counted and left out. Splits of a file are read apart, and each adds the lines before it."""
    read = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))
    lines = numbered(written(read, "lines"), ["at"], ["file"], "split", "line_no")
    return lines.select("file", "split", (F.col("line_no") - 1).cast("int").alias("line_no"), "line").where(F.trim("line") != "")


def ragged_csv(spark: SparkSession, path: str, head: int = 15) -> DataFrame:
    """(file, row_no, cells map<string,string>) of messy CSV files: delimiter, start and header of each file are found.

    The delimiter is the one that gives the widest rows; the table starts at the first row of full width; of the first
    ``head`` rows of that width the one with most filled cells that are not numbers is the header. Repeated or empty names
    get their position.
    """
    lines = _placed_lines(spark, path)
    tries = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(d).alias("delimiter")) for i, d in enumerate(DELIMITERS)])
    split = lines.select("file", "split", "line_no", "line", F.explode(tries).alias("t")).select("file", "split", "line_no", "t.rank", "t.delimiter", F.expr("split(line, concat('\\\\Q', t.delimiter, '\\\\E'))").alias("cells"))
    widths = split.groupBy("file", "rank", "delimiter").agg(F.max(F.size("cells")).alias("width"))
    best = widths.groupBy("file").agg(F.max_by(F.struct("delimiter", "width"), F.struct("width", (-F.col("rank")).alias("early"))).alias("b")).select("file", "b.delimiter", "b.width")
    best = written(best, "delimiters")
    hot = hot_groups(lines, ["file"])
    rows = with_groups(split.drop("rank"), best.withColumnRenamed("delimiter", "_own"), ["file"], hot).where((F.col("delimiter") == F.col("_own")) & (F.size("cells") == F.col("width"))).select("file", "split", "line_no", F.transform("cells", lambda c: F.trim(F.regexp_replace(c, '^\\s*"|"\\s*$', ""))).alias("cells"))
    rows = numbered(written(rows, "rows"), ["line_no"], ["file"], "split", "row_no")
    label = F.size(F.filter("cells", lambda c: (c != "") & ~N.is_numeric_cell(c)))
    header = rows.where(F.col("row_no") <= head).withColumn("score", label)
    header = header.groupBy("file").agg(F.max_by(F.struct("row_no", "cells"), F.struct("score", (-F.col("row_no")).alias("early"))).alias("h"))
    named = F.transform("h.cells", lambda c, i: F.when((c == "") | (F.array_position(F.col("h.cells"), c) != i + 1), F.concat(F.lit("column_"), (i + 1).cast("string"))).otherwise(c))
    header = header.select("file", F.col("h.row_no").alias("header_no"), named.alias("names"))
    out = with_groups(rows, written(header, "headers"), ["file"], hot).where("row_no > header_no")
    return out.select("file", (F.col("row_no") - F.col("header_no")).alias("row_no"), F.map_from_arrays("names", "cells").alias("cells"))


def wide_to_long(df: DataFrame, ids: list[str], rename: dict[str, str] | None = None) -> DataFrame:
    """(ids, variable, value_raw, value) of a wide sheet: every other column becomes rows, empty cells left out."""
    text = df.select(*[F.col(f"`{c}`").alias((rename or {}).get(c, c)) if c in ids else F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    ids = [(rename or {}).get(c, c) for c in ids]
    long = text.unpivot(ids, [c for c in text.columns if c not in ids], "variable", "value_raw")
    return long.where(F.trim("value_raw") != "").withColumn("value", N.tr_number(F.col("value_raw")))


def item_column(df: DataFrame) -> str:
    """The text column of a sheet with most distinct non-numeric values: its items."""
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    if not texts:
        raise ContractError("no_item_column", str(df.columns))
    counts = df.agg(*[F.count_distinct(F.when(~N.is_numeric_cell(F.col(f"`{c}`")) & (F.trim(f"`{c}`") != ""), F.col(f"`{c}`"))).alias(c) for c in texts]).first()
    return max(texts, key=lambda c: (counts[c], -texts.index(c)))


def _join_path(path: Column, key: Column, index: Column) -> Column:
    step = F.when(key.isNotNull(), F.concat(F.lit("."), key)).otherwise(F.concat(F.lit("["), index.cast("string"), F.lit("]")))
    return F.concat(path, step)


def flatten_json(docs: DataFrame, key: str, json: str, root: str = "Json", depth: int = 8) -> DataFrame:
    """(key, field, value_raw, value) of every leaf of a JSON text, up to ``depth`` levels; ``field`` is its path like ``Json.a.b[0]``.

    A level is one explode that leaves scalars as they are, so the work is one pass, as long as the depth. Empty objects and
    arrays have no leaves; what is nested deeper stays as JSON text.
    """
    level = docs.select(F.col(key), F.lit(root).alias("field"), F.try_parse_json(F.col(json)).alias("v")).where("v is not null")
    for _ in range(depth):
        parts = level.sparkSession.tvf.variant_explode_outer(F.col("v").outer())
        level = level.lateralJoin(parts).select(F.col(key), F.col("field").alias("path"), F.col("v").alias("whole"), "pos", F.col("key").alias("k") if key != "key" else parts["key"].alias("k"), F.col("value").alias("part"))
        leaf = F.col("pos").isNull()
        level = level.select(key, F.when(leaf, F.col("path")).otherwise(_join_path(F.col("path"), F.col("k"), F.col("pos"))).alias("field"), F.when(leaf, F.col("whole")).otherwise(F.col("part")).alias("v"))
    raw = F.coalesce(F.try_variant_get("v", "$", "string"), F.to_json("v"))
    leaves = level.select(key, "field", raw.alias("value_raw")).where("value_raw is null or value_raw not in ('{}', '[]')")
    return leaves.withColumn("value", N.source_number(F.col("value_raw")))


def rebuild_grid(flat: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, column_name, label, value_raw) of a grid that ``flatten_json`` took apart: its column models, names and row cells.

    Cells meet their columns by key and position, an equi join; cells without a column raise as they are computed.
    """
    part = lambda pattern, k=1: F.regexp_extract("field", pattern, k)
    model = flat.where(F.col("field").rlike(r"colModels\[\d+\]\.name$")).select(*keys, part(r"colModels\[(\d+)\]").try_cast("int").alias("c"), F.col("value_raw").alias("column_name"))
    names = flat.where(F.col("field").rlike(r"colNames\[\d+\]$")).select(*keys, part(r"colNames\[(\d+)\]").try_cast("int").alias("c"), F.col("value_raw").alias("label"))
    pattern = r"data\.rows\[(\d+)\]\.cell\[(\d+)\]$"
    cells = flat.where(F.col("field").rlike(pattern)).select(*keys, part(pattern, 1).try_cast("int").alias("row"), part(pattern, 2).try_cast("int").alias("c"), "value_raw")
    out = cells.join(model.join(names, [*keys, "c"], "left"), [*keys, "c"], "left")
    fail = F.raise_error(F.lit("a grid's cell has no column")).cast("string")
    return out.select(*keys, "row", F.coalesce("column_name", fail).alias("column_name"), "label", "value_raw")


def grid_series(cells: DataFrame, keys: list[str], structural: list[str]) -> DataFrame:
    """(keys, row, the structural columns, metric, value): a grid's rows with their descriptive cells beside each numeric one."""
    heads = cells.where(F.col("column_name").isin(structural)).groupBy(*keys, "row").agg(*[F.max(F.when(F.col("column_name") == s, F.col("value_raw"))).alias(s) for s in structural])
    metrics = cells.where(~F.col("column_name").isin(structural))
    return metrics.join(heads, [*keys, "row"], "left").select(*keys, "row", *structural, F.col("column_name").alias("metric"), N.tr_number(F.col("value_raw")).alias("value"))


def junk_rows(variable: str = "variable", category: str = "category", value: str = "value") -> Column:
    """Whether a sheet's row is a header: a period or unnamed label, or the category's own name without a value."""
    v = F.coalesce(F.col(variable), F.lit(""))
    return v.rlike("(?i)Dönem:|Unnamed") | ((F.trim(v) == F.trim(F.coalesce(category, F.lit("")))) & F.col(value).isNull())


def with_parents(rows: DataFrame, keys: list[str], order: str, item: str = "item") -> DataFrame:
    """``rows`` with ``parent``: a lettered child ``a) ...`` has the latest item without a letter before it; roots have themselves. Orphans raise."""
    child = F.coalesce(F.col(item).rlike("^[a-zçğıöşü]\\)"), F.lit(False))
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    parent = F.last(F.when(~child, F.col(item)), ignorenulls=True).over(w)
    return rows.withColumn("parent", F.coalesce(parent, F.when(child, F.raise_error(F.concat(F.lit("no parent for "), F.col(item))).cast("string"))))


def synced_metadata(catalog: DataFrame, groups: DataFrame, series: DataFrame) -> DataFrame:
    """The catalog with its datagroups' and series' own names, frequency, unit and tags, the more specific ones first."""
    g = groups.select(F.col("group_code").alias("_g"), F.col("group_name").alias("_gn"), F.col("freq").alias("_gf"), F.col("unit").alias("_gu"))
    s = series.select(F.col("series_id").alias("_s"), F.col("name").alias("_sn"), F.col("freq").alias("_sf"), F.col("unit").alias("_su"), F.col("tags").alias("_st"))
    out = catalog.join(g, F.col("group_code") == F.col("_g"), "left").join(s, F.col("series_id") == F.col("_s"), "left")
    tags = F.filter(F.transform(F.split(F.coalesce("_st", F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
    return out.select("series_id", "group_code", F.coalesce("_sn", "name", "_gn").alias("name"), F.coalesce("_sf", "_gf").alias("freq"), F.coalesce("_su", "_gu").alias("unit"), tags.alias("tags"))
