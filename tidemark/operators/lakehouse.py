"""The lakehouse layers: source Silver, canonical Silver, aligned tables, and the load of single series."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as T
from ..functions import dims as D
from ..functions import numbers as N
from ..functions import text as TX
from ..functions.codes import code_dims
from ..schema import ContractError
from ..sources import readers, sinks
from ..sources.publication import BUCKETS, Log, Snapshot
from ..sources.scratch import written
from . import align, change, contracts
from .search import semantic_text

OBS = ["series_id", "source", "date", "period_start", "period_end", "value", "freq", "unit", "dims", "source_file"]

# Provinces in the order of their plate codes, and what stands for abroad.
PROVINCES = (
    "Adana Adıyaman Afyonkarahisar Ağrı Amasya Ankara Antalya Artvin Aydın Balıkesir Bilecik Bingöl Bitlis Bolu Burdur Bursa Çanakkale Çankırı Çorum Denizli Diyarbakır Edirne Elazığ Erzincan "
    "Erzurum Eskişehir Gaziantep Giresun Gümüşhane Hakkari Hatay Isparta Mersin İstanbul İzmir Kars Kastamonu Kayseri Kırklareli Kırşehir Kocaeli Konya Kütahya Malatya Manisa Kahramanmaraş Mardin "
    "Muğla Muş Nevşehir Niğde Ordu Rize Sakarya Samsun Siirt Sinop Sivas Tekirdağ Tokat Trabzon Tunceli Şanlıurfa Uşak Van Yozgat Zonguldak Aksaray Bayburt Karaman Kırıkkale Batman Şırnak Bartın "
    "Ardahan Iğdır Yalova Karabük Kilis Osmaniye Düzce"
).split()
ABROAD = "YURT DIŞI"
# Units of the regional tables (a null metric: all of the table), and of monthly categories whose headers name none.
TABLE_UNITS = [
    (1, None, "bin TL"), (2, None, "bin TL"), (3, None, "bin TL"), (4, None, "bin TL"), (5, None, "%"), (7, None, "bin TL"),
    (6, "SubeSayisi", "adet"), (6, "SubeyeDusenNufus", "kişi"), (6, "KisiBasiNakdiKredi", "TL"), (6, "KisiBasiTakiptekiAlacak", "TL"), (6, "KisiBasiTasarrufMevduati", "TL"), (6, "KisiBasiToplamMevduat", "TL"),
]
CATEGORY_UNITS = {"Diğer Bilgiler": "adet", "Rasyolar": "%", "Yurt Dışı Şube Rasyoları": "%"}


def table_units(spark: SparkSession) -> DataFrame:
    """The shipped units of the regional tables, for ``regional_silver``."""
    return spark.createDataFrame(TABLE_UNITS, "table_no int, metric string, unit string")


def provinces(spark: SparkSession) -> DataFrame:
    """(city, province, plate_code): a source's capital names, as they are written, and plate codes."""
    upper = str.maketrans("iı", "İI")
    return spark.createDataFrame([(p.translate(upper).upper(), p, f"{k:02d}") for k, p in enumerate(PROVINCES, 1)], "city string, province string, plate_code string")


def geo_dims(obs: DataFrame, places: DataFrame) -> DataFrame:
    """``obs`` with ``sehir`` and ``grup`` in dims as province, plate_code, geo_level and group, other keys kept; unknown cities raise."""
    entries = F.coalesce(F.from_json("dims", "map<string,string>"), F.create_map().cast("map<string,string>"))
    rows = obs.withColumn("_m", entries).withColumn("_city", F.trim(F.try_element_at("_m", F.lit("sehir"))))
    p = places.select(F.col("city").alias("_c"), F.col("province").alias("_p"), F.col("plate_code").alias("_code"))
    rows = rows.join(F.broadcast(p), F.col("_city") == F.col("_c"), "left")  # 81 rows
    unknown = F.raise_error(F.concat(F.lit("unknown province "), F.col("_city"))).cast("string")
    abroad, some = F.col("_city") == ABROAD, F.col("_city").isNotNull() & (F.col("_city") != "")
    own = F.map_from_entries(
        F.filter(
            F.array(
                F.struct(F.lit("province").alias("key"), F.when(some, F.when(abroad, F.lit("Yurt Dışı")).otherwise(F.coalesce("_p", unknown))).alias("value")),
                F.struct(F.lit("geo_level").alias("key"), F.when(some, F.when(abroad, "international").otherwise("province")).alias("value")),
                F.struct(F.lit("plate_code").alias("key"), F.when(some & ~abroad, F.col("_code")).alias("value")),
                F.struct(F.lit("group").alias("key"), F.try_element_at("_m", F.lit("grup")).alias("value")),
            ),
            lambda e: e["value"].isNotNull(),
        )
    )
    rest = F.map_filter("_m", lambda k, _: ~k.isin("sehir", "grup", "province", "geo_level", "plate_code", "group"))
    return rows.withColumn("dims", D.canonical(F.to_json(F.map_concat(own, rest)))).drop("_m", "_city", "_c", "_p", "_code")


def id_metadata(series_id: Column) -> dict[str, Column]:
    """code, name, category and description that an id ``SOURCE:category:...:item`` tells."""
    parts = F.split(series_id, ":")
    words = lambda c: F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
    name = words(F.regexp_replace(F.element_at(parts, -1), "_periodic$", ""))
    described = F.concat_ws(" - ", F.transform(F.slice(parts, 2, F.size(parts)), lambda p: words(F.regexp_replace(p, "_periodic$", ""))))
    return {"code": F.array_join(F.slice(parts, 2, F.size(parts)), ":"), "name": name, "category": F.try_element_at(parts, F.lit(2)), "description": F.concat(described, F.when(series_id.endswith("_periodic"), " (period value)").otherwise(""))}


def weekly_silver(rows: DataFrame, source: str, unit: str) -> DataFrame:
    """Observations of a weekly bulletin (date, category, row_no, item, variable, value_raw, value, source_file): Monday to the reported day."""
    number = F.regexp_replace(F.trim(F.col("row_no").cast("string")), r"\.0$", "")
    number = F.coalesce(F.nullif(number, F.lit("")), F.raise_error(F.lit("empty row_no")).cast("string"))
    sid = TX.series_id(source, TX.slug(F.col("category")), F.concat(F.lit("r"), TX.slug(number)), TX.slug(F.col("item")))
    day = F.to_date("date")
    return rows.select(
        sid.alias("series_id"), F.lit(source).alias("source"), day.alias("date"), T.period_start(day, F.lit("W")).alias("period_start"), day.alias("period_end"), N.value_or_parsed(F.col("value"), F.col("value_raw")).alias("value"),
        F.lit("W").alias("freq"), F.lit(unit).alias("unit"), D.build(para_cinsi=F.nullif(F.trim("variable"), F.lit(""))).alias("dims"), "source_file",
    )


def monthly_silver(rows: DataFrame, source: str, units: dict[str, str] = CATEGORY_UNITS) -> DataFrame:
    """Observations of a monthly bulletin (year, month, category, row_index, item, variable, value_raw, value, source_file).

    Header rows go; lettered items stand under the item before them. The unit of a category is the one that its own header
    rows name, else the one in ``units``; without either its rows raise.
    """
    keyed = rows.withColumn("date", F.last_day(F.make_date("year", "month", F.lit(1))))
    named = keyed.groupBy(F.col("category").alias("_cat")).agg(F.max(TX.unit_from_header(F.col("variable"))).alias("_unit"))
    good = keyed.where(~readers.junk_rows())
    items = readers.with_parents(good.select("date", "category", "row_index", "item").distinct(), ["date", "category"], "row_index").withColumnRenamed("parent", "_parent")
    good = contracts.join_unique(good, items.select("date", "category", "row_index", "item", "_parent"), ["date", "category", "row_index", "item"])
    good = good.join(named, F.col("category") == F.col("_cat"), "left")
    known = F.coalesce(*[F.when(F.col("category") == c, F.lit(u)) for c, u in units.items()], F.lit(None).cast("string"))
    unit = F.coalesce("_unit", known, F.raise_error(F.concat(F.lit("no unit for "), F.col("category"))).cast("string"))
    inner = F.when(F.col("_parent") != F.col("item"), TX.slug(F.col("_parent")))
    return good.select(
        TX.series_id(source, TX.slug(F.col("category")), inner, TX.slug(F.col("item"))).alias("series_id"), F.lit(source).alias("source"), "date", F.trunc("date", "MM").alias("period_start"), F.col("date").alias("period_end"),
        N.value_or_parsed(F.col("value"), F.col("value_raw")).alias("value"), F.lit("M").alias("freq"), unit.alias("unit"), D.build(para_cinsi=F.nullif(F.trim("variable"), F.lit(""))).alias("dims"), "source_file",
    )


def regional_silver(cells: DataFrame, source: str, units: DataFrame) -> DataFrame:
    """Quarterly observations of rebuilt grids (year, month, table_no, sehir, grup, metric, value, source_file); units: table_no, metric (null: any), unit."""
    quarter = F.when(F.col("month").isin(3, 6, 9, 12), F.last_day(F.make_date("year", "month", F.lit(1)))).otherwise(F.raise_error(F.lit("not a quarter's month")).cast("date"))
    u = units.select(F.col("table_no").alias("_t"), F.col("metric").alias("_m"), F.col("unit").alias("_u"))
    rows = cells.withColumn("date", quarter).join(u, (F.col("table_no") == F.col("_t")) & (F.col("_m").isNull() | (F.col("metric") == F.col("_m"))), "left")
    unit = F.coalesce("_u", F.raise_error(F.concat(F.lit("no unit for table "), F.col("table_no").cast("string"))).cast("string"))
    return rows.select(
        TX.series_id(source, F.concat(F.lit("t"), F.col("table_no").cast("string")), TX.slug(F.col("metric"))).alias("series_id"), F.lit(source).alias("source"), "date", F.trunc("date", "QUARTER").alias("period_start"), F.col("date").alias("period_end"),
        "value", F.lit("Q").alias("freq"), unit.alias("unit"), D.build(sehir=F.nullif(F.trim("sehir"), F.lit("")), grup=F.nullif(F.trim("grup"), F.lit(""))).alias("dims"), "source_file",
    )


def api_silver(records: DataFrame, catalog: DataFrame, source: str, existing: DataFrame | None = None) -> DataFrame:
    """Observations of ``series_json`` records with a catalog (code, freq_text, unit): all of them, or merged into ``existing`` ones, newest per series and date."""
    c = catalog.select(F.col("code").alias("_code"), TX.frequency(F.col("freq_text")).alias("freq"), "unit")
    rows = records.where("date is not null").join(c, F.col("code") == F.col("_code"))
    out = rows.select(
        F.col("date").alias("_read"), TX.series_id(source, F.col("code")).alias("series_id"), F.lit(source).alias("source"), T.period_end(F.col("date"), F.col("freq")).alias("date"), T.period_start(F.col("date"), F.col("freq")).alias("period_start"), T.period_end(F.col("date"), F.col("freq")).alias("period_end"),
        "value", "freq", "unit", code_dims(F.col("code")).alias("dims"), F.concat("code", F.lit(".json")).alias("source_file"),
    )
    out = sinks.keep_last(out, ["series_id", "date"], "_read").drop("_read")  # of a period's readings the one dated last
    return out if existing is None else sinks.merge_last(existing.select(*OBS), out.select(*OBS), ["series_id", "date"])


def canonical(facts: list[DataFrame], series: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(facts, series) of all sources: canonical dims, reviewed series only, and the contracts that must hold, checked."""
    obs = reduce(lambda a, b: a.unionByName(b), [f.select(*OBS) for f in facts])
    meta = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), series).where("nature_reviewed")
    obs = contracts.reviewed_only(obs.withColumns({"dims": D.canonical(F.col("dims"), lenient=False), "value": F.when(~F.isnan("value"), F.col("value"))}), meta)
    obs = written(obs, "canonical")  # the layer is a table; its contracts are checked on what was written
    if meta.where(F.col("nature").isNull() | ~F.col("nature").isin("stock", "flow", "rate", "price")).first():
        raise ContractError("unclassified", "a reviewed series has no nature")
    contracts.enforce(contracts.observation_violations(obs), "canonical facts")
    contracts.enforce(contracts.series_violations(meta), "canonical series")
    if gap := contracts.coverage_gaps(obs, meta).first():
        raise ContractError("coverage", f"{gap['series_id']} is in {gap['side']}")
    return obs, meta


def load_series(obs: DataFrame, meta: DataFrame, layers: dict[str, DataFrame], context: str = "batch") -> tuple[dict[str, DataFrame], str]:
    """``layers`` (facts, series, aligned) with one more series in place of its old rows, and its status.

    An unclassified series raises in a ``batch`` and is stored but never aligned ``live``; one that is classified but not
    reviewed is aligned, and stopped only at gold.
    """
    row = meta.first()
    pending = row is None or (row["nature"] or "unclassified") == "unclassified"
    if pending and context == "batch":
        raise ContractError("unclassified", "a batch load needs a classified series")
    out = dict(layers)
    out["facts"] = sinks.replace_series(layers["facts"], obs.select(*layers["facts"].columns))
    out["series"] = sinks.replace_series(layers["series"], meta.select(*layers["series"].columns))
    if not pending:
        out["aligned"] = sinks.replace_series(layers["aligned"], align.monthly(obs, meta))
    return out, "pending_review" if pending else "loaded"


#: The tables of a published lakehouse, and the columns that each is in buckets by.
LAYERS = {"facts": ["series_id"], "series": ["series_id"], "aligned": ["series_id"], "embeddings": ["series_id"]}


def create_lakehouse(log: Log, facts: DataFrame, series: DataFrame, aligned: DataFrame, embeddings: DataFrame, buckets: int = BUCKETS) -> Snapshot:
    """Publish the first set of a lakehouse's four tables."""
    with log.begin("created") as load:
        for table, rows in {"facts": facts, "series": series, "aligned": aligned, "embeddings": embeddings}.items():
            load.write(table, rows, LAYERS[table], buckets)
    return load.published


def load_published(log: Log, obs: DataFrame, meta: DataFrame, context: str = "batch", embed: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Load any number of series into all four tables of a published lakehouse at once; returns (series_id, status, n_obs, first_date, last_date, last_value).

    Each series' old rows go from every table. The facts are canonical: dims sorted, NaN null, of a key's readings the one
    dated last in its period. An unclassified series stops a ``batch``; ``live`` it is stored as pending review with no
    aligned rows, also where it had some before. ``embed`` gives (series_id, semantic_text, embedding) for (metadata, facts),
    hashed words unless given. Contracts run on what was staged; after any failure readers go on with the old set.
    """
    if context not in ("batch", "live"):
        raise ContractError("bad_context", context)
    meta = written(meta, "new_series")
    obs = obs.withColumns({"dims": D.canonical(F.col("dims")), "date": F.col("period_end"), "value": F.when(~F.isnan("value"), F.col("value"))})
    obs = written(sinks.keep_last(obs.withColumn("_read", F.struct("period_end", "source_file")), ["series_id", "date", "dims"], "_read").drop("_read"), "new_facts")
    pending = F.coalesce(F.col("nature"), F.lit("unclassified")) == "unclassified"
    if context == "batch" and (row := meta.where(pending).agg(F.min("series_id").alias("id"), F.count("*").alias("n")).first())["n"]:
        raise ContractError("unclassified", f"a batch load needs classified series; {row['n']} are not, {row['id']} among them")
    if gap := contracts.coverage_gaps(obs, meta).first():
        raise ContractError("coverage", f"{gap['series_id']} is in {gap['side']}")
    ready = meta.where(~pending)
    with log.begin(f"{context} load") as load:
        load.replace("facts", obs, meta)
        load.audit("facts", contracts.observation_violations)
        load.replace("series", meta)
        load.audit("series", contracts.series_violations)
        load.replace("aligned", align.monthly(obs.join(ready.select("series_id"), "series_id", "left_semi"), ready), meta)
        load.audit("aligned", lambda rows: contracts.aligned_violations(rows, load.changed("series")))
        load.replace("embeddings", (embed or _hashed)(meta, obs), meta)
    summary = obs.groupBy("series_id").agg(F.count("*").alias("n_obs"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max_by("value", F.when(F.col("value").isNotNull(), F.col("date"))).alias("last_value"))
    return meta.select("series_id", F.when(pending, "pending_review").otherwise("loaded").alias("status")).join(summary, "series_id", "left")


def _hashed(meta: DataFrame, obs: DataFrame) -> DataFrame:
    return embed_catalog(meta, obs).select("series_id", "semantic_text", "embedding")


def bank_silver(weekly: DataFrame, monthly: DataFrame, regional: DataFrame, accumulating: DataFrame) -> DataFrame:
    """All bank observations, with the period values of the accumulating series (series_id, accumulation) beside them."""
    return weekly.unionByName(change.with_periodic(monthly, accumulating)).unionByName(regional)


def embed_catalog(meta: DataFrame, obs: DataFrame, vectors: DataFrame | None = None, existing: DataFrame | None = None) -> DataFrame:
    """Catalog rows with semantic text and vectors: given ones (series_id, embedding), or hashed words; into ``existing``, replacing their series, if given."""
    from .search import hashed_embeddings

    rows = semantic_text(meta, obs, [c for c in ("name", "category", "unit", "freq") if c in meta.columns])
    rows = rows.join(vectors, "series_id") if vectors is not None else hashed_embeddings(rows)
    if existing is None:
        return rows
    if existing.limit(1).count() == 0:
        raise ContractError("empty_catalog", "an empty catalog is built, not updated")
    return sinks.replace_series(existing, rows)
