"""Gold tables as a graph: what each is built from, in which order, and which need to be built again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ContractError
from ..sources.publication import BUCKETS, Load, Log
from . import gold
from .contracts import require_reviewed, reviewed_only

# The shipped wide tables, by column, and the two series of the metals table and the two of credit quality.
_LOANS = "BDDK_MONTHLY:tuketici_kredileri:tuketici_kredileri_konut"
WIDE_TABLES = {
    "gold_housing_credit_market": {
        "konut_kredisi_hacmi_tp": gold.Slice(_LOANS, "variable", "TP"),
        "konut_kredisi_hacmi_yp": gold.Slice(_LOANS, "variable", "YP"),
        "konut_kredisi_hacmi_toplam": gold.Slice(_LOANS, "variable", "Toplam"),
        "konut_kredisi_faiz_orani": gold.Slice("EVDS:TP.KTF12"),
        "konut_fiyat_endeksi": gold.Slice("EVDS:TP.KFE.TR"),
        "toplam_konut_satisi": gold.Slice("EVDS:TP.AKONUTSAT1.KTRTOPLAM"),
    },
    "gold_credit_market": {
        "toplam_kredi_hacmi": gold.Slice("BDDK_MONTHLY:krediler:toplam_krediler", "variable", "Toplam"),
        "yurtici_toplam_kredi_hacmi_evds": gold.Slice("EVDS:TP.KREHACBS.A1"),
        "ticari_kredi_faiz_orani": gold.Slice("EVDS:TP.KTF17"),
    },
    "gold_deposit_market": {
        "mevduat_katilim_fonu_tp": gold.Slice("BDDK_MONTHLY:bilanco:mevduat_katilim_fonu", "variable", "TP"),
        "tl_mevduat_faiz_orani": gold.Slice("EVDS:TP.TRY.MT06"),
    },
}
METALS = ("EVDS:TP.ALTINPIYASA.KAP03", "EVDS:TP.GUMUSPIYASA.KAP03")
QUALITY = ("BDDK_FINTURK:t1:nakdikrediler", "BDDK_FINTURK:t1:takiptekialacaklar")


@dataclass(frozen=True)
class Spec:
    """A gold table: its inputs (tables of the set, gold ones included), how it is built from them, and what of them it reads.

    series: the only series that it reads of each input; without an entry it reads the whole input. ``version`` changes
    when the way it is built does.
    """

    name: str
    inputs: tuple[str, ...]
    build: Callable[[dict[str, DataFrame]], DataFrame]
    keys: tuple[str, ...] = ("date",)
    series: dict[str, tuple[str, ...]] = field(default_factory=dict)
    version: str = "1"


def ordered(specs: list[Spec], given: set[str]) -> list[Spec]:
    """Specs with each after its inputs, by name among those that could come next; raises for a cycle, a repeated name and an unknown input."""
    by_name = {s.name: s for s in specs}
    if len(by_name) < len(specs) or given & set(by_name):
        raise ContractError("duplicate_table", str(sorted(s.name for s in specs)))
    if unknown := sorted({i for s in specs for i in s.inputs} - given - set(by_name)):
        raise ContractError("unknown_input", str(unknown))
    waiting = {s.name: {i for i in s.inputs if i in by_name} for s in specs}
    out = []
    while waiting:
        free = sorted(n for n, needs in waiting.items() if not needs)
        if not free:
            raise ContractError("cycle", str(sorted(waiting)))
        for n in free:
            out.append(by_name[n])
            del waiting[n]
        for needs in waiting.values():
            needs.difference_update(free)
    return out


def fingerprints(load: Load, spec: Spec) -> dict[str, str]:
    """What a table depends on, as it is now: its version, and of each input the buckets that it reads."""
    out = {"": spec.version}
    for table in spec.inputs:
        buckets = None
        if ids := spec.series.get(table):
            buckets = load.now.buckets(table, load.log.spark.createDataFrame([(i,) for i in ids], "series_id string"))
        out[table] = load.now.fingerprint(table, buckets)
    return out


def rebuild(log: Log, specs: list[Spec], buckets: int = BUCKETS) -> list[str]:
    """Bring the gold tables of a published set up to date, as one new set; returns the names of those that were built.

    A table is built if it is new, if its version changed, or if a bucket that it reads was written anew, which a rebuilt
    input always is; the others are carried over. If any step fails nothing is published, and the error names its table.
    """
    built = []
    with log.begin("gold") as load:
        for spec in ordered(specs, set(load.base.entries) - {s.name for s in specs}):
            now = fingerprints(load, spec)
            if spec.name in load.base.entries and load.base.entry(spec.name).inputs == now:
                continue
            try:
                rows = spec.build({t: load.read(t) for t in spec.inputs})
                load.write(spec.name, rows, list(spec.keys), buckets, now)
            except Exception as e:
                raise ContractError(getattr(e, "code", "failed"), f"{spec.name}: {e}") from e
            built.append(spec.name)
    return built


def wide_spec(name: str, slices: dict[str, gold.Slice], obs: str = "aligned", meta: str = "series") -> Spec:
    """A wide table over slices of reviewed series."""
    ids = tuple(sorted({s.series_id for s in slices.values()}))
    text = repr(sorted((c, s.series_id, s.key, s.value, s.unit) for c, s in slices.items()))
    return Spec(name, (obs, meta), lambda t: gold.wide(t[obs], slices, t[meta], name), ("date",), {obs: ids, meta: ids}, sha256(text.encode()).hexdigest()[:12])


def shipped(wide: dict[str, dict[str, gold.Slice]] = WIDE_TABLES, metals: tuple[str, str] = METALS, quality: tuple[str, str] = QUALITY) -> list[Spec]:
    """The gold set: changes of all reviewed series, the wide tables, metal prices by day and month, credit quality by province, and the lineage of the wide tables."""

    def metals_daily(t):
        require_reviewed(t["series"], list(metals), "gold_precious_metal_ratios_daily")
        one = lambda i: t["facts"].where(F.col("series_id") == i).select("date", "value")
        return gold.ratio_daily(one(metals[0]), one(metals[1]), "gold_usd_ons_close", "silver_usd_ons_close")

    def credit_quality(t):
        require_reviewed(t["series"], list(quality), "gold_finturk_province_credit_quality")
        rows = reviewed_only(t["aligned"], t["series"])
        return gold.geo_quality(rows, {k: k for k in ("province", "geo_level", "plate_code")}, *quality)

    def evidence(t):
        spark = t["series"].sparkSession
        rows = [gold.lineage(spark, name, slices) for name, slices in wide.items()]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        known = t["series"].select(F.col("series_id").alias("source_series"), "source", "nature")
        return out.join(known, "source_series", "left").select("gold_table", "gold_column", "source_series", "source", "nature", "source_filter", "transformation", "unit")

    named = tuple(sorted({s.series_id for slices in wide.values() for s in slices.values()}))
    return [
        Spec("gold_periodic_change", ("aligned", "series"), lambda t: gold.periodic_change(t["aligned"], t["series"]), ("series_id",)),
        *[wide_spec(name, slices) for name, slices in wide.items()],
        Spec("gold_precious_metal_ratios_daily", ("facts", "series"), metals_daily, ("date",), {"facts": metals, "series": metals}),
        Spec("gold_precious_metal_ratios_monthly", ("gold_precious_metal_ratios_daily",), lambda t: gold.ratio_monthly(t["gold_precious_metal_ratios_daily"], ["gold_usd_ons_close", "silver_usd_ons_close"])),
        Spec("gold_finturk_province_credit_quality", ("aligned", "series"), credit_quality, ("date",), {"aligned": quality, "series": quality}),
        Spec("gold_evidence", (*wide, "series"), evidence, ("gold_table",), {"series": named}),
    ]
