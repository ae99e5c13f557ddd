"""Dims that a series' code tells: a prefix tree over the code's segments, and the words inside it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims as D

# Regions of the housing price index, with the level of each.
REGIONS = {
    "TR10": ("NUTS2", "İstanbul"),
    "TR51": ("NUTS2", "Ankara"),
    "TR31": ("NUTS2", "İzmir"),
    "TR41": ("NUTS2", "Bursa, Eskişehir, Bilecik"),
    "TR42": ("NUTS2", "Kocaeli, Sakarya, Düzce, Bolu, Yalova"),
    "TR61": ("NUTS2", "Antalya, Isparta, Burdur"),
    "TR62": ("NUTS2", "Adana, Mersin"),
    "TR21": ("NUTS2", "Edirne, Tekirdağ, Kırklareli"),
    "TR32": ("NUTS2", "Aydın, Denizli, Muğla"),
    "TR22": ("NUTS2", "Balıkesir, Çanakkale"),
    "TR33": ("NUTS2", "Manisa, Afyonkarahisar, Kütahya, Uşak"),
    "TR52": ("NUTS2", "Konya, Karaman"),
    "TR63": ("NUTS2", "Hatay, Kahramanmaraş, Osmaniye"),
    "TR7": ("NUTS1", "Orta Anadolu"),
    "TR8": ("NUTS1", "Batı Karadeniz"),
    "TR9": ("NUTS1", "Doğu Karadeniz"),
    "TRA": ("NUTS1", "Kuzeydoğu Anadolu"),
    "TRB": ("NUTS1", "Ortadoğu Anadolu"),
    "TRC": ("NUTS1", "Güneydoğu Anadolu"),
    "TR": ("NUTS0", "Türkiye Geneli"),
}
# What the ends of sales codes and the words of rent codes say of the place, and the kinds of sale by number.
SALES_PLACES = {"100": ("İstanbul", "34"), "510": ("Ankara", "06"), "310": ("İzmir", "35"), "611": ("Antalya", "07"), "411": ("Bursa", "16"), "421": ("Kocaeli", "41"), "621": ("Adana", "01"), "TOPLAM": ("Türkiye", "TR")}
RENT_PLACES = {"ISTANBUL": ("İstanbul", "34"), "ANKARA": ("Ankara", "06"), "IZMIR": ("İzmir", "35")}
SALES = "AKONUTSAT"
SALES_TYPES = {f"{SALES}1": "total", f"{SALES}2": "mortgaged", f"{SALES}3": "first_hand", f"{SALES}4": "second_hand"}
CURRENCIES = {"USD": "USD", "EUR": "EUR", "TRY": "TRY", "YTL": "TRY", "GBP": "GBP", "CHF": "CHF", "JPY": "JPY"}
METALS = {"GUMUS": "silver", "ALTIN": "gold", "GOLD": "gold"}

_INDEX = {"market": "housing", "indicator": "price_index"}
_RENT = {"market": "housing", "indicator": "rent"}
_METAL = {"commodity_group": "precious_metals", "commodity": "gold"}
#: The tree's nodes: a path that ends in a star says something of every code below it, another one of that code alone.
TREE = {f"TP.KFE.{code}": {**_INDEX, "geo_level": level, "region_code": code, "region_name": name} for code, (level, name) in REGIONS.items()}
TREE |= {"TP.BK.*": _RENT, "TP.YKKE.TR": _RENT, "TP.MK.*": _METAL}


class CodeTree:
    """A prefix tree over dotted codes. A code's dims are those of the nodes on its path, the deeper ones first."""

    def __init__(self, nodes: dict[str, dict[str, str]] = TREE):
        self.keys = sorted({k for dims in nodes.values() for k in dims})
        flat = [x for path, dims in nodes.items() for x in (F.lit(path), F.create_map(*[F.lit(y) for pair in dims.items() for y in pair]))]
        self.nodes = F.create_map(*flat)

    def path(self, code: Column) -> Column:
        """The tree's paths that ``code`` may stand on, the deepest first: itself, then each of its prefixes with a star."""
        parts = F.split(code, r"\.")
        above = F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "."), F.lit(".*")))
        return F.concat(F.array(code), F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>")))

    def met(self, code: Column) -> Column:
        """The dims of the nodes on a code's path."""
        return F.filter(F.transform(self.path(code), lambda p: F.try_element_at(self.nodes, p)), lambda m: m.isNotNull())

    def get(self, met: Column, key: str) -> Column:
        return F.get(F.filter(F.transform(met, lambda m: F.try_element_at(m, F.lit(key))), lambda v: v.isNotNull()), F.lit(0))


def _first(words: Column, values: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(F.array_contains(words, w), F.lit(v)) for w, v in values.items()])


def code_dims(code: Column, strict: bool = False) -> Column:
    """The dims that a code tells, as canonical JSON; null for a null code.

    The tree gives a region with its level, code and name, rents and metals; one scan for words gives kinds of sale,
    currencies and metals, and a sales code's end its place. ``strict`` raises for an unknown region of the price index and
    an unknown end of a sales code, which otherwise tell nothing of the place.
    """
    tree = CodeTree()
    met = tree.met(code)
    spell = sorted([f"{SALES}[1-4]?", *CURRENCIES, *METALS, *RENT_PLACES])
    words = F.regexp_extract_all(code, F.lit(f"(?=({'|'.join(spell)}))"), 1)  # words may overlap
    sale = F.exists(words, lambda w: w.startswith(SALES))
    rent = tree.get(met, "indicator") == "rent"
    end = F.when(code.endswith("TOPLAM"), "TOPLAM").otherwise(F.right(code, F.lit(3)))
    at = lambda places, k, key: F.try_element_at(F.create_map(*[F.lit(x) for name, values in places.items() for x in (name, values[k])]), key)
    rented = [F.when(rent, _first(words, {w: v[k] for w, v in RENT_PLACES.items()})) for k in (0, 1)]
    whole = F.when(rent & F.contains(code, F.lit("TR")), "Türkiye")
    metal = _first(words, METALS)
    dims = {k: tree.get(met, k) for k in tree.keys}
    dims |= {
        "market": F.when(sale, "housing").otherwise(dims["market"]),
        "indicator": F.when(rent, "rent").when(sale, "sales_volume").otherwise(dims["indicator"]),
        "sales_type": F.when(sale, _first(words, SALES_TYPES)),
        "province": F.coalesce(rented[0], whole, F.when(sale, at(SALES_PLACES, 0, end))),
        "plate_code": F.coalesce(rented[1], F.when(sale & whole.isNull(), at(SALES_PLACES, 1, end))),
        "currency": _first(words, CURRENCIES),
        "commodity_group": F.when(metal.isNotNull(), "precious_metals").otherwise(dims["commodity_group"]),
        "commodity": F.coalesce(metal, dims["commodity"]),
    }
    out = F.when(code.isNotNull(), D.build(**dims))
    if not strict:
        return out
    lost = (code.startswith("TP.KFE.") & dims["region_code"].isNull()) | (sale & at(SALES_PLACES, 0, end).isNull())
    return F.when(lost, F.raise_error(F.concat(F.lit("unknown place in code "), code)).cast("string")).otherwise(out)
