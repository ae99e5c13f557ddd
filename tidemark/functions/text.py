"""Text helpers as column expressions: slugs, identifiers, tokens, cleaning and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TURKISH, _LATIN = "çÇğĞıIİöÖşŞüÜ", "ccggiiioossuu"

# Phrases that try to redirect a model, its control tokens, and the tags that wrap foreign text.
INJECTION_PHRASES = [
    "ignore previous instructions",
    "ignore all previous",
    "önceki talimatları yok say",
    "sistem promptunu",
    "you are now",
    "disregard the above",
    "new instructions:",
]
CONTROL_TOKENS = ["<|im_start|>", "<|im_end|>", "[INST]", "[/INST]", "<system>", "</system>", "<|system|>"]
STRUCTURAL_TAGS = ["candidate_user_query", "untrusted_external_web_content", "attached_document"]
MAX_INPUT = 2000


def slug(text: Column, empty: str = "") -> Column:
    """snake_case of the Latin form of ``text``; ``empty`` where nothing is left. Letters are translated before they are lowered."""
    t = F.lower(F.translate(F.trim(text), _TURKISH, _LATIN))
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(t, "[^a-z0-9]+", "_"), F.lit("_")), F.lit("")), F.lit(empty))


def lower_first_slug(text: Column) -> Column:
    """As ``slug``, but lowered first as Unicode does it, combining dots dropped: a dotless capital I becomes i."""
    t = F.replace(F.lower(F.replace(F.trim(text), F.lit("İ"), F.lit("i"))), F.lit("̇"), F.lit(""))
    return F.btrim(F.regexp_replace(F.translate(t, "çğıöşü", "cgiosu"), "[^a-z0-9]+", "_"), F.lit("_"))


def identifier(text: Column) -> Column:
    """An identifier's form for comparison: Latin letters, lower case, outer white space off."""
    return F.lower(F.translate(F.trim(text), _TURKISH, _LATIN))


def frequency(text: Column) -> Column:
    """D, W, M, Q or Y from a source's description; the first rule that fits wins, and D is the default."""
    t = F.translate(F.upper(F.translate(F.trim(text), "ı", "I")), "İ", "I")
    has = lambda words: t.rlike("|".join(words))
    return F.coalesce(
        F.when(has(["3 AYLIK", "ÇEYREKLIK", "CEYREKLIK"]), "Q").when(has(["HAFTALIK"]), "W").when(has(["GÜNLÜK", "GUNLUK"]), "D").when(has(["AYLIK"]), "M").when(has(["YILLIK"]), "Y"), F.lit("D")
    )


def unit_from_header(text: Column) -> Column:
    """The unit in a header's parentheses; null if they name none that is known."""
    t = F.lower(F.translate(F.array_join(F.regexp_extract_all(text, F.lit(r"\(([^)]*)\)"), 1), " "), "İI", "iı"))
    return (
        F.when(F.contains(t, F.lit("milyon tl")), "milyon_tl")
        .when(F.contains(t, F.lit("bin tl")), "bin_tl")
        .when(F.contains(t, F.lit("%")) | F.contains(t, F.lit("yüzde")), "yuzde")
        .when(F.contains(t, F.lit("adet")), "adet")
        .when(t.rlike(r"\btl\b"), "tl")
    )


def tokens(text: Column) -> Column:
    """Lower-case words of more than one character, each once."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda w: F.length(w) > 1))


def collapse(text: Column) -> Column:
    """White space runs as one space, outer ones off."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_input(text: Column, most: int | None = MAX_INPUT) -> Column:
    """The first ``most`` characters (all if None, as for tables of whole texts), rid of control tokens and of the tags that mark foreign text."""
    out = text if most is None else F.substring(text, 1, most)
    out = F.regexp_replace(out, "(?i)" + "|".join("\\Q" + t + "\\E" for t in CONTROL_TOKENS), "")
    return F.trim(without_tags(out, STRUCTURAL_TAGS))


def without_tags(text: Column, names: list[str]) -> Column:
    """``text`` without tags of these names, opening or closing, with blanks or attributes, in any case.

    What stands between a ``<`` and the next ``>`` is a tag; its first word, slashes aside, is its name.
    """

    def rest(part: Column) -> Column:
        end = F.locate(">", part)
        name = F.get(F.split(F.trim(F.regexp_replace(F.translate(F.left(part, end - 1), "/", " "), r"\s+", " ")), " "), F.lit(0))
        tag = (end > 0) & F.lower(name).isin(*[n.lower() for n in names])
        return F.when(tag, F.substr(part, end + 1)).otherwise(F.concat(F.lit("<"), part))

    parts = F.split(text, "<")
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), rest), ""))


def injection_phrases(text: Column) -> Column:
    """Array of the known injection phrases that ``text`` holds, in list order."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.lit(p) for p in INJECTION_PHRASES]), lambda p: F.contains(t, p))


def series_id(source: str, *parts: Column) -> Column:
    """``SOURCE:part:part`` without null parts."""
    return F.concat_ws(":", F.lit(source), *parts)


def join_distinct(*parts: Column) -> Column:
    """Parts joined by `` | ``, empty and null ones left out."""
    return F.concat_ws(" | ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])
