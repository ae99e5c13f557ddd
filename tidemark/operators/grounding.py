"""Whether the numbers in answers are found in their evidence, for a whole table of conversations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How far a quoted number may lie from its source, as a share and absolutely.
RELATIVE, ABSOLUTE = 0.01, 0.01
#: Kinds of evidence in the order in which they are credited; others come after them, by name.
SOURCES = ("tool", "result", "document")


#: Characters that a run of numbers is made of.
RUN = "[0-9.,]+"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _letter(c: Column) -> Column:
    return c.rlike(r"^[\p{L}_]$")


def without_dates(text: Column) -> Column:
    """``text`` with a blank in place of each date: year and month, perhaps day, with hyphens; day, month and year with dots or slashes.

    The text is cut where digits begin and end, and the lengths of the digit runs and what stands between them tell a date.
    A letter, digit or underscore beside it makes it a part of a name.
    """

    def starts(pieces: Column, i: Column) -> Column:
        """How many pieces from i on have the form of a date that begins with its year: 0, 3 or 5; -5 for one that ends with it."""
        at = lambda k: F.coalesce(F.get(pieces, i + k), F.lit(""))
        digits = lambda k, *n: at(k).rlike("^[0-9]") & F.length(at(k)).isin(*n)
        apart = lambda k: ~_letter(F.left(at(k), F.lit(1)))
        free = F.when(i > 0, ~_letter(F.right(at(-1), F.lit(1)))).otherwise(True)
        month = digits(0, 4) & (at(1) == "-") & digits(2, 1, 2)
        day = month & (at(3) == "-") & digits(4, 1, 2) & apart(5)
        local = digits(0, 1, 2) & at(1).isin(".", "/") & digits(2, 1, 2) & at(3).isin(".", "/") & digits(4, 4) & apart(5)
        return F.when(free & day, 5).when(free & month & apart(3), 3).when(free & local, -5).otherwise(0)

    def settled(forms: Column) -> Column:
        """How many pieces from each on are a date: a year that ends one date begins no other, and what lies inside one doesn't either."""
        at = lambda i: F.coalesce(F.get(forms, i), F.lit(0))
        first = lambda i: F.when((at(i) > 0) & (at(i - 4) != -5), at(i)).otherwise(0)
        return F.transform(forms, lambda n, i: F.when(n != -5, first(i)).when(F.greatest(*[first(i - k) - k for k in range(1, 5)]) > 0, 0).otherwise(5))

    def blanked(pieces: Column, sizes: Column) -> Column:
        inside = lambda i: F.coalesce(*[F.when(F.get(sizes, i - k) > k, F.lit(k)) for k in range(5)])  # noqa: E731  how far into a date
        return F.array_join(F.transform(pieces, lambda p, i: F.coalesce(F.when(inside(i) > 0, "").when(inside(i) == 0, " "), p)), "")

    cut = F.split(text, "(?<=[0-9])(?![0-9])|(?<![0-9])(?=[0-9])")
    return _let(cut, lambda pieces: _let(F.transform(pieces, lambda _, i: starts(pieces, i)), lambda forms: _let(settled(forms), lambda sizes: blanked(pieces, sizes))))


def numbers_of(run: Column) -> Column:
    """The numbers of a run of digits and marks, in order.

    Groups of digits follow each other. One to three digits and then groups of three are one number with thousands; one more
    group after them, or after a first group that no thousands follow, is its fraction. Then, or at a doubled mark, a new number begins.
    """
    parts = F.transform(F.split(run, "(?=[.,])"), lambda x: F.struct(F.when(x.rlike("^[.,]"), F.left(x, F.lit(1))).otherwise("").alias("mark"), F.translate(x, ".,", "").alias("digits")))
    begin = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit("none").alias("phase"))

    def step(state: Column, part: Column) -> Column:
        digits, phase, now = part["digits"], state["phase"], state["now"]
        three = F.length(digits) == 3
        thousands = three & ((phase == "thousands") | ((phase == "whole") & (F.length(now) <= 3)))
        joins = (digits != "") & phase.isin("whole", "thousands")
        ended = F.when((now != "") & ~joins, F.array_append(state["done"], now)).otherwise(state["done"])
        return F.struct(
            ended.alias("done"),
            F.when(joins, F.concat(now, part["mark"], digits)).otherwise(digits).alias("now"),
            F.when(digits == "", "none").when(thousands, "thousands").when(joins, "ended").otherwise("whole").alias("phase"),
        )

    return F.aggregate(parts, begin, step, lambda s: F.when(s["now"] != "", F.array_append(s["done"], s["now"])).otherwise(s["done"]))


def without_rules(text: Column) -> Column:
    """``text`` without the lines that only rule a table: bars, colons, hyphens and blanks, with at least one of the marks."""
    lines = F.filter(F.split(text, "\n"), lambda line: (F.translate(line, "|:- \t\r", "") != "") | (F.trim(line) == ""))
    return F.array_join(lines, "\n")


def readings(raw: Column) -> Column:
    """The values that a number's text can stand for.

    With both marks, the last one parts the fraction. With one kind of mark that stands once, it may part the fraction, or
    thousands if three digits follow each and at most three stand before; with several of one kind only thousands fit.
    """
    bare = F.ltrim(F.trim(raw), F.lit("-"))
    marks = F.translate(bare, "0123456789", "")
    head = F.split(bare, "[.,]")
    in_threes = F.forall(F.slice(head, 2, F.greatest(F.size(head), F.lit(1))), lambda g: F.length(g) == 3) & F.length(head[0]).between(1, 3) & (F.size(head) > 1)
    digits = F.array_join(head, "")
    as_fraction = F.concat(F.array_join(F.slice(head, 1, F.greatest(F.size(head) - 1, F.lit(0))), ""), F.lit("."), F.element_at(head, -1))
    texts = (
        F.when(F.length(marks) == 0, F.array(bare))
        .when(F.contains(marks, F.lit(".")) & F.contains(marks, F.lit(",")), F.array(as_fraction))
        .when(F.length(marks) == 1, F.array(as_fraction, F.when(in_threes, digits)))
        .otherwise(F.array(F.when(in_threes, digits)))
    )
    return F.array_compact(F.transform(texts, lambda x: x.try_cast("double")))


def answer_numbers(text: Column) -> Column:
    """The numbers of an answer that are to be checked, each once, in order: no dates, table rules, parts of names, years or integers up to 12.

    A number with a letter or underscore beside it is part of a name; a hyphen after a digit is no minus sign.
    """
    t = without_dates(without_rules(F.coalesce(text, F.lit(""))))

    def told(runs: Column, between: Column, run: Column, i: Column) -> Column:
        before, after = F.get(between, i), F.left(F.get(between, i + 1), F.lit(1))
        signed = before.endswith("-")
        last = F.right(F.when(signed, F.left(before, F.length(before) - 1)).otherwise(before), F.lit(1))
        digit_before = signed & (last == "") & (i > 0) & F.coalesce(F.get(runs, i - 1), F.lit("")).rlike("[0-9]$")
        opens, closes = run.rlike("^[0-9]"), run.rlike("[0-9]$")
        named = lambda found: F.transform(found, lambda n, k: F.when((k == 0) & opens & _letter(last), F.lit(None)).when((k == F.size(found) - 1) & closes & _letter(after), F.lit(None)).otherwise(F.when((k == 0) & opens & signed & ~digit_before, F.concat(F.lit("-"), n)).otherwise(n)))
        return F.array_compact(_let(numbers_of(run), named))

    skipped = lambda x: x.rlike(r"^-?0*(\d|1[0-2])$") | x.rlike(r"^-?(19\d\d|20\d\d|2100)$")
    found = _let(t, lambda t: _let(F.regexp_extract_all(t, F.lit(f"({RUN})"), 1), lambda runs: _let(F.split(t, RUN), lambda between: F.flatten(F.transform(runs, lambda run, i: told(runs, between, run, i))))))
    return F.array_distinct(F.filter(found, lambda x: ~skipped(x)))


def evidence_numbers(text: Column) -> Column:
    """All values that the numbers of an evidence text can stand for."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({RUN})"), 1)
    return F.array_distinct(F.flatten(F.transform(F.flatten(F.transform(runs, numbers_of)), readings)))


def near(value: Column, candidate: Column) -> Column:
    return F.abs(value - candidate) <= F.greatest(F.lit(ABSOLUTE), RELATIVE * F.abs(candidate))


def audit(answers: DataFrame, evidence: DataFrame, key: str, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """(key, checked, grounded, ungrounded, ratio, by_source): the numbers of each answer (key, text) against its evidence (key, source, text).

    A number is grounded if a reading of it lies within tolerance of a reading in the evidence; it counts for the first
    of ``sources`` that holds it, else for the first other one by name. Answers without numbers have ratio 1; those without a key meet the
    evidence without one. Numbers meet their evidence by key and by the power of two that they lie in, or next to, so no answer's numbers meet all of its evidence's.
    """
    asked = answers.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list(answer_numbers(F.col("text"))))).alias("raws"))
    each = asked.select(key, F.explode("raws").alias("raw")).select(key, "raw", F.explode(readings(F.col("raw"))).alias("v"))
    band = lambda x: F.floor(F.log2(F.greatest(F.abs(x), F.lit(0.01)))).cast("int")
    each = each.select(key, "raw", "v", F.explode(F.sequence(band(F.col("v")) - 1, band(F.col("v")) + 1)).alias("band"))
    pool = evidence.select(F.col(key).alias("_key"), "source", F.explode(evidence_numbers(F.col("text"))).alias("c")).distinct()
    pool = pool.withColumn("_band", band(F.col("c")))
    met = each.join(pool, F.col(key).eqNullSafe(F.col("_key")) & (F.col("band") == F.col("_band")) & near(F.col("v"), F.col("c")))
    place = F.array_position(F.array(*[F.lit(x) for x in sources]), F.col("source"))
    rank = F.struct(F.when(place > 0, place).otherwise(len(sources) + 1).alias("place"), "source")
    found = met.groupBy(key, "raw").agg(F.min(rank)["source"].alias("source"))
    sums = found.groupBy(F.col(key).alias("_found")).agg(F.collect_set("raw").alias("good"))
    split = found.groupBy(F.col(key).alias("_split"), "source").agg(F.count("*").alias("n"))
    split = split.groupBy("_split").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("by_source"))
    out = asked.join(sums, F.col(key).eqNullSafe(F.col("_found")), "left").join(split, F.col(key).eqNullSafe(F.col("_split")), "left")
    good = F.coalesce("good", F.array().cast("array<string>"))
    return out.select(
        key, F.size("raws").alias("checked"), F.size(good).alias("grounded"), F.array_sort(F.array_except("raws", good)).alias("ungrounded"),
        F.when(F.size("raws") == 0, 1.0).otherwise(F.size(good) / F.size("raws")).alias("ratio"), "by_source",
    )
