"""Dates, periods and calendars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_distance(later: Column, earlier: Column) -> Column:
    """Calendar months between two dates, by year and month alone."""
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def business_friday(d: Column) -> Column:
    """Friday of the week; Saturday and Sunday go back to it."""
    return F.date_add(d, 4 - F.weekday(d))


def quarter_end(d: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(d, "QUARTER"), 2))


def period_date(d: Column, freq: str) -> Column:
    """The date under which a period of ``freq`` stands: the day, its week's Friday, or the end of its month, quarter or year."""
    ends = {"D": d, "W": business_friday(d), "M": F.last_day(d), "Q": quarter_end(d), "Y": F.make_date(F.year(d), F.lit(12), F.lit(31))}
    return ends[freq]


def period_start(d: Column, freq: Column) -> Column:
    """First day of the period; unknown frequencies count as daily."""
    return (
        F.when(freq == "W", F.date_sub(d, F.weekday(d)))
        .when(freq == "M", F.trunc(d, "MM"))
        .when(freq == "Q", F.trunc(d, "QUARTER"))
        .when(freq == "Y", F.trunc(d, "YEAR"))
        .otherwise(d)
    )


def period_end(d: Column, freq: Column) -> Column:
    """Last day of the period; a week ends on the day that is reported."""
    return F.when(freq == "M", F.last_day(d)).when(freq == "Q", quarter_end(d)).when(freq == "Y", F.make_date(F.year(d), F.lit(12), F.lit(31))).otherwise(d)


def expected_periods(first: Column, last: Column, freq: Column) -> Column:
    """Periods from the one with ``first`` to the one with ``last``; null for no or unknown frequency or dates that run back."""
    f = F.upper(F.trim(freq))
    weeks = F.datediff(F.trunc(last, "WEEK"), F.trunc(first, "WEEK")) / 7 + 1
    quarters = (F.year(last) - F.year(first)) * 4 + F.quarter(last) - F.quarter(first) + 1
    n = (
        F.when(f == "D", F.datediff(last, first) + 1)
        .when(f == "W", weeks.cast("int"))
        .when(f == "M", month_distance(last, first) + 1)
        .when(f == "Q", quarters)
        .when(f.isin("Y", "A"), F.year(last) - F.year(first) + 1)
    )
    return F.when(last >= first, n).cast("long")


def parse_source_date(text: Column) -> Column:
    """``DD-MM-YYYY``, ``YYYY-M``, ``YYYY-Qn`` or ``YYYY``: the first day of the period; null for anything else."""
    t = F.upper(F.trim(text))
    part = lambda pattern, k: F.regexp_extract(t, pattern, k).try_cast("int")
    month, quarter, year = r"^(\d{4})-(\d{1,2})$", r"^(\d{4})-Q([1-4])$", r"^(\d{4})$"
    iso = lambda y, m: F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lit("01")).try_cast("date")
    return (
        F.when(t.rlike(r"^\d{2}-\d{2}-\d{4}$"), F.concat_ws("-", F.substring(t, 7, 4), F.substring(t, 4, 2), F.substring(t, 1, 2)).try_cast("date"))
        .when(t.rlike(month), iso(part(month, 1), part(month, 2)))
        .when(t.rlike(quarter), iso(part(quarter, 1), part(quarter, 2) * 3 - 2))
        .when(t.rlike(year), iso(part(year, 1), F.lit(1)))
    )


def parse_inline_date(text: Column) -> Column:
    """``YYYY-MM-DD``, ``YYYY-MM`` (its last day), ``DD.MM.YYYY`` or ``DD/MM/YYYY``, with or without a time; null for anything else."""
    t = F.split(F.split(F.trim(text), "T")[0], " ")[0]
    ym, ymd, dmy = r"^(\d{4})-(\d{1,2})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})([./])(\d{1,2})\2(\d{4})$"
    get = lambda pattern, k, n=2: F.lpad(F.regexp_extract(t, pattern, k), n, "0")
    return (
        F.when(t.rlike(ym), F.last_day(F.concat_ws("-", get(ym, 1, 4), get(ym, 2), F.lit("01")).try_cast("date")))
        .when(t.rlike(ymd), F.concat_ws("-", get(ymd, 1, 4), get(ymd, 2), get(ymd, 3)).try_cast("date"))
        .when(t.rlike(dmy), F.concat_ws("-", get(dmy, 4, 4), get(dmy, 3), get(dmy, 1)).try_cast("date"))
    )


# Month names as Turkish bulletins write them.
MONTHS = {"ocak": 1, "şubat": 2, "mart": 3, "nisan": 4, "mayıs": 5, "haziran": 6, "temmuz": 7, "ağustos": 8, "eylül": 9, "ekim": 10, "kasım": 11, "aralık": 12}
TURKISH = str.maketrans("İI", "iı")


def parse_month_name_date(text: Column) -> Column:
    """``8 Ocak 2021`` wherever it stands in ``text``; null without one."""
    pattern = r"(\d{1,2})\s+(\p{L}+)\s+(\d{4})"
    t = F.lower(F.translate(text, "İI", "iı"))
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    month = F.try_element_at(months, F.regexp_extract(t, pattern, 2))
    return F.concat_ws("-", F.regexp_extract(t, pattern, 3), F.lpad(F.coalesce(month.cast("string"), F.lit("x")), 2, "0"), F.lpad(F.regexp_extract(t, pattern, 1), 2, "0")).try_cast("date")


def month_ends(first: Column, last: Column) -> Column:
    """Array of the month ends from one date's month to the other's."""
    return F.transform(F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("interval 1 month")), F.last_day)
