"""Web pages as tables: title and visible text, links, images, and bulletin tables. A small parser runs per page in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as T
from ..functions import numbers as N

# Elements without visible text, file types that count as documents, and names that mark decoration.
HIDDEN = {"script", "style", "nav", "footer", "noscript", "template", "svg", "head"}
DOCUMENTS = (".pdf", ".xls", ".xlsx", ".csv", ".doc", ".docx", ".zip")
DECORATION = ("logo", "icon", "sprite", "avatar", "pixel")
#: Visible characters below which a page with scripts is taken for a shell that scripts fill.
SHELL_CHARS = 200

# A character reference that a semicolon ends, or an ampersand without one.
_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[0-9A-Za-z]+;)?")


def _ended(m: re.Match) -> str:
    """A reference that ends as it stands; of others the ampersand is text."""
    name = m[1]
    return m[0] if name and (name[0] == "#" or name in html5) else f"&amp;{name or ''}"


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden: list[str] = []
        self.in_title, self.title = False, ""
        self.text: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.images: list[tuple[str, str]] = []
        self.scripts = 0
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None
        self.anchor: list | None = None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in HIDDEN:
            self.hidden.append(tag)
        self.scripts += tag == "script"
        self.in_title |= tag == "title"
        if tag == "a" and a.get("href"):
            self.anchor = [a["href"], []]
        if tag == "img" and a.get("src"):
            self.images.append((a["src"], a.get("alt", "").strip()))
        if tag == "tr":
            self.rows.append([])
        if tag in ("td", "th"):
            self.cell = []

    def handle_endtag(self, tag):
        if tag in self.hidden:
            del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]
        if tag == "title":
            self.in_title = False
        if tag == "a" and self.anchor:
            self.links.append((self.anchor[0], " ".join("".join(self.anchor[1]).split())))
            self.anchor = None
        if tag in ("td", "th") and self.cell is not None:
            if self.rows:
                self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.hidden:
            self.text.append(data)
        if self.anchor:
            self.anchor[1].append(data)
        if self.cell is not None:
            self.cell.append(data)


def _parsed(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def _map(pages: DataFrame, fn, schema: str, ended_only: bool = False) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            read = ((page_id, url, _REFERENCE.sub(_ended, html or "") if ended_only else html) for page_id, url, html in batch.itertuples(index=False))
            yield pd.DataFrame([row for page_id, url, html in read for row in fn(page_id, url, _parsed(html))], columns=names)

    return pages.select("page_id", "url", "html").mapInPandas(run, schema)


def page_text(pages: DataFrame, ended_only: bool = False) -> DataFrame:
    """(page_id, url, title, text, is_shell): text is what is seen, white space as single spaces; is_shell: scripts and next to no text.

    Character references that no semicolon ends (``&amp</title>``, where a title was cut) are read as browsers read them or,
    with ``ended_only``, stay as they stand.
    """

    def rows(page_id, url, p):
        text = " ".join(" ".join(p.text).split())
        yield page_id, url, " ".join(p.title.split()), text, bool(p.scripts and len(text) < SHELL_CHARS)

    return _map(pages, rows, "page_id long, url string, title string, text string, is_shell boolean", ended_only)


def page_links(pages: DataFrame, documents_only: bool = False) -> DataFrame:
    """(page_id, position, target, label, is_document): a row for each link, its target resolved against the page's url."""

    def rows(page_id, url, p):
        for k, (href, label) in enumerate(p.links):
            try:
                target = urljoin(url or "", href)
            except ValueError:
                target = href
            yield page_id, k, target, label, target.lower().split("?")[0].endswith(DOCUMENTS)

    out = _map(pages, rows, "page_id long, position long, target string, label string, is_document boolean")
    return out.where("is_document") if documents_only else out


def page_images(pages: DataFrame) -> DataFrame:
    """(page_id, target, label) of labelled images that are not decoration."""

    def rows(page_id, url, p):
        for src, label in p.images:
            if label and not any(d in f"{src} {label}".lower() for d in DECORATION):
                yield page_id, urljoin(url or "", src), label

    return _map(pages, rows, "page_id long, target string, label string")


def bulletin_tables(pages: DataFrame, date: str | None = None) -> DataFrame:
    """(page_id, row_index, item, variable, value_raw, value, report_date, date_mismatch): cells of a page's table, the first row naming the columns.

    The date is the first written-out one on the page, wherever it stands; date_mismatch tells whether it differs from ``date``.
    """
    written_out = re.compile(r"\d{1,2}\s+[^\W\d_]+\s+\d{4}")

    def rows(page_id, url, p):
        table = [r for r in p.rows if r]
        said = (m.group() for m in written_out.finditer(" ".join(p.text)))
        day = next((x for x in said if x.split()[1].translate(T.TURKISH).lower() in T.MONTHS), None)
        for i, row in enumerate(table[1:]):
            for name, cell in list(zip(table[0], row))[1:]:
                yield page_id, i, row[0], name, cell, day

    cells = _map(pages, rows, "page_id long, row_index long, item string, variable string, value_raw string, page string")
    out = cells.withColumns({"report_date": T.parse_month_name_date(F.col("page")), "value": N.tr_number(F.col("value_raw"))}).drop("page")
    return out.withColumn("date_mismatch", ~F.col("report_date").eqNullSafe(F.lit(date).cast("date")) if date else F.lit(False))
