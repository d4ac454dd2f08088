"""Portal listings: items found in saved HTML pages, and pagination between pages."""

from __future__ import annotations

from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lekhya import fixed_values as fv
from lekhya.functions.dates import listing_date
from lekhya.functions.regex import java_pattern
from lekhya.functions.text import strip
from lekhya.operators.ingest import canonical_url, url_allowed
from lekhya.operators.pointers import reached
from lekhya.session import stage

LINKS = "array<struct<href:string,text:string>>"
ROWS = "array<struct<cells:array<string>,href:string,text:string>>"
PAGES_AT_ONCE = 256  # parsed pages are many times larger than their text


class _Listing(HTMLParser):
    """Table rows with their cells and first link, and all links of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.links: list[dict] = []
        self._cells: list[list[str]] | None = None
        self._in_cell = False
        self._link: dict | None = None
        self._row_link: dict | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self._close_row()
            self._cells = []
        elif tag == "td" and self._cells is not None:
            self._cells.append([])
            self._in_cell = True
        elif tag == "a":
            href = dict(attrs).get("href")
            if href is not None:
                self._link = {"href": href, "text": ""}
                self.links.append(self._link)
                if self._cells is not None and self._row_link is None:
                    self._row_link = self._link

    def handle_endtag(self, tag):
        if tag == "td":
            self._in_cell = False
        elif tag == "a":
            self._link = None
        elif tag in ("tr", "table"):
            self._close_row()

    def handle_data(self, data):
        # text pieces are trimmed one by one and joined without a space
        if self._link is not None:
            self._link["text"] += data.strip()
        if self._in_cell and self._cells:
            self._cells[-1].append(data.strip())

    def _close_row(self):
        if self._cells is not None:
            link = self._row_link or {"href": None, "text": ""}
            self.rows.append({"cells": ["".join(c) for c in self._cells], **link})
        self._cells, self._row_link, self._in_cell = None, None, False

    def close(self):
        super().close()
        self._close_row()


def parsed(html: str | None) -> tuple[list[dict], list[dict]]:
    """Rows and links of one page; a missing page has none."""
    parser = _Listing()
    parser.feed(html or "")
    parser.close()
    return parser.rows, parser.links


def parse_pages(pages: DataFrame, id_col: str, html: str = "html") -> DataFrame:
    """Add ``rows`` and ``links`` to each page; one narrow pass."""
    kept = [f for f in pages.schema.fields if f.name != html]
    names = [f.name for f in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), PAGES_AT_ONCE):
                part = pdf.iloc[at:at + PAGES_AT_ONCE]
                found = [parsed(body) for body in part[html]]
                yield part[names].assign(rows=[f[0] for f in found],
                                         links=[f[1] for f in found])

    return pages.mapInPandas(run, f"{schema}, rows {ROWS}, links {LINKS}")


@F.pandas_udf(T.StringType())
def resolve_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """The absolute address of a link on a page."""
    def join(b, h):
        try:
            return urljoin(b or "", h) if h is not None else None
        except ValueError:
            return None
    return pd.Series([join(b, h) for b, h in zip(base, href)])


@dataclass(frozen=True)
class Portal:
    """How one portal lists its documents."""
    domains: tuple[str, ...]
    prefixes: tuple[str, ...]
    doc_type: str
    department_id: str
    default_title: str
    endings: tuple[str, ...] = (".pdf",)
    cues: tuple[str, ...] = ("download",)
    number_in_rows: bool = True      # rows may carry an order number column
    filter_rows: bool = False        # row links must look like documents as well
    classification: str = "PUBLIC"
    extra: dict = field(default_factory=dict)


def _is_document(url: Column, portal: Portal) -> Column:
    hit = F.lit(False)
    for ending in portal.endings:
        hit = hit | F.endswith(url, F.lit(ending))
    for cue in portal.cues:
        hit = hit | F.contains(F.lower(url), F.lit(cue))
    return hit


def _is_generic(text: Column) -> Column:
    low = strip(F.lower(text))
    hit = low.isin(fv.GENERIC_LINK_TEXTS)
    for cue in fv.GENERIC_LINK_CUES:
        hit = hit | F.contains(low, F.lit(cue))
    return hit


def discover(pages: DataFrame, portal: Portal, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """Documents a portal's pages list.

    Table rows are read by their number of columns; a page without usable rows
    contributes its document links instead.
    """
    return listed_items(parse_pages(pages, id_col), portal, id_col, url)


def listed_items(pages: DataFrame, portal: Portal, id_col: str = "page_id",
                 url: str = "url") -> DataFrame:
    """As ``discover``, for pages that were parsed already (``rows`` and ``links``)."""
    rows = pages.select(id_col, F.col(url).alias("_base"),
                         F.posexplode("rows").alias("at", "row")).filter(
        (F.size("row.cells") >= 2) & F.col("row.href").isNotNull())
    cells, n = F.col("row.cells"), F.size("row.cells")
    first, second, third = [F.get(cells, F.lit(i)) for i in range(3)]
    if portal.number_in_rows:
        titled_third = (n >= 4) | ((n == 3) & ~_is_generic(third))
        title = F.when(titled_third, third).otherwise(first)
        number = F.when(titled_third, first)
    else:
        title, number = F.coalesce(F.nullif(first, F.lit("")), F.col("row.text")), F.lit(None)
    listed = F.regexp_extract(title, java_pattern(fv.LISTED_NUMBER, True), 1)
    number = F.coalesce(F.nullif(number.cast("string"), F.lit("")),
                        F.nullif(strip(listed), F.lit("")) if portal.number_in_rows
                        else F.lit(None))
    from_rows = rows.select(
        id_col, "_base", "at", F.col("row.href").alias("href"), title.alias("title"),
        number.alias("go_number"), listing_date(second).alias("displayed_date"),
        F.lit(True).alias("_row"))
    links = pages.select(id_col, F.col(url).alias("_base"), F.size("rows").alias("_rows"),
                          F.posexplode("links").alias("at", "link"))
    from_links = links.select(
        id_col, "_base", "at", F.col("link.href").alias("href"), F.col("link.text").alias("title"),
        F.lit(None).cast("string").alias("go_number"),
        F.lit(None).cast("date").alias("displayed_date"), F.lit(False).alias("_row"), "_rows")
    if portal.number_in_rows:
        from_links = from_links.filter("_rows = 0")
    everything = from_rows.unionByName(from_links.drop("_rows"))
    found = everything.withColumn("source_url", resolve_url(F.col("_base"), F.col("href")))
    document = _is_document(F.col("source_url"), portal)
    if not portal.filter_rows:
        document = document | F.col("_row")
    kept = found.filter(document & url_allowed(F.col("source_url"), list(portal.domains),
                                               list(portal.prefixes)))
    if portal.filter_rows:
        has_row = kept.groupBy(id_col).agg(F.bool_or("_row").alias("_any"))
        kept = kept.join(has_row, id_col).filter(F.col("_row") | ~F.col("_any"))
    return kept.select(
        id_col, "at", canonical_url(F.col("source_url")).alias("source_url"),
        F.coalesce(F.nullif("title", F.lit("")), F.lit(portal.default_title)).alias("title"),
        F.lit(portal.doc_type).alias("doc_type"),
        F.lit(portal.department_id).alias("department_id"), "displayed_date", "go_number",
        F.lit(portal.classification).alias("classification"), F.col("_base").alias("detail_url"))


def follow_pages(pages: DataFrame, start: DataFrame, domains: list[str],
                 prefixes: list[str]) -> DataFrame:
    """Addresses reached from ``start`` over next-page links among saved pages.

    Chains are followed by pointer doubling, cycles included.  Where an address was saved with
    several next links, the smallest is its pointer and the others begin chains of their own.
    """
    links = parse_pages(pages.select("url", "html"), "url")
    following = F.get(F.filter("links", lambda a: a["text"].rlike(
        java_pattern("Next|»|अगला", True))), F.lit(0))["href"]
    edges = stage(links.select("url", resolve_url(F.col("url"), following).alias("next"))
                  .filter("next IS NOT NULL")
                  .filter(url_allowed(F.col("next"), domains, prefixes)).distinct())
    pointers = stage(edges.groupBy("url").agg(F.min("next").alias("next")))
    others = stage(edges.join(pointers, ["url", "next"], "left_anti"))
    pointers = pointers.withColumnRenamed("url", "node")
    visited = reached(pointers, start.select(F.col("url").alias("node")))
    while True:
        more = stage(others.join(visited, F.col("url") == F.col("node"), "left_semi")
                     .select(F.col("next").alias("node")).distinct()
                     .join(visited, "node", "left_anti"))
        if more.isEmpty():
            return visited.withColumnRenamed("node", "url")
        visited = reached(pointers, visited.unionByName(more))
