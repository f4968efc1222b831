"""What needs a real HTML parser: tables, title and text, and the official site a page links to.

Vectorised helpers over Arrow batches with the standard library's parser; the rest is columns.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SILENT = {"script", "style", "noscript"}
# JSON-LD types of a place or organisation, and words of links to an official site.
PLACE_TYPES = {"Place", "Organization", "PlaceOfWorship", "Mosque", "LocalBusiness", "CivicStructure", "NGO"}
LABELLED_HOSTS = ("islamicfinder.org", "islamicfinder.com")
LABELLED_LINK = re.compile(r"""website[:\s]*(?:<(?!a\s)[^>]*>\s*)*<a\s[^>]*href=["'](https?://[^"']+)""", re.IGNORECASE)
LINK_WORDS = ("official website", "official site", "visit website", "website", "homepage")


class _Tables(HTMLParser):
    """Cells of each outermost table; rows without text are left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.depth, self.silent, self.cell = [], 0, 0, None

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        elif tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth == 1 and tag == "tr":
            self._close()
            self.tables[-1].append([])
        elif self.depth == 1 and tag in ("td", "th"):
            self._close()
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.cell = []
        elif self.cell is not None and tag == "br":
            self.cell.append(" ")

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "table" and self.depth:
            if self.depth == 1:
                self._close()
            self.depth -= 1
        elif self.depth == 1 and tag in ("td", "th", "tr"):
            self._close()

    def handle_data(self, data):
        if self.cell is not None and not self.silent:
            self.cell.append(data)

    def _close(self):
        if self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None


def tables_of(html: str | None) -> list[list[list[str]]]:
    """
    >>> tables_of("<table><tr><th>Date</th><th>Fajr</th></tr><tr><td>1</td><td> 5:30<br>am</td></tr><tr></tr></table>")
    [[['Date', 'Fajr'], ['1', '5:30 am']]]
    """
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    return [[row for row in table if any(row)] for table in parser.tables]


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.text, self.links, self.data = [], [], [], []
        self.silent, self.in_title, self.link, self.ld = 0, False, None, None

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if tag == "script" and (found.get("type") or "").lower() == "application/ld+json":
            self.ld = []
        if tag in _SILENT:
            self.silent += 1
        self.in_title = self.in_title or tag == "title"
        if tag == "a":
            self.link = [found.get("href") or "", []]

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
            if tag == "script" and self.ld is not None:
                self.data.append("".join(self.ld))
                self.ld = None
        if tag == "title":
            self.in_title = False
        if tag == "a" and self.link:
            self.links.append((self.link[0], " ".join("".join(self.link[1]).split())))
            self.link = None

    def handle_data(self, data):
        if self.ld is not None:
            self.ld.append(data)
        elif self.in_title:
            self.title.append(data)
        elif not self.silent:
            self.text.append(data)
            if self.link:
                self.link[1].append(data)


def page_text(html: str | None) -> tuple[str, str]:
    """(title, text) of a page, white space squeezed.

    >>> page_text("<title>A  b</title><p>c<script>x</script> d&amp;e</p>")
    ('A b', 'c d&e')
    """
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return tuple(" ".join("".join(x).split()) for x in (parser.title, parser.text))


def official_site(url: str | None, html: str | None) -> str | None:
    """The official site that a directory page names: JSON-LD first, then a link with a telling text.

    The first way that finds anything decides; it must be http(s) and not the page's own host.
    """
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    found = None
    for text in parser.data:
        try:
            data = json.loads(text)
        except ValueError:
            continue
        for item in data if isinstance(data, list) else [data]:
            kinds = item.get("@type") if isinstance(item, dict) else None
            if set([kinds] if isinstance(kinds, str) else kinds or []) & PLACE_TYPES:
                entity = item.get("mainEntity")
                found = found or item.get("url") or (entity.get("url") if isinstance(entity, dict) else None)
    host = re.sub(r"^www\.", "", (urlsplit(url or "").hostname or "").lower())
    for href, text in parser.links:
        if found is None and href and any(w in text.lower() for w in LINK_WORDS):
            found = urljoin(url or "", href)
    if found is None and host in LABELLED_HOSTS:
        # these sites name the link beside it
        labelled = LABELLED_LINK.search(html or "")
        found = labelled and labelled.group(1)
    if not isinstance(found, str):
        return None
    parts, own = urlsplit(found), urlsplit(url or "")
    bare = lambda h: re.sub(r"^www\.", "", (h or "").lower())
    return found if parts.scheme in ("http", "https") and parts.hostname and bare(parts.hostname) != bare(own.hostname) else None


def unescaped(text: Column) -> Column:
    """text with its character references resolved; no-break spaces are spaces."""
    return F.pandas_udf(lambda s: s.map(lambda x: x and entities.unescape(x).replace("\u00a0", " ")), "string")(text)


#: Pages whose cells a task holds as Python objects at a time, however large its batches are.
PAGES = 256


def _tables_in_parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        for i in range(0, len(pages), PAGES):
            yield pages.iloc[i : i + PAGES].map(tables_of)


def parsed_tables(html: Column) -> Column:
    return F.pandas_udf(_tables_in_parts, "array<array<array<string>>>")(html)


def parsed_text(html: Column) -> Column:
    return F.pandas_udf(lambda s: pd.DataFrame([page_text(x) for x in s], columns=["title", "text"]), "title string, text string")(html)


def parsed_site(url: Column, html: Column) -> Column:
    return F.pandas_udf(lambda u, s: pd.Series([official_site(a, b) for a, b in zip(u, s, strict=True)], dtype=object), "string")(url, html)
