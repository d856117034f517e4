"""HTML into text, headings, lists, tables and units, with the standard library's parser."""

from __future__ import annotations

import html as _html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose content is no text of the page, elements that end a line, and void elements.
DROPPED = frozenset("script style nav header footer noscript template ix:header ix:hidden".split())
BLOCKS = frozenset("p div section article main table tr ul ol li h1 h2 h3 h4 h5 h6 br hr blockquote pre title dd dt".split())
# Fixed value: parts of class names of page furniture.
DROPPED_CLASS = re.compile("header|footer|navigation|menu|nav", re.I)
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())


class Reader(HTMLParser):
    """One pass over a page: Markdown-like text, title, headings and tables."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        # Depth of the dropped element that the reader is in; what was left open inside it ends with it.
        self.dropped: int | None = None
        self.lists: list[list] = []
        self.cells: list[str] | None = None
        self.rows: list[list[str]] = []
        self.tables: list[list[list[str]]] = []
        self.depth = 0
        self.title: list[str] = []
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.open.append(tag)
        if self.dropped is not None:
            return
        given = {k: v or "" for k, v in attrs}
        if tag in DROPPED or given.get("style", "").replace(" ", "").startswith("display:none") or DROPPED_CLASS.search(given.get("class", "")):
            if tag not in VOID:
                self.dropped = len(self.open)
            return
        if tag == "title":
            self.in_title = True
        elif tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.rows = []
        elif tag == "tr" and self.depth == 1:
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append("")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li" and self.lists:
            self.lists[-1][1] += 1
            self._add("\n" + (f"{self.lists[-1][1]}. " if self.lists[-1][0] == "ol" else "• "))
        elif re.fullmatch("h[1-6]", tag):
            self._add("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "article", "blockquote"):
            self._add("\n\n")
        elif tag in BLOCKS:
            self._add("\n")

    def handle_endtag(self, tag):
        # An end tag closes what was left open since its start; one without a start closes nothing.
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        if self.dropped is not None:
            if len(self.open) < self.dropped:
                self.dropped = None
            return
        if tag == "title":
            self.in_title = False
        elif tag == "tr" and self.cells is not None and self.depth == 1:
            row = [re.sub(r"\s+", " ", c).strip() for c in self.cells]
            self.cells = None
            if any(row):
                self.rows.append(row)
        elif tag == "table" and self.depth:
            self.depth -= 1
            if not self.depth and self.rows:
                self.tables.append(self.rows)
                self.out.append("\n\n[TABLE]\n" + "\n".join(" | ".join(r) for r in self.rows) + "\n\n")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self._add("\n")
        elif tag in BLOCKS:
            self._add("\n\n" if tag in ("p", "div") or tag.startswith("h") else "\n")

    def handle_data(self, data):
        if self.dropped is None:
            if self.in_title:
                self.title.append(data)
            else:
                self._add(data if self.cells is not None else re.sub(r"[ \t\r\n]+", " ", data))

    def _add(self, s: str) -> None:
        if self.cells:
            self.cells[-1] += " " + s
        elif self.cells is None and not self.depth:
            self.out.append(s)


def read(page: str | None) -> Reader:
    r = Reader()
    if page:
        r.feed(page)
        r.close()
    return r


def to_text(page: str | None) -> str | None:
    """Markdown-like text of a page; null stays null, markup that is broken is read as far as it goes."""
    if page is None:
        return None
    text = "".join(read(page).out)
    text = re.sub(r"[ \t]+\n", "\n", re.sub(r"\n[ \t]+(?=\S)", "\n", text))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


@F.pandas_udf(T.StringType())
def html_text(pages: pd.Series) -> pd.Series:
    return pages.map(to_text, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.ArrayType(T.ArrayType(T.StringType()))))
def html_tables(pages: pd.Series) -> pd.Series:
    """Tables of a page as rows of cells; those of fewer than two rows or columns are left out."""
    return pages.map(lambda p: [t for t in read(p).tables if len(t) > 1 and max(map(len, t)) > 1] if p else [])


def html_clean(page: str | Column) -> Column:
    """The page without markup, by expressions alone (no parser): for regular pages."""
    col = F.col(page) if isinstance(page, str) else page
    for tag in ("script", "style", "nav", "header", "footer"):
        col = F.regexp_replace(col, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(col, "(?s)<[^>]*>", " "), "[ \t\r\n]+", " "))


def html_title(page: str | Column) -> Column:
    """The title element, else the first heading; null where there is neither."""
    col = F.col(page) if isinstance(page, str) else page
    pick = lambda tag: F.nullif(F.trim(F.regexp_extract(col, f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)), F.lit(""))
    return F.coalesce(pick("title"), pick("h1"))


def html_headings(page: str | Column) -> Column:
    """Headings as ``#`` marks and text, by expressions alone."""
    col = F.col(page) if isinstance(page, str) else page
    for n in range(1, 7):
        col = F.regexp_replace(col, f"(?is)<h{n}[^>]*>(.*?)</h{n}>", "\n" + "#" * n + " $1\n")
    return col


def main_text(pages: Column, least: int = 500) -> Column:
    """The first candidate region of more than ``least`` characters: article, main, a content block, the body."""
    pick = lambda p: F.regexp_extract(pages, p, 1)
    ways = [pick(f"(?is)<{t}[^>]*>(.*?)</{t}>") for t in ("article", "main", "body")]
    return F.coalesce(*[F.when(F.length(html_clean(w)) > least, html_clean(w)) for w in ways])


def unescape(text: str) -> str:
    return _html.unescape(text)
