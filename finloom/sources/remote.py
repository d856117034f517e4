"""Python data sources over REST services; the transport is a function, so they work (and are tested) offline."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from finloom.functions.html import html_text, html_title
from finloom.operators.transcripts import speakers


def http_get(url: str, timeout: float = 30.0, agent: str = "finloom research contact@example.org") -> str:
    """The body of a URL."""
    import urllib.request

    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:  # noqa: S310
        return r.read().decode("utf-8", "replace")


class Limited:
    """A transport that waits so that calls are at least ``pause`` seconds apart (within one task)."""

    def __init__(self, get: Callable[[str], str], pause: float):
        self.get, self.pause, self.last = get, pause, 0.0

    def __call__(self, url: str) -> str:
        wait = self.last + self.pause - time.monotonic()
        if wait > 0:
            time.sleep(wait)
        self.last = time.monotonic()
        return self.get(url)


def rest_source(name: str, schema: str, urls: Callable[[dict], list[str]], rows: Callable[[str, str], Iterator[tuple]], get: Callable[[str], str] = http_get, pause: float = 0.1, more: Callable[[dict, str], list[str]] | None = None) -> type[DataSource]:
    """A data source named ``name``: ``urls(options)`` lists its pages, each a partition when ``parallel`` is set, else
    all in one so that the rate limit holds; ``rows(url, body)`` gives a page's rows. ``more(options, body)`` may read
    from the first page which pages follow it."""

    class Page(InputPartition):
        def __init__(self, pages: list[str]):
            super().__init__(pages[0] if pages else None)
            self.pages = pages

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = options

        def partitions(self):
            pages = urls(self.options)
            return [Page([p]) for p in pages] if self.options.get("parallel") == "true" else [Page(pages)]

        def read(self, partition):
            limited = Limited(get, pause)
            todo, first = list(partition.pages), True
            while todo:
                url = todo.pop(0)
                body = limited(url)
                if first and more:
                    todo += more(self.options, body)
                first = False
                yield from rows(url, body)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader(dict(self.options))

    return Source


def _tickers(_: str, body: str) -> Iterator[tuple]:
    for row in json.loads(body).values():
        yield row["ticker"].upper(), str(row["cik_str"]).zfill(10), row["title"]


def ticker_source(get: Callable[[str], str] = http_get) -> type[DataSource]:
    """(ticker, cik, company_name) from the public list of filers; option ``url``."""
    return rest_source("filer_tickers", "ticker string, cik string, company_name string", lambda o: [o["url"]], _tickers, get)


def _filings(url: str, body: str) -> Iterator[tuple]:
    doc = json.loads(body)
    recent = doc.get("filings", {}).get("recent", {})
    cols = [recent.get(c, []) for c in ("accessionNumber", "filingDate", "reportDate", "form", "primaryDocument")]
    for values in zip(*cols, strict=False):
        yield (str(doc.get("cik", "")).zfill(10), doc.get("name"), *values)


def submissions_source(get: Callable[[str], str] = http_get) -> type[DataSource]:
    """Rows of the columnar submission lists of companies; options ``base`` and ``ciks`` (by comma)."""
    schema = "cik string, name string, accession_number string, filing_date string, report_date string, form_type string, primary_document string"
    return rest_source("filer_submissions", schema, lambda o: [f"{o['base']}/CIK{c.strip().zfill(10)}.json" for c in o["ciks"].split(",")], _filings, get)


def _transcripts(url: str, body: str) -> Iterator[tuple]:
    for item in json.loads(body).get("data", []):
        a = item.get("attributes", {})
        yield str(item.get("id")), a.get("title"), a.get("publishOn")


def transcript_source(get: Callable[[str], str] = http_get, pause: float = 5.0) -> type[DataSource]:
    """(id, title, published) of a paged list; options ``base`` (with ``{page}``) and ``pages``, without which the list
    is read to the ``totalPages`` that its first page tells."""

    def url(o: dict, p: int) -> str:
        return o["base"].replace("{page}", str(p))

    def more(o: dict, body: str) -> list[str]:
        return [] if "pages" in o else [url(o, p) for p in range(2, int(json.loads(body).get("meta", {}).get("page", {}).get("totalPages") or 1) + 1)]

    return rest_source("transcript_list", "id string, title string, published string", lambda o: [url(o, p) for p in range(1, int(o.get("pages", 1)) + 1)], _transcripts, get, pause, more)


def transcript_pages(pages: DataFrame, html: str = "html", most: int = 10) -> DataFrame:
    """``pages`` with ``title``, ``quarter``, ``fiscal_year``, ``text`` and at most ``most`` ``participants``; the
    participants are whoever has a label."""
    rows = pages.withColumns({"title": html_title(html), "text": html_text(html)})
    q = quarter_of_title("title")
    return rows.withColumns({"quarter": q["quarter"], "fiscal_year": q["year"], "participants": F.slice(speakers("text"), 1, most)}).drop(html)


def document_url(base: str, cik: str | Column, accession: str | Column, document: str | Column) -> Column:
    """Where a filing's document lies: the number without leading zeros and the accession number without dashes."""
    c, a, p = (F.col(x) if isinstance(x, str) else x for x in (cik, accession, document))
    return F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(c, "^0+", ""), F.lit("/"), F.replace(a, F.lit("-"), F.lit("")), F.lit("/"), p)


def quarter_of_title(title: str | Column) -> Column:
    """struct<quarter, year> of a title such as "Q4 2024 Earnings Call"."""
    t = F.col(title) if isinstance(title, str) else title
    return F.struct(F.nullif(F.regexp_extract(t, r"\bQ([1-4])\b", 1), F.lit("")).cast("int").alias("quarter"), F.nullif(F.regexp_extract(t, r"\b(20\d{2})\b", 1), F.lit("")).cast("int").alias("year"))


def latest_filings(filings: DataFrame, forms: list[str], n: int) -> DataFrame:
    """The newest n filings of the forms, for each company."""
    from finloom.operators.records import top_per_group

    return top_per_group(filings.filter(F.col("form_type").isin(forms)), ["cik"], [F.col("filing_date").desc(), F.col("accession_number")], n)
