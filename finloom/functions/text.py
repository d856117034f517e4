"""Text expressions that several operators share."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: Unicode's white space, no-break spaces included, for Java and Python patterns alike.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c))


def tokens(text: str | Column) -> Column:
    """Array of the pieces between white space; empty for null and blank text. White space is mapped to one character
    first, because splitting at a single character needs no regular expression."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.array_remove(F.split(F.translate(col, _BLANKS, " " * len(_BLANKS)), " "), ""), F.array().cast("array<string>"))


def token_count(text: str | Column) -> Column:
    """Number of the pieces between white space; 0 for null, empty and blank text."""
    return F.size(tokens(text))


#: Terms are runs of ASCII letters and digits in lower case.
TERM_SPLIT = "[^a-z0-9]+"


def terms(text: str | Column) -> Column:
    """Array of a text's terms, in order; empty for null."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.array_remove(F.split(F.lower(col), TERM_SPLIT), ""), F.array().cast("array<string>"))


#: Latin letters with marks and the letters without them, by decomposition.
MARKED = {c: d for c in map(chr, range(0xC0, 0x250)) if c.islower() and (d := unicodedata.normalize("NFD", c)[0]).isascii()}
#: Words are runs of letters and digits of any script, in lower case and without marks on Latin letters.
WORD_SPLIT = r"[^\p{L}\p{N}]+"


def words(text: str | Column) -> Column:
    """Array of a text's words in any script, in order; empty for null."""
    col = F.lower(F.col(text) if isinstance(text, str) else text)
    col = F.translate(col, "".join(MARKED), "".join(MARKED.values()))
    return F.coalesce(F.array_remove(F.split(col, WORD_SPLIT), ""), F.array().cast("array<string>"))


# Phrases that stand on lines of their own in filings and transcripts and say nothing.
BOILERPLATE = ["table of contents", "page \\d+( of \\d+)?", "all rights reserved", "this page intentionally left blank", "united states securities and exchange commission", "washington, d\\.?c\\.? \\d{5}", "forward[- ]looking statements?"]


def strip_boilerplate(text: str | Column) -> Column:
    """Each boilerplate phrase becomes a line feed."""
    col = F.col(text) if isinstance(text, str) else text
    for p in BOILERPLATE:
        col = F.regexp_replace(col, f"(?i){p}", "\n")
    return col


def clean_whitespace(text: str | Column) -> Column:
    """At most one blank line in a row, no white space at line ends, trimmed."""
    col = F.col(text) if isinstance(text, str) else text
    col = F.regexp_replace(F.regexp_replace(col, "\r\n?", "\n"), "[ \t]+(\n|$)", "$1")
    return F.regexp_replace(F.regexp_replace(col, "\n[ \t\n]*\n[ \t]*\n", "\n\n"), "^[ \t\n]+|[ \t\n]+$", "")


def sentences(text: str | Column) -> Column:
    """Sentences, cut at white space behind a full stop, exclamation or question mark; empty ones left out."""
    col = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(col, "(?<=[.!?])[ \t\n\r]+"), lambda s: F.length(F.trim(s)) > 0)


def paragraphs(text: str | Column) -> Column:
    """Trimmed non-empty paragraphs, cut at blank lines."""
    col = F.col(text) if isinstance(text, str) else text
    return F.filter(F.transform(F.split(col, "\n[ \t\r]*\n[ \t\r\n]*"), lambda p: F.regexp_replace(p, "^[ \t\r\n]+|[ \t\r\n]+$", "")), lambda p: p != "")


def snippet(text: str | Column, length: int) -> Column:
    """The text's beginning; an ellipsis where something was cut off."""
    col = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(col) > length, F.concat(F.substring(col, 1, length), F.lit("..."))).otherwise(col)


def noise_paragraph(text: str | Column) -> Column:
    """Whether a paragraph is a page's furniture."""
    col = F.col(text) if isinstance(text, str) else text
    return F.lower(col).rlike("cookie|privacy|navigation")


def first_present(*cols: str | Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols])


def file_name(path: str | Column) -> Column:
    col = F.col(path) if isinstance(path, str) else path
    return F.element_at(F.split(col, "/"), -1)


def fiscal_file(name: str | Column) -> Column:
    """struct<ticker, fiscal_year, quarter> of a name such as ``AAA_FY2024_Q3``; null where it is otherwise."""
    col = F.regexp_replace(F.col(name) if isinstance(name, str) else name, "\\.[A-Za-z]+$", "")
    p = "^([A-Z.]+)_FY(\\d{4})_Q([1-4])$"
    return F.when(col.rlike(p), F.struct(F.regexp_extract(col, p, 1).alias("ticker"), F.regexp_extract(col, p, 2).cast("int").alias("fiscal_year"), F.regexp_extract(col, p, 3).cast("int").alias("quarter")))


def period(year: str | Column, quarter: str | Column) -> Column:
    y, q = (F.col(c) if isinstance(c, str) else c for c in (year, quarter))
    return F.concat(y.cast("string"), F.lit("-"), F.coalesce(q, F.lit("FY")))
