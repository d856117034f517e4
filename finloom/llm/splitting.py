"""Oversized texts cut at natural boundaries, with an overlap.

Every gap between two tokens has a strength: the end of a paragraph, of a line after a sentence, of a sentence, of a
clause, of a line, or none. A sparse table over the strengths answers in constant time which gap in a window is the
strongest, the rightmost of equals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finloom.functions.text import WHITE
from finloom.plans.runtime import spread

LIMIT, OVERLAP = 800, 120
#: A cut is sought first in the window's last part, from this share of the limit on.
LEAST_FILL = 0.5
_TOKEN = re.compile(f"[^{WHITE}]+")
_SENTENCE = re.compile(r"[.!?。！？…][\"'”’)\]]*$")
_CLAUSE = re.compile(r"[,;:、，；：–—][\"'”’)\]]*$")


class RangeMax:
    """Sparse table for the position of the rightmost maximum of a range."""

    def __init__(self, strength: np.ndarray):
        n = len(strength)
        # Strength and position in one number: the maximum is the rightmost of the strongest.
        self.rows = [strength.astype(np.int64) * (n + 1) + np.arange(n)]
        self.n = n + 1
        width = 1
        while 2 * width <= n:
            last = self.rows[-1]
            self.rows.append(np.maximum(last[: len(last) - width], last[width:]))
            width *= 2

    def query(self, lo: int, hi: int) -> tuple[int, int]:
        """(strength, position) over lo..hi inclusive."""
        k = (hi - lo + 1).bit_length() - 1
        v = int(max(self.rows[k][lo], self.rows[k][hi - (1 << k) + 1]))
        return v // self.n, v % self.n


def strengths(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """For each token, how natural it is to cut behind it."""
    out = np.zeros(len(spans), np.int64)
    for i in range(len(spans) - 1):
        word, gap = text[spans[i][0] : spans[i][1]], text[spans[i][1] : spans[i + 1][0]]
        breaks = gap.count("\n") or gap.count("\r")
        ends = _SENTENCE.search(word) is not None
        out[i] = 5 if breaks > 1 else 4 if breaks and ends else 3 if ends else 2 if _CLAUSE.search(word) else 1 if breaks else 0
    return out


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least_fill: float = LEAST_FILL) -> list[tuple[int, int, str]]:
    """(start_token, end_token, piece) of a text; one piece where it is within the limit, none where it has no token."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    n = len(spans)
    if n <= limit:
        return [(0, n, text)] if n else []
    table = RangeMax(strengths(text, spans))
    out, start = [], 0
    while True:
        if start + limit >= n:
            end = n
        else:
            # Ends that are allowed: far enough on for the next piece to begin later, at most the limit.
            last = start + limit - 1
            strong, at = table.query(min(last, max(start + int(limit * least_fill), start + overlap)), last)
            if not strong:
                strong, at = table.query(min(last, start + overlap), last)
            end = at + 1 if strong else start + limit
        out.append((start, end, text[spans[start][0] : spans[end - 1][1]]))
        if end == n:
            return out
        start = end - overlap


def split_oversized(table: DataFrame, row: str = "chunk_key", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the rows whose ``text`` has more than ``limit`` tokens: ``row``, ``piece_no``, ``start_token``,
    ``end_token``, ``overlap_with_prev``, ``n_tokens``, ``text``.

    Every piece has at most ``limit`` tokens, ends behind a natural boundary wherever its window has one, and, but for
    the first, starts ``overlap`` tokens before the end of the one before it. Null, empty and short texts give no row;
    repeated rows each give their pieces; other columns are ignored. A token longer than any limit is never cut. Only
    texts long enough to hold so many tokens reach Python, in one pass without a shuffle.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be shorter than the limit")
    kind = f"{row} {table.schema[row].dataType.simpleString()}, piece_no int, start_token int, end_token int, overlap_with_prev int, n_tokens int, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, t in zip(b["_row"], b["_text"], strict=True):
                pieces = cut(t, limit, overlap)
                if len(pieces) > 1:
                    out += [(key, k + 1, s, e, overlap if k else 0, e - s, x) for k, (s, e, x) in enumerate(pieces)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in kind.split(", ")])

    long = spread(table.select(F.col(row).alias("_row"), F.col(text).alias("_text"))).filter(F.length("_text") > 2 * limit)
    return long.mapInPandas(run, kind)
