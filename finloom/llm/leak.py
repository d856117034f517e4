"""Evaluation passages inside a training corpus, found by winnowing.

Both sides are turned into words (white-space pieces, folded by NFKC and case, stripped to letters and digits). Of every
``window`` consecutive ``gram``-word shingles the one with the least hash is a fingerprint, so any common run of
``gram + window - 1`` words shares a fingerprint, wherever it stands. Fingerprints that meet are joined with the item's
positions and extended to both sides by a banded alignment, which finds the most words in order for each number of words
changed, added or dropped; a document is reported for an item if ``min_words`` words stand in order with at most
``differences`` words of difference between them.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finloom.plans.runtime import spread

GRAM, WINDOW, MIN_WORDS = 4, 3, 15
#: Words changed, added or dropped that may stand among ``min_words`` words in order.
DIFFERENCES = 2
#: Held-out items whose fingerprints one pass broadcasts (some 5 KB an item in a worker while they are built); more items are searched in
#: further passes.
ITEMS_PER_BLOCK = 100_000
#: Distinct raw words that one worker remembers before it forgets them all.
MEMO = 500_000

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25], dtype=np.uint64)


# Greek and Cyrillic letters that look like Latin ones, in lower case.
LOOKALIKES = str.maketrans("\u0430\u0435\u043e\u0440\u0441\u0443\u0445\u0456\u0458\u0455\u0501\u04bb\u043a\u043c\u0442\u0432\u043d\u03bf\u03b1\u03b5\u03b9\u03bd\u03c1\u03c5\u03c7\u03ba\u03c4\u03b7", "aeopcyxijsdhkmtbhoaeivpuxktn")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|<\|[^<>|]{1,40}\|>")
_BROKEN = re.compile(r"[-\u2010\u2011\u00ad][ \t]*\r?\n[ \t]*")
_ODD = re.compile(r"[<&\u00ad\u200b-\u200f\u2060\ufeff]|[-\u2010\u2011][ \t]*\r?\n")


def plain(text: str) -> str:
    """The text without markup, entities, soft hyphens and hyphens at line ends."""
    if not _ODD.search(text):
        return text
    if "<" in text:
        text = _TAG.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    return re.sub("[\u00ad\u200b-\u200f\u2060\ufeff]", "", _BROKEN.sub("", text))


def fold(word: str) -> str:
    """Letters and digits of a word in one typography: compatibility forms, case, marks and look-alikes folded."""
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    w = "".join(c for c in word.casefold() if c.isalnum())
    return w if w.isascii() else w.translate(LOOKALIKES)


class Words(dict):
    """Maps a raw word to its number: 0 for no word, 1 for a word that no item has."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, raw: str) -> int:
        if len(self) > MEMO:
            self.clear()
        w = fold(raw)
        n = self[raw] = self.numbers.get(w, 1) if w else 0
        return n


def shingle_hashes(ids: np.ndarray, gram: int) -> np.ndarray:
    n = len(ids) - gram + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    x = ids.astype(np.uint64)
    for j in range(gram):
        h += (x[j : j + n] + np.uint64(1)) * _MULT[j % 8] * np.uint64(2 * j + 1)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the rightmost least hash of each window; all of them where fewer than a window exist."""
    n = len(h)
    if n <= window:
        return np.arange(n) if n < window else np.array([n - 1 - int(np.argmin(h[::-1]))])
    best, at = h[: n - window + 1].copy(), np.arange(n - window + 1)
    for j in range(1, window):
        x = h[j : n - window + 1 + j]
        less = x <= best
        best[less] = x[less]
        at[less] = np.flatnonzero(less) + j
    chosen = np.zeros(n, bool)
    chosen[at] = True
    return np.flatnonzero(chosen)


class Prints:
    """The winnowed fingerprints of one block of items; ``flat`` holds the items' words with gaps of ``reach`` between."""

    def __init__(self, items: list[tuple], gram: int, window: int, min_words: int = MIN_WORDS, differences: int = DIFFERENCES):
        numbers: dict[str, int] = {}
        self.item: list = []
        self.reach = min_words + differences
        gap = np.zeros(self.reach, np.int32)
        hashes, owner, place, flat, at = [], [], [], [gap], self.reach
        for item_id, *texts in items:
            for t in texts:
                ids = [numbers.setdefault(w, len(numbers) + 2) for w in map(fold, plain(t or "").split()) if w]
                if not ids:
                    continue
                a = np.array(ids, np.int32)
                h = shingle_hashes(a, gram)
                p = winnow(h, window)
                hashes.append(h[p])
                owner.append(np.full(len(p), len(self.item), np.int32))
                place.append((p + at).astype(np.int32))
                flat += (a, gap)
                at += len(a) + self.reach
                self.item.append(item_id)
        self.words = Words(numbers)
        self.flat = np.concatenate(flat)
        cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        h = cat(hashes, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash, self.owner, self.place = h[order], cat(owner, np.int32)[order], cat(place, np.int32)[order]


_PRINTS: dict = {}


def prints_of(key: str, items: list[tuple], *parameters: int) -> Prints:
    """One table of fingerprints per Python worker and block."""
    if key not in _PRINTS:
        _PRINTS.clear()
        _PRINTS[key] = Prints(items, *parameters)
    return _PRINTS[key]


def aligned(doc: np.ndarray, item: np.ndarray, most: int) -> np.ndarray:
    """Most words in order from the left edges on, for each row and each number of differences up to ``most``.

    doc is wider than item by ``most``. A difference is a word changed, added or dropped; the alignment may end anywhere.
    best[e][d] is the most words kept by e differences where the document is d words ahead of the item."""
    n, width = item.shape
    none = np.full(n, -100, np.int16)
    best = [{0: np.zeros(n, np.int16)}] + [{} for _ in range(most)]
    out = np.zeros((most + 1, n), np.int16)
    for i in range(width + 1):
        for e in range(most):
            for d, b in best[e].items():
                if d < most:
                    best[e + 1][d + 1] = np.maximum(best[e + 1].get(d + 1, none), b)
        for e in range(most + 1):
            for b in best[e].values():
                np.maximum(out[e], b, out=out[e])
        if i == width:
            break
        after: list[dict[int, np.ndarray]] = [{} for _ in range(most + 1)]
        equal = {d: doc[:, i + d] == item[:, i] for d in range(-most, most + 1) if 0 <= i + d}
        for e in range(most + 1):
            for d, b in best[e].items():
                if d in equal:
                    after[e][d] = np.maximum(after[e].get(d, none), np.where(equal[d], b + 1, -100))
                if e < most:
                    after[e + 1][d] = np.maximum(after[e + 1].get(d, none), b)
                    if d > -most:
                        after[e + 1][d - 1] = np.maximum(after[e + 1].get(d - 1, none), b)
        best = after
    return out


def search(texts: list[str | None], prints: Prints, gram: int, window: int, min_words: int, differences: int = DIFFERENCES) -> set[tuple[int, int]]:
    """Pairs (row of texts, number of the item's text)."""
    get, reach = prints.words.__getitem__, prints.reach
    parts, starts, at = [], [], 0
    gap = np.ones(reach, np.int32)
    for t in texts:
        a = np.fromiter(map(get, plain(t).split()), np.int32) if t else np.empty(0, np.int32)
        starts.append(at)
        parts += (a[a > 0], gap)
        at += len(parts[-2]) + reach
    if not parts or not len(prints.hash):
        return set()
    ids = np.concatenate(parts)
    h = shingle_hashes(ids, gram)
    p = winnow(h, window)
    # A shingle with an unknown word meets nothing; drop those before the lookup.
    known = np.ones(len(h), bool)
    for j in range(gram):
        known &= ids[j : j + len(h)] > 1
    p = p[known[p]]
    lo = np.searchsorted(prints.hash, h[p], "left")
    n = np.searchsorted(prints.hash, h[p], "right") - lo
    p, lo, n = p[n > 0], lo[n > 0], n[n > 0]
    out: set[tuple[int, int]] = set()
    side = min_words - gram + differences
    wide = np.concatenate([np.ones(reach, np.int32), ids, np.ones(reach + gram, np.int32)])
    left, right = np.arange(-1, -1 - side, -1), np.arange(gram, gram + side)
    near_left, near_right = np.arange(-1, -1 - side - differences, -1), np.arange(gram, gram + side + differences)
    # Meetings are worked on in slices, so that a phrase of very many items costs time but no memory.
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(n) else 0
    for b in range(0, total, 100_000):
        k = np.arange(b, min(total, b + 100_000))
        s = np.searchsorted(ends, k, "right")
        which = lo[s] + k - (ends[s] - n[s])
        d, y = p[s], prints.place[which]
        # Most meetings are chance phrases: how many of the item's words stand near their place bounds what an alignment
        # can keep.
        x = np.clip(d[:, None] + reach + np.concatenate([near_left, near_right]), 0, len(wide) - 1)
        doc, item = wide[x], prints.flat[y[:, None] + np.concatenate([left, right])]
        m = side + differences
        here = np.zeros(item.shape, bool)
        for c in range(-differences, differences + 1):
            f = max(0, -c)
            here[:, f:side] |= doc[:, f + c : side + c] == item[:, f:side]
            here[:, side + f :] |= doc[:, m + f + c : m + side + c] == item[:, side + f :]
        keep = np.flatnonzero(np.count_nonzero(here, axis=1) >= min_words - gram)
        if not len(keep):
            continue
        doc, item = doc[keep], item[keep]
        a, z = aligned(doc[:, :m], item[:, :side], differences), aligned(doc[:, m:], item[:, side:], differences)
        most = np.max([a[e] + z[differences - e] for e in range(differences + 1)], axis=0)
        good = keep[most >= min_words - gram]
        out.update(zip((np.searchsorted(starts, d[good], "right") - 1).tolist(), prints.owner[which[good]].tolist(), strict=True))
    return out


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", fields: tuple[str, ...] = ("passage", "question"), gram: int = GRAM, window: int = WINDOW, min_words: int = MIN_WORDS, items_per_block: int = ITEMS_PER_BLOCK, differences: int = DIFFERENCES) -> DataFrame:
    """Distinct (doc_id, item_id): the document holds at least ``min_words`` words of one of the item's texts in order,
    with at most ``differences`` words changed, added or dropped between them.

    Null, empty and blank texts on either side match nothing, nor do items of fewer than ``min_words`` words. Repeated
    rows of an id give one pair; ties cannot occur; further columns are ignored. Every document is read whole, once per
    block of ``items_per_block`` items, which are broadcast (that is their bound) and joined by a sorted lookup in the
    worker; nothing is shuffled but the pairs found. A common run of ``gram + window - 1`` words is always seen.
    """
    spark = documents.sparkSession
    rows = items.select(item_id, *fields).filter(F.coalesce(*[F.col(f) for f in fields]).isNotNull()).distinct()
    n = rows.count()
    out_type = T.StructType([T.StructField(doc_id, documents.schema[doc_id].dataType), T.StructField(item_id, items.schema[item_id].dataType)])
    src = spread(documents.select(documents[doc_id].alias("_id"), documents[text].alias("_text")).filter(F.length("_text") > 0))
    blocks, name = max(1, -(-n // items_per_block)), uuid.uuid4().hex
    found = None
    for b in range(blocks):
        mine = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64(item_id), F.lit(blocks)) == b)
        sent = spark.sparkContext.broadcast([tuple(r) for r in mine.collect()])

        def run(batches: Iterator[pa.RecordBatch], sent=sent, b=b) -> Iterator[pa.RecordBatch]:
            prints = prints_of(f"{name}-{b}", sent.value, gram, window, min_words, differences)
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1).to_pylist()
                pairs = sorted({(k, prints.item[o]) for k, o in search(texts, prints, gram, window, min_words, differences)})
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([k for k, _ in pairs], pa.int64())), pa.array([i for _, i in pairs], _arrow(out_type[1].dataType))], names=[doc_id, item_id])

        part = src.mapInArrow(run, out_type)
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
