"""Pages of stuffed keywords, tags or links instead of sentences.

A page is split into sentences, honest structures (table rows, contents, exhibits, glossary entries, dialogue) and list
segments. The list segments' phrases are exploded as shingles (pairs of neighbouring words) and their distinct hosts
counted over the corpus; a page is flagged if more than half of its words stand in list segments and enough of their
shingles are replicated on other hosts. A page that no other host shares a phrase with is never flagged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finloom.plans.runtime import spread, stored

SHARE, HOSTS, REPLICATED = 0.5, 3, 0.5

# Frequent function words of the corpus's languages.
FUNCTION_WORDS = frozenset(
    "the a an of to in on at by for from with within without and or but nor so as if than that this these those its it is was were be been are has have had will would can could should may might not no we our they their he she you your i which who what when where while after before since until because once though although given even also into over under about against across around between during through outside inside "
    "der die das den dem des ein eine einer eines einem einen und oder aber in im am an auf bei mit von vom zu zum zur für um nach vor seit bis weil da obwohl während ist war wird wurde hat haben nicht auch als wie "
    "le la les l un une des du de d et ou mais dans sur sous chez par pour avec sans en au aux à ce cette ces son sa ses qui que est a été sont ont ne pas plus alors car avant après depuis pendant malgré "
    "el los las una unos unas del al y o pero en con sin por para entre desde hasta tras pese su sus que es fue son ha han no más mientras porque cuando antes frente".split()
)
_ANCHOR = re.compile(r"<a\b[^>]*>(.*?)</a>|\[([^\]\n]{1,80})\]\(([^)\s]*)\)", re.I | re.S)
_TAG = re.compile(r"<[^<>]{1,300}>")
_URL = re.compile(r"(?:https?://|www\.|//)[^\s<>\"')\]]+", re.I)
_HASHTAG = re.compile(r"#[\w]+")
_CAMEL = re.compile(r"[^\W\d_][^\WA-ZÀ-Þ\d_]*|\d+")
_WORD = re.compile(r"[^\W_](?:[\w'’&.%-]*[^\W_%])?%?")
_CJK_RUN = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uff66-\uff9f々ー]+")
_CJK_SEP = re.compile(r"[\s>»|•·,;*、，；・｜／/☆★【】]+|\s[-–—]\s")
_CJK_END = re.compile(r"[。！？]")
_SEP = re.compile(r"\s*(?:[>»|•·,;*]|\s[-–—/]\s|\s/|/\s)\s*")
_CONTENTS = re.compile(r"\.{4,}\s*\d+|(?:\.\s){4,}\s*\d+")
_HONEST = re.compile(r"^\s*(?:exhibit|annex|appendix|schedule|item|part|note|table|figure)\s+[\dIVX]+", re.I)
_NUMBER = re.compile(r"^[\s($€£]*[\d.,%)\s-]+$|^[-–—]$|^$")
_SPEAKER = re.compile(r"^\s*(?:[QA]|[^\W\d_][\w.'’-]*(?:\s+[^\W\d_][\w.'’-]*){0,5})\s*:\s+\S")
_ENDS = re.compile(r"(?<=[.!?])[\"'”’)]*\s+(?=[^\W_a-z]|[\"'“‘(\d$])|(?<=[。！？])")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_LINES = re.compile(r"[\r\n]+")
_MARKS = ">|•»·#*"
_PRODUCT = re.compile(r"\b(?:\d+% off|sku \d+|sale|in stock|new|free shipping|buy now)\b", re.I)


def _words(s: str) -> list[str]:
    """The words of a text; scripts without spaces count two letters as a word."""
    if s.isascii() or not _CJK.search(s):
        return _WORD.findall(s)
    out = []
    for w in _WORD.findall(s):
        at = 0
        for m in _CJK_RUN.finditer(w):
            if m.start() > at:
                out.append(w[at : m.start()])
            out += [m[0][i : i + 2] for i in range(0, len(m[0]), 2)]
            at = m.end()
        if at < len(w):
            out.append(w[at:])
    return out


def _shingles(words: list[str]) -> list[str]:
    """A phrase's shingles, its pairs of neighbouring words (a lone word itself): lower case, codes and numbers masked."""
    low = ["@" if len(w) > 1 and w.isupper() and w.isascii() else "0" if w[0].isdigit() else w.lower() for w in words]
    return [f"{a} {b}" for a, b in zip(low, low[1:], strict=False)] or low


def _prose(text: str, into: Counter, said: list[list[str]], phrases: Counter) -> None:
    """Sentences of running text, kept for the page's repetitions; runs of words without function words are stuffing."""
    for s in _ENDS.split(text):
        w = s.lower().split()
        if not w:
            continue
        if not s.isascii() and _CJK.search(s):
            n = len(_words(s))
            # A long text that repeats its own letters is stuffing.
            drone = len(s) > 80 and 2 * len({s[i : i + 4] for i in range(len(s) - 3)}) <= len(s) - 3
            into["run" if drone else "sentence"] += n
            if drone:
                phrases.update(x for q in _CJK_SEP.split(s) for x in _shingles(_words(q)))
            continue
        said.append(w)


def _settle(said: list[list[str]], into: Counter, phrases: Counter) -> None:
    """Words of what looked like prose: a short piece whose word pairs mostly come back on the page, a long one that
    repeats its own, or one of at least eight words with hardly a function word is stuffing."""
    pairs: Counter = Counter()
    for w in said:
        pairs.update(zip(w, w[1:], strict=False))
    often = len(pairs) < 0.8 * sum(pairs.values())
    # Sentences without a listed function word that seldom repeat a word pair are of a language that is not listed.
    foreign = not often
    for w in said:
        n = sum(map(FUNCTION_WORDS.__contains__, w))
        back = often and 3 < len(w) <= SHORT and n <= 0.34 * len(w) and sum(pairs[p] > 2 for p in zip(w, w[1:], strict=False)) >= 0.6 * (len(w) - 1)
        drone = len(w) > 40 and 2 * len(set(zip(w, w[1:], strict=False))) <= len(w)
        bare = len(w) >= 8 and n < 0.06 * len(w) and not (w[-1][-1] in ".!?" and foreign)
        if back or drone or bare:
            into["run"] += len(w)
            for p in zip(w, w[1:], strict=False):
                phrases[f"{p[0]} {p[1]}".strip(".,;:!?")] += 1
        elif n >= 0.12 * len(w) or w[-1][-1] in ".!?":
            into["sentence"] += len(w)
        else:
            into["other"] += len(w)


def page_words(text: str) -> tuple[dict[str, int], dict[str, int]]:
    """(words by where they stand, count by shingle of the list phrases) of a page. Kinds: sentence, honest, other; link, tag, list and
    run are stuffing."""
    into: Counter = Counter()
    phrases: Counter = Counter()
    said: list[list[str]] = []
    pending: list[str] = []

    def note(kind: str, words: list[str]) -> None:
        if words:
            into[kind] += len(words)
            phrases.update(_shingles(words))

    def flush() -> None:
        if pending:
            _prose(" ".join(pending), into, said, phrases)
            pending.clear()

    if "<a" in text or "](" in text:

        def anchor(m: re.Match) -> str:
            note("link", _words(m[1] or m[2] or "link"))
            return " \n" if m[1] is not None else " "

        text = _ANCHOR.sub(anchor, text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    for line in _LINES.split(text):
        if "#" in line and len(tags := _HASHTAG.findall(line)) > 2:
            for t in tags:
                note("tag", _CAMEL.findall(t[1:]) or ["tag"])
            line = _HASHTAG.sub(" ", line)
        if ("//" in line or "www." in line) and (urls := _URL.findall(line)):
            into["link"] += len(urls)
            rest = _words(_URL.sub(" ", line))
            if len(rest) <= 6 * len(urls):
                flush()
                note("link", rest)
                continue
            line = _URL.sub(" ", line)
        low = line.lower().split()
        if not low:
            continue
        if not line.isascii() and _CJK.search(line):
            low = [w.lower() for w in _words(line)] or low
        few, marked = sum(map(FUNCTION_WORDS.__contains__, low)), any(c in line for c in _MARKS)
        if few < 0.12 * len(low) or marked:
            if "..." in line and _CONTENTS.search(line) or _HONEST.match(line):
                flush()
                into["honest"] += len(low)
                continue
            cells = line.split("|") if "|" in line else []
            if len(cells) > 2 and 2 * sum(bool(_NUMBER.match(c)) for c in cells) >= len(cells):
                flush()
                into["honest"] += len(low)
                continue
            parts = [p for p in _SEP.split(line) if p]
            if not line.isascii() and 4 * len(_CJK.findall(line)) > len(line):
                # Scripts without spaces: many short parts and hardly an end of a sentence.
                parts = [p for p in _CJK_SEP.split(line) if p]
                if len(parts) >= 3 and 8 * len(_CJK_END.findall(line)) <= len(parts) and sum(n for p in parts if (n := len(_words(p))) <= 6) >= 0.8 * len(_words(line)):
                    flush()
                    for p in parts:
                        note("list", _words(p))
                    continue
            elif len(parts) >= 3:
                sizes = [len(_words(p)) for p in parts]
                total = sum(sizes)
                # A list: most words in short parts and hardly a function word, or an offer's marks all over.
                if total and sum(n for n in sizes if n <= 5) >= 0.8 * total and (few <= 0.12 * total or (total <= 4 * len(parts) and few <= 0.4 * total and any(c in line for c in ">•»·")) or 3 * len(_PRODUCT.findall(line)) >= len(parts) or (len(parts) >= 8 and 2 * len({p.lower() for p in parts}) <= len(parts))):
                    flush()
                    for p in parts:
                        note("list", _words(p))
                    continue
        if len(low) > 40 and line.count(",") + line.count(" - ") + line.count("•") >= 12 and not _CJK.search(line):
            # Prose that turns into a list on one line: take the list's part.
            parts = [p for p in _SEP.split(line) if p]
            k = len(parts)
            while k and len(w := _words(parts[k - 1])) <= 5 and sum(x.lower() in FUNCTION_WORDS for x in w) <= 1:
                k -= 1
            if len(tail := parts[k + 1 :]) >= 12:
                flush()
                for p in tail:
                    note("list", _words(p))
                line = " ".join(parts[: k + 1])
        if ":" in line and _SPEAKER.match(line):
            flush()
            _prose(line, into, said, phrases)
        else:
            pending.append(line)
    flush()
    _settle(said, into, phrases)
    return dict(into), dict(phrases)


#: Words that a piece of repeated phrases may have at most; longer ones are sentences, however formulaic.
SHORT = 12
STUFFED = ("link", "tag", "list", "run")


def stuffed_pages(pages: DataFrame, page: str = "doc_id", text: str = "text", host: str = "source", share: float = SHARE, hosts: int = HOSTS, replicated: float = REPLICATED) -> DataFrame:
    """Distinct ids of pages in which more than ``share`` of the words stand in stuffed keywords, tags or link lists.

    At least the part ``replicated`` of the shingles of the stuffed words must stand on ``hosts`` or more different hosts
    (the rest may be the page's own names and codes, and pairs across the borders of phrases). Null, empty and blank texts are never flagged; a null host counts as no host;
    repeated rows are flagged alike; further columns are ignored; an empty table gives an empty result. The phrases of
    all pages are counted; partial counts per phrase and host precede the shuffle.
    """
    kind = "_id " + pages.schema[page].dataType.simpleString() + ", _host string, stuffed int, words int, phrases array<struct<h:string,n:int>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, h, t in zip(b["_id"], b["_host"], b["_text"], strict=True):
                into, ph = page_words(t)
                stuffed, total = sum(into.get(k, 0) for k in STUFFED), sum(into.values())
                if ph:
                    out.append((i, h, stuffed, total, [(p, n) for p, n in ph.items()]))
            yield pd.DataFrame(out, columns=["_id", "_host", "stuffed", "words", "phrases"])

    src = spread(pages.select(F.col(page).alias("_id"), F.col(host).cast("string").alias("_host"), F.col(text).alias("_text")).filter(F.length(F.trim("_text")) > 0))
    read = stored(src.mapInPandas(run, kind), "pages")
    shingles = read.select("_id", "_host", "stuffed", "words", F.explode("phrases").alias("p")).select("_id", "_host", "stuffed", "words", F.xxhash64("p.h").alias("h"), F.col("p.n").alias("n"))
    spread_out = shingles.filter("_host is not null").select("h", "_host").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("hosts"))
    dense = shingles.filter(F.col("stuffed") > share * F.col("words"))
    judged = dense.join(spread_out, "h", "left").groupBy("_id", "stuffed", "words").agg(F.sum(F.when(F.col("hosts") >= hosts, F.col("n")).otherwise(0)).alias("elsewhere"), F.sum("n").alias("all"))
    return judged.filter(F.col("elsewhere") >= replicated * F.col("all")).select(F.col("_id").alias(page)).distinct()
