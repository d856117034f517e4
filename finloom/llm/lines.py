"""Lines that one source repeats across its documents, found with compressed bitmaps of the documents that hold them.

A line's key is its letters in lower case, without dates, so that lines that differ in case, spacing, punctuation,
leading marks, numbers or dates share a key. Per source a key's documents are a bitmap in blocks of 32,768 rows, each an
array where it holds few rows and a bitset where it holds many; the bitmaps of keys within one mistaken character of
each other are united, their exact cardinalities held against the threshold, and each line is deleted if its document is
in a bitmap that passed.

What makes that cheap: a line and its variants with one mistake agree in one half of their letters (or in 20 letters at
one end), so a repeated family has a half that stands in at least half as many lines. Counting the halves, as hashes and
with a partial aggregation before the shuffle, leaves few lines for the exact steps. Variants meet on all but one of 16
blocks of their letters, so what meets is nearly always alike, however many lines begin or end in the same way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finloom.plans.runtime import BROADCAST_ROWS, small, spread, stored

LEAST_ROWS, LEAST_SHARE = 5, 0.03
_END, _BLOCKS = 20, 16
#: Rows from which a block's container is a bitset (4 KB) rather than an array (2 bytes a row as a compressed column).
ARRAY_ROWS = 1024
#: Parts into which the lines of a key are split where the repeated keys are too many to broadcast.
SALTS = 32

# Names of months and days as they are written in dates (by first letters, which Java matches faster).
#: "may" is a month only beside a number or behind a preposition; the literal stands first, for it is seldom there.
_MAY = r"y(?:(?<=[^\p{L}\d]\d{1,2}[^\p{L}\d]{1,4}may)|(?<=[^\p{L}](?:on|until|by|in|from|since)[^\p{L}]{1,4}may)|(?=[^\p{L}]*\d(?:(?!\p{L})|st|nd|rd|th)))"
DATES = rf"(?:j(?:an(?:uary)?|une?|uly?)|feb(?:ruary)?|ma(?:r(?:ch)?|{_MAY})|a(?:pr(?:il)?|ug(?:ust)?)|s(?:ept?(?:ember)?|aturday|unday)|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?|monday|t(?:ues|hurs)day|wednesday|friday)"
_LONG_MONTHS = ("january", "february", "september", "october", "november", "december", "august", "april", "march", "june", "july")

#: A line that somebody says: a label of a role or of two to four capitalised name parts, or a label with nothing but notes.
_TIME = r"(?:[\[({<]?\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d+)?[\])}>]?|\d+m\d+s)"
_NAME = r"\p{Lu}[\p{L}.'’-]*,?(?: +\p{Lu}[\p{L}.'’-]*){1,3}"
_ROLE = r"(?i:(?:conference )?operator|moderator|coordinator)"
SPOKEN = (
    rf"^\s*{_TIME}?\s*(?:>>\s*)?(?:[QA]\s*-\s*)?(?:"
    rf"<(?:{_NAME}|{_ROLE})>|\[(?:{_NAME}|{_ROLE})\]|(?:{_NAME}|{_ROLE})(?:\s*\([^)]*\)|\s+--[^:]{{1,60}})?:|{_ROLE}\s+--|"
    r"[^:]{1,60}:\s*+(?:[\[\](){}<>*]++[\p{L} .]{1,30}+)+[\])}>*]++\s*$)"
)
# Words that make a head before a colon a notice's and nobody's name; words of courtesy, of which a line
# that holds no others is said by somebody.
_NOTICE = r"(?i)^[^:]*\b(?:statements?|contacts?|harbou?r|disclaimer|notice|copyright|disclosures?|replay|webcast|website|reminder|disclosure)\b[^:]*:"
_COURTESY = "thank thanks you your very much so yes yeah yep no nope okay ok right sure great good morning afternoon evening day everyone everybody all hello hi welcome please go ahead got it perfect absolutely exactly correct understood and bye goodbye take care that that's is helpful fair enough again i see".split()
_COURTEOUS = rf"(?i)^(?:[^\p{{L}}]*+(?:{'|'.join(sorted(_COURTESY, key=len, reverse=True))})(?![\p{{L}}'’]))++[^\p{{L}}]*+$"


def said(line: Column) -> Column:
    """Whether somebody says the line: it begins with a speaker's label, or all its words are words of courtesy."""
    marked = (F.locate(":", line) > 0) | (F.locate("--", line) > 0) | F.ltrim(line).substr(1, 1).isin("<", "[")
    return F.coalesce((marked & line.rlike(SPOKEN) & ~line.rlike(_NOTICE)) | line.rlike(_COURTEOUS), F.lit(False))


# What stands for a month, however it is spelled: before a day and a year, and behind a word of a term before a day.
_BEFORE_YEAR = r"[^\s\u00a0]{2,10}[\s\u00a0]+\d{1,2},[\s\u00a0]+20\d\d"
_UNTIL = ("until", "through", "since", "dated")
_BEFORE_DAY = rf"([\s\u00a0](?:{'|'.join(_UNTIL)})[\s\u00a0]+)[^\s\u00a0\d]{{2,10}}[\s\u00a0]+\d{{1,2}}(?![\d\p{{L}}])"


def with_keys(lines: DataFrame, line: str = "line") -> DataFrame:
    """``lines`` with ``key``: the line's letters in lower case, dates left out: names of months and days ("may" only
    beside a number or behind a preposition), and whatever stands for a month before a day and a year or, behind a word
    such as until, before a day. Step by step, so that no step's expression is computed twice."""
    rows = lines.withColumn("_low", F.concat(F.lit(" "), F.lower(line)))
    rows = rows.withColumn("_low", F.when(F.col("_low").rlike(",[\\s\u00a0]+20\\d\\d"), F.regexp_replace("_low", _BEFORE_YEAR, " ")).otherwise(F.col("_low")))
    # Looking for the words first is much cheaper than the pattern.
    term = reduce(lambda a, b: a | b, [F.contains("_low", F.lit(w)) for w in _UNTIL])
    rows = rows.withColumn("_low", F.when(term, F.regexp_replace("_low", _BEFORE_DAY, "$1 ")).otherwise(F.col("_low")))
    return rows.withColumn("key", F.regexp_replace("_low", rf"[^\p{{L}}]+(?:{DATES}(?:[^\p{{L}}]+|$))*", "")).drop("_low")


def _halves(source: Column, key: Column) -> Column:
    """Hashes of parts of the key of which one survives any single mistake: long keys by 20 letters at either end, short
    ones by true halves."""
    n = F.length(key)
    part = lambda side, k: F.xxhash64(source, F.lit(side), F.left(key, k) if side == "l" else F.right(key, k))
    true = []
    for b in (n, n - 1):
        half = F.floor(b / 2).cast("int")
        true += [part("l", half), part("r", b - half)]
    far = [part("l", F.lit(_END)), part("r", F.lit(_END))]
    return F.when(n > 2 * _END, F.array(*far)).when(n == 2 * _END - 1, F.array(*true, far[0])).when(n == 2 * _END, F.array(*true)).otherwise(F.array(*true))


def _all_but_one(source: Column, key: Column, n: Column) -> Column:
    """Hashes of the key of ``n`` letters without one of its blocks, for each block: two keys of two letters or more that
    one mistake turns into each other share one. Blocks are counted over the shorter one's letters (n or one less)."""

    def without_each(b: Column) -> Column:
        wide = F.ceil(b / _BLOCKS).cast("int")
        one = lambda j: F.xxhash64(source, b, j, F.substring(key, F.lit(1), j * wide), F.substring(key, n - b + (j + 1) * wide + 1, b))
        return F.when(b > 1, F.transform(F.sequence(F.lit(0), F.ceil(b / wide).cast("int") - 1), one)).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(F.concat(without_each(n), without_each(n - 1)))


def _mend_months(key: Column) -> Column:
    """Month names with one mistaken letter, too, are left out of a key."""
    ways = []
    for m in _LONG_MONTHS:
        if len(m) > 5:
            ways += [m[:i] + "." + m[i + 1 :] for i in range(1, len(m) - 1)] + [m[:i] + m[i + 1 :] for i in range(1, len(m) - 1)]
            ways += [m[1:] if len(m) > 6 else "." + m[1:]]
        else:
            ways += [m[:i] + "." + m[i + 1 :] for i in range(1, len(m))] + [m[:i] + m[i + 1 :] for i in range(1, len(m) - 1)]
    return F.regexp_replace(key, "|".join(dict.fromkeys(ways)), "")


def _families(keys: DataFrame, least: DataFrame) -> DataFrame:
    """(src, key, centre, least): keys (src, key, n, mended) by family, the keys within one mistake of its centre.

    A spelling is a centre if its family stands in ``least`` rows by the sum of the counts (a bound of the exact number); one that stands once, only
    if no spelling near it that stands more often has such a family."""
    # A key is spelled as it is and without what may be a mistaken month; either may be alike another's.
    forms = keys.select("src", "key", "n", F.explode(F.filter(F.array_distinct(F.array("key", "mended")), lambda x: x != "")).alias("mended"))
    spelt = stored(forms.groupBy("src", "mended").agg(F.sum("n").alias("n")).withColumns({"letters": F.length("mended"), "id": F.xxhash64("src", "mended")}), "spelt")
    # The length is a column of its own: inside the lambda it would be counted anew for every block. Only hashes meet.
    blocks = spelt.select("id", F.explode(_all_but_one(F.col("src"), F.col("mended"), F.col("letters"))).alias("block"))
    pairs = blocks.join(blocks.withColumnRenamed("id", "other").hint("merge"), "block").filter("id <> other").select("id", "other").distinct()
    centre = spelt.select("id", "src", F.col("mended").alias("centre"), F.col("n").alias("c"))
    other = spelt.select(F.col("id").alias("other"), F.col("src").alias("s"), "mended", "n")
    met = pairs.join(centre, "id").join(other, "other").filter((F.col("src") == F.col("s")) & (F.levenshtein("centre", "mended", 1) >= 0)).select("src", "centre", "c", "mended", "n")
    met = met.unionByName(spelt.select("src", F.col("mended").alias("centre"), F.col("n").alias("c"), "mended", "n"))
    met = stored(met, "met")
    total = met.groupBy("src", "centre").agg(F.sum("n").alias("total"), F.max("c").alias("c")).join(least.select("src", "least"), "src").filter("total >= least").select("src", "centre", "c", "least")
    total = stored(total, "total")
    often = total.filter("c > 1").select("src", F.col("centre").alias("mended"))
    beside = met.filter("c = 1").join(often, ["src", "mended"], "left_semi").select("src", "centre").distinct()
    centres = total.join(beside, ["src", "centre"], "left_anti").select("src", "centre", "least")
    return met.join(centres, ["src", "centre"]).join(forms.select("src", "mended", "key"), ["src", "mended"]).select("src", "key", "centre", "least").distinct()


def repeated_lines(docs: DataFrame, source: str = "ticker", row: str = "chunk_key", text: str = "text", least_rows: int = LEAST_ROWS, least_share: float = LEAST_SHARE) -> DataFrame:
    """Distinct (row, line_no), ``line_no`` from 1, of the lines repeated within their source.

    A line is repeated if lines alike stand in at least ``least_rows`` rows and ``least_share`` of the source's rows.
    Rows with a null source or text have none; so have lines without a letter, lines that begin with a speaker's label
    and lines of nothing but courtesies. A line of one letter is like itself only. ``row`` must be a unique non-negative
    integer; repeated texts count as rows of their own, several like lines in one row count once and are all reported.
    Empty tables give an empty result; further columns are ignored. All counts are exact and over all rows. A family's
    unmistaken spelling must stand at least once: two lines with different mistakes are two characters apart.
    """
    base = spread(docs.select(F.col(source).cast("string").alias("src"), F.col(row).cast("bigint").alias("rid"), F.col(text).alias("txt")).filter("src is not null"))
    least = (
        base.groupBy("src").agg(F.count(F.lit(1)).alias("n")).select("src", F.xxhash64("src").alias("h"), F.greatest(F.lit(least_rows), F.ceil(F.col("n") * least_share - 1e-9)).alias("least"))
    )
    least = small(stored(least, "least"))
    # The keys of all lines are computed once and kept.
    # Outer explodes: for inner ones the optimizer infers filters that compute what is exploded a second time.
    lines = base.select("src", "rid", F.posexplode_outer(F.split("txt", "\n")).alias("i", "line"))
    lines = with_keys(lines.withColumn("said", said(F.col("line")))).select("src", "rid", "i", "said", "key")
    # Filtered behind the table: before it, the filter would compute every key a second time.
    lines = stored(lines, "keys").filter((F.length("key") > 0) & ~F.col("said")).select("src", "rid", "i", "key")

    count = lines.select(F.xxhash64("src").alias("h"), F.explode_outer(_halves(F.col("src"), F.col("key"))).alias("half")).groupBy("h", "half").agg(F.count(F.lit(1)).alias("n"))
    count = stored(count.filter("n > 1").join(least.select("h", "least"), "h").select("half", (F.col("n") * 2 >= F.col("least")).alias("heavy")), "halves")
    heavy = small(count.filter("heavy").select("half").distinct())
    halves = lines.withColumn("half", F.explode_outer(_halves(F.col("src"), F.col("key"))))
    first = stored(halves.join(heavy, "half", "left_semi").select("src", "rid", "i", "key").distinct(), "lines")
    # Variants that share no heavy half with anybody share the other half with one of those lines.
    beside = first.select("src", "key").distinct().select(F.explode(_halves(F.col("src"), F.col("key"))).alias("half")).join(count.filter("not heavy").select("half"), "half", "left_semi").distinct()
    beside = small(stored(beside, "beside"))
    left = stored(halves.join(beside, "half", "left_semi").select("src", "rid", "i", "key").unionByName(first).distinct(), "lines")

    # Containers: per source and key, the rows of each block of 32,768 rows, as an array of their low 15 bits.
    low, high = F.bitmap_bit_position(F.col("rid") + 1), F.bitmap_bucket_number(F.col("rid") + 1)
    boxes = stored(left.select("src", "key", high.alias("box"), low.cast("int").alias("low")).groupBy("src", "key", "box").agg(F.collect_set("low").alias("lows")), "boxes")
    keys = stored(boxes.groupBy("src", "key").agg(F.sum(F.size("lows")).alias("n")).withColumn("mended", _mend_months(F.col("key"))), "keys")
    near = stored(_families(keys, least), "near")
    # Large containers become bitsets, once; those of a family are united: arrays to one array, bitsets to one bitset.
    many = F.size("lows") > ARRAY_ROWS
    dense = boxes.filter(many).join(near.select("src", "key").distinct(), ["src", "key"], "left_semi").select("src", "key", "box", F.explode("lows").alias("low")).groupBy("src", "key", "box").agg(F.bitmap_construct_agg("low").alias("bits"))
    held = boxes.filter(~many).select("src", "key", "box", "lows", F.lit(None).cast("binary").alias("bits")).unionByName(dense.select("src", "key", "box", F.array().cast("array<int>").alias("lows"), "bits"))
    unions = held.join(near, ["src", "key"]).groupBy("src", "centre", "least", "box").agg(F.array_distinct(F.flatten(F.collect_list("lows"))).alias("lows"), F.count("bits").alias("dense"), F.bitmap_or_agg("bits").alias("bits"))
    unions = unions.withColumn("bits", F.when(F.col("dense") > 0, F.col("bits")))
    unions = stored(unions.withColumn("lows", F.when(F.col("bits").isNull(), F.col("lows")).otherwise(F.filter("lows", lambda x: ~_bit(x)))).drop("dense"), "unions")
    passed = unions.groupBy("src", "centre", "least").agg(F.sum(F.size("lows") + F.coalesce(F.bitmap_count("bits"), F.lit(0))).alias("n")).filter("n >= least").select("src", "centre")
    passed = stored(passed, "passed")
    bits = unions.join(passed, ["src", "centre"], "left_semi").select("src", "centre", "box", "lows", "bits")
    # The lines of a repeated key meet its families; where those are too many to broadcast, in parts.
    asked = stored(near.join(passed, ["src", "centre"], "left_semi").select("src", "key", "centre"), "asked")
    if asked.count() <= BROADCAST_ROWS:
        found = left.join(F.broadcast(asked), ["src", "key"])
    else:
        salted = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = left.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int")).join(salted, ["src", "key", "salt"])
    hit = found.withColumns({"box": high, "low": low.cast("int")}).join(bits, ["src", "centre", "box"]).filter(F.array_contains("lows", F.col("low")) | F.coalesce(_bit(F.col("low")), F.lit(False)))
    return hit.select(F.col("rid").cast(docs.schema[row].dataType).alias(row), (F.col("i") + 1).cast("int").alias("line_no")).distinct()


def _bit(low: Column) -> Column:
    """Whether the bit ``low`` is set in the bitset ``bits``."""
    return F.conv(F.hex(F.substring(F.col("bits"), (low / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int").bitwiseAND(F.call_function("shiftleft", F.lit(1), (low % 8).cast("int"))) != 0


def without_lines(docs: DataFrame, found: DataFrame, row: str = "chunk_key", text: str = "text") -> DataFrame:
    """(row, text) of every row of ``docs``, the found lines deleted and the others as they were; null stays null."""
    gone = found.groupBy(row).agg(F.collect_set("line_no").alias("_gone"))
    kept = F.filter(F.split(F.col(text), "\n"), lambda _, i: ~F.array_contains(F.col("_gone"), (i + 1).cast("int")))
    return docs.select(row, text).join(gone, row, "left").select(row, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(text))
