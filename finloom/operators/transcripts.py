"""Parsing of transcripts and filings: phases, speakers, utterances, exchanges, runs and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Where questions begin, in order of trust; titles before names; roles and the words that show them.
QA_STARTS = ["question[- ]and[- ]answer", "q\\s*&\\s*a session", "first question", "open (?:up )?the (?:call|line|floor) (?:for|to) questions"]
TITLES = "(?i)^(?:mr|mrs|ms|dr|prof)\\.?\\s+"
ROLES = [("ceo", "chief executive|\\bceo\\b"), ("cfo", "chief financial|\\bcfo\\b"), ("coo", "chief operating|\\bcoo\\b"), ("cto", "chief technology|\\bcto\\b"), ("executive", "president|chairman|vice president|director|investor relations"), ("operator", "\\boperator\\b"), ("analyst", "analyst|\\bbank\\b|capital|securities|research|partners|advisory|equity")]

SPEAKER_LINE = "(?m)^([A-Z][a-z]+(?: [A-Z][a-z]+)+)(?: --[^:\n]*| \\([^)\n]*\\))?:"


def place(col: Column, pattern: str) -> Column:
    """Position (from 1, in characters) of the first match; null without one. ``regexp_instr`` would count letters
    beyond the basic plane twice."""
    return F.when(col.rlike(pattern), F.length(F.get(F.split(col, pattern, 2), F.lit(0))) + 1)


def qa_start(text: str | Column) -> Column:
    """Position (from 1) where questions begin by the first pattern that occurs at all; null where none does."""
    col = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.coalesce(*[place(col, p) for p in QA_STARTS])


def phase_at(position: str | Column, start: str | Column) -> Column:
    p, s = (F.col(c) if isinstance(c, str) else c for c in (position, start))
    return F.when(s.isNotNull() & (p >= s), "qa").otherwise("prepared_remarks")


def clean_transcript(text: str | Column) -> Column:
    """CRLF, page numbers on lines of their own, copyright lines and runs of blank lines removed."""
    col = F.col(text) if isinstance(text, str) else text
    col = F.regexp_replace(col, "\r\n?", "\n")
    col = F.regexp_replace(col, "(?m)^[ \t]*(?:page )?\\d+(?: of \\d+)?[ \t]*$", "")
    col = F.regexp_replace(col, "(?mi)^.*all rights reserved.*$", "")
    return F.trim(F.regexp_replace(col, "\n{3,}", "\n\n"))


def speakers(text: str | Column) -> Column:
    """Distinct names that stand before a colon at a line's start, in order."""
    col = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.regexp_extract_all(col, F.lit(SPEAKER_LINE), 1))


def clean_name(name: str | Column) -> Column:
    """Without title, with single spaces."""
    col = F.col(name) if isinstance(name, str) else name
    return F.trim(F.regexp_replace(F.regexp_replace(col, "\\s+", " "), TITLES, ""))


def role(context: str | Column) -> Column:
    """The first role whose words stand in the context, else unknown."""
    col = F.lower(F.coalesce(F.col(context) if isinstance(context, str) else context, F.lit("")))
    out = F.lit("unknown")
    for name, pattern in reversed(ROLES):
        out = F.when(col.rlike(pattern), name).otherwise(out)
    return out


def utterances(df: DataFrame, key: str, text: str, least: int = 10) -> DataFrame:
    """(key, idx, speaker, position, phase, utterance_type, text): the text cut at speaker lines; ``position`` is the
    label's place in the text as it is. What is shorter than ``least`` characters is dropped afterwards."""
    mark = "\u0001"
    pieces = F.split(F.regexp_replace(F.regexp_replace(F.col(text), mark, " "), SPEAKER_LINE, mark + "$0"), mark)
    before = lambda i: F.aggregate(F.slice("_p", 1, i), F.lit(0), lambda n, x: n + F.length(x))
    at = F.transform("_p", lambda x, i: F.struct(i.alias("idx"), x.alias("raw"), (before(i) + 1).alias("position")))
    rows = df.select(key, qa_start(text).alias("_qa"), pieces.alias("_p")).select(key, "_qa", F.inline(at)).filter("idx > 0")
    label = SPEAKER_LINE.replace("(?m)", "")
    body = F.trim(F.regexp_replace(F.regexp_replace("raw", label, ""), "\\s+", " "))
    rows = rows.select(key, "idx", "_qa", "position", F.regexp_extract("raw", label, 1).alias("speaker"), body.alias("text")).filter(F.length("text") >= least)
    rows = rows.withColumn("phase", phase_at("position", "_qa"))
    kind = F.when(F.col("phase") != "qa", "statement").when(F.col("text").contains("?"), "question").otherwise("answer")
    return rows.select(key, "idx", "speaker", "position", "phase", kind.alias("utterance_type"), "text")


# Titles of executives and the firms of analysts, in the order in which they are looked for.
EXECUTIVES = [("CEO", r"\b(?:CEO|Chief Executive Officer)\b"), ("CFO", r"\b(?:CFO|Chief Financial Officer)\b"), ("COO", r"\b(?:COO|Chief Operating Officer)\b"), ("CTO", r"\b(?:CTO|Chief Technology Officer)\b"), ("President", r"\bPresident\b"), ("Chairman", r"\bChairman\b")]
FIRMS = ["Goldman Sachs", "Morgan Stanley", "JP Morgan", "JPMorgan", "Bank of America", "Citigroup", "Wells Fargo", "Barclays", "UBS", "Credit Suisse", "Deutsche Bank", "Piper Sandler", "Raymond James", "Evercore", "Jefferies", "Stifel", "Oppenheimer", "Cowen", "Bernstein", "RBC", "BMO", "Mizuho", "Needham"]


def context_of(text: str | Column, name: str | Column, most: int = 500) -> Column:
    """What stands on the lines around a name: it and up to 200 characters behind it, for its places in order until
    more than ``most`` characters have come together."""
    t, n = (F.col(c) if isinstance(c, str) else c for c in (text, name))
    pattern = F.concat(F.lit("(?i)"), F.regexp_replace(n, r"([^\p{L}\p{N}\s])", r"\\$1"), F.lit("[^\n]{0,200}"))
    found = F.when(F.length(n) > 0, F.regexp_extract_all(t, pattern, 0))
    return F.coalesce(F.aggregate(found, F.lit(""), lambda got, x: F.when(F.length(got) > most, got).otherwise(F.concat(got, x, F.lit(" ")))), F.lit(""))


def speaker_role(context: str | Column) -> Column:
    """struct<role, firm>: an executive's title first, then an analyst's firm, then the operator, else Unknown."""
    col = F.coalesce(F.col(context) if isinstance(context, str) else context, F.lit(""))
    executive = F.coalesce(*[F.when(col.rlike(f"(?i){p}"), F.lit(r)) for r, p in EXECUTIVES])
    firm = F.coalesce(*[F.when(F.contains(F.lower(col), F.lit(f.lower())), F.lit(f)) for f in FIRMS])
    other = F.when(firm.isNotNull(), "Analyst").when(col.rlike(r"(?i)\b(?:Operator|Moderator)\b"), "Operator").otherwise("Unknown")
    return F.struct(F.coalesce(executive, other).alias("role"), F.when(executive.isNull(), firm).alias("firm"))


def tag_speakers(text: str | Column) -> Column:
    """Labels at the starts of lines as ``[SPEAKER: name]``, the name without its title and with single spaces."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(col, SPEAKER_LINE, "[SPEAKER: $1]")


def runs(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Adds ``run``: the number (from 1) of the stretch of equal neighbouring values; nulls are equal to each other."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.when(F.row_number().over(w) == 1, 1).otherwise(F.when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1))
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def exchanges(df: DataFrame, key: str, order: str, is_question: Column, is_answer: Column) -> DataFrame:
    """Adds ``exchange_no`` and ``exchange_role``: a question opens an exchange, the first answer behind it belongs to
    it, everything else to none."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_q", F.coalesce(is_question, F.lit(False))).withColumn("_a", F.coalesce(is_answer, F.lit(False)) & ~F.col("_q"))
    rows = rows.withColumn("_ex", F.sum(F.col("_q").cast("int")).over(w))
    w2 = Window.partitionBy(key, "_ex").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_n", F.sum(F.col("_a").cast("int")).over(w2))
    role_ = F.when(F.col("_q"), "question").when(F.col("_a") & (F.col("_n") == 1) & (F.col("_ex") > 0), "answer")
    return rows.withColumn("exchange_role", role_).withColumn("exchange_no", F.when(role_.isNotNull(), F.col("_ex")).cast("int")).drop("_q", "_a", "_ex", "_n")


def label_asof(rows: DataFrame, keys: list[str], order: str, label: Column, name: str) -> DataFrame:
    """Adds the last non-null label at or before each row: an interval join written as one window."""
    return rows.withColumn(name, F.last(label, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


# Headings of filings and the sections they open.
SECTIONS = [("item_1", "Business", "item\\s+1\\.\\s"), ("item_1a", "Risk Factors", "item\\s+1a\\."), ("item_2", "Properties", "item\\s+2\\."), ("item_3", "Legal Proceedings", "item\\s+3\\."), ("item_7", "MD&A", "item\\s+7\\.\\s"), ("item_7a", "Market Risk", "item\\s+7a\\."), ("item_8", "Financial Statements", "item\\s+8\\."), ("part_i", "Financial Information", "part\\s+i\\.?\\s")]


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_id, title, position, end): the first place of every heading that occurs, each ending where the
    next begins."""
    low = F.lower(F.col(text))
    found = F.array(*[F.struct(F.lit(i).alias("section_id"), F.lit(t).alias("title"), place(low, p).alias("position")) for i, t, p in SECTIONS])
    rows = df.select(key, F.length(text).alias("_n"), F.explode(found).alias("s")).select(key, "_n", "s.*").filter("position > 0")
    w = Window.partitionBy(key).orderBy("position", "section_id")
    return rows.select(key, "section_id", "title", "position", F.coalesce(F.lead("position").over(w) - 1, F.col("_n")).alias("end"))


# The items of the two forms and how their headings are written, in the forms' order.
FORM_SECTIONS = {
    "10-K": [
        ("Item 1", r"ITEM\s*1[A-Z]?\b\.?\s*[-–—]?\s*BUSINESS"),
        ("Item 1A", r"ITEM\s*1A\b\.?\s*[-–—]?\s*RISK\s+FACTORS"),
        ("Item 1B", r"ITEM\s*1B\b\.?\s*[-–—]?\s*UNRESOLVED\s+STAFF"),
        ("Item 2", r"ITEM\s*2\b\.?\s*[-–—]?\s*PROPERTIES"),
        ("Item 3", r"ITEM\s*3\b\.?\s*[-–—]?\s*LEGAL\s+PROCEEDINGS"),
        ("Item 4", r"ITEM\s*4\b\.?\s*[-–—]?\s*MINE\s+SAFETY"),
        ("Item 5", r"ITEM\s*5\b\.?\s*[-–—]?\s*MARKET\s+FOR"),
        ("Item 6", r"ITEM\s*6\b\.?\s*[-–—]?\s*(?:SELECTED|RESERVED)"),
        ("Item 7", r"ITEM\s*7[A-Z]?\b\.?\s*[-–—]?\s*MANAGEMENT['’]?S?\s+DISCUSSION"),
        ("Item 7A", r"ITEM\s*7A\b\.?\s*[-–—]?\s*QUANTITATIVE\s+AND\s+QUALITATIVE"),
        ("Item 8", r"ITEM\s*8\b\.?\s*[-–—]?\s*FINANCIAL\s+STATEMENTS"),
        ("Item 9", r"ITEM\s*9[ABC]?\b\.?\s*[-–—]?\s*(?:CHANGES\s+IN|CONTROLS|DISCLOSURE)"),
        ("Item 10", r"ITEM\s*10\b\.?\s*[-–—]?\s*DIRECTORS"),
        ("Item 11", r"ITEM\s*11\b\.?\s*[-–—]?\s*EXECUTIVE\s+COMPENSATION"),
        ("Item 12", r"ITEM\s*12\b\.?\s*[-–—]?\s*SECURITY\s+OWNERSHIP"),
        ("Item 13", r"ITEM\s*13\b\.?\s*[-–—]?\s*CERTAIN\s+RELATIONSHIPS"),
        ("Item 14", r"ITEM\s*14\b\.?\s*[-–—]?\s*PRINCIPAL\s+(?:ACCOUNTANT|ACCOUNTING)"),
        ("Item 15", r"ITEM\s*15\b\.?\s*[-–—]?\s*EXHIBITS"),
        ("Item 16", r"ITEM\s*16\b\.?\s*[-–—]?\s*FORM\s+10-K"),
    ],
    "10-Q": [
        ("Part I", r"PART\s+I\.?\s*[-–—]?\s*FINANCIAL\s+INFORMATION"),
        ("Item 1", r"ITEM\s*1\b\.?\s*[-–—]?\s*FINANCIAL\s+STATEMENTS"),
        ("Item 2", r"ITEM\s*2\b\.?\s*[-–—]?\s*MANAGEMENT['’]?S?\s+DISCUSSION"),
        ("Item 3", r"ITEM\s*3\b\.?\s*[-–—]?\s*QUANTITATIVE\s+AND\s+QUALITATIVE"),
        ("Item 4", r"ITEM\s*4\b\.?\s*[-–—]?\s*CONTROLS\s+AND\s+PROCEDURES"),
        ("Part II", r"PART\s+II\.?\s*[-–—]?\s*OTHER\s+INFORMATION"),
        ("Item 1A", r"ITEM\s*1A\b\.?\s*[-–—]?\s*RISK\s+FACTORS"),
        ("Item 5", r"ITEM\s*5\b\.?\s*[-–—]?\s*OTHER\s+INFORMATION"),
        ("Item 6", r"ITEM\s*6\b\.?\s*[-–—]?\s*EXHIBITS"),
    ],
}


def form_sections(df: DataFrame, key: str, text: str, form: str) -> DataFrame:
    """(key, section, position, content) by the headings of the row's form: the first place of each, up to the next; a
    text in which none occurs, or of another form, is one section ``FULL``. Null texts have none."""
    places = lambda items: F.array(*[F.struct(F.lit(i).alias("section"), place(F.col(text), f"(?i){p}").alias("position")) for i, p in items])
    none = F.array().cast("array<struct<section:string,position:int>>")
    found = none
    for f, items in FORM_SECTIONS.items():
        found = F.when(F.col(form) == f, places(items)).otherwise(found)
    ordered = F.array_sort(F.transform(F.filter(found, lambda s: s["position"] > 0), lambda s: F.struct(s["position"].alias("position"), s["section"].alias("section"))))
    rows = df.filter(F.col(text).isNotNull()).select(key, F.col(text).alias("_t"), ordered.alias("_s"))
    whole = F.array(F.struct(F.lit(1).alias("position"), F.lit("FULL").alias("section")))
    rows = rows.withColumn("_s", F.when(F.size("_s") > 0, F.col("_s")).otherwise(whole))
    rows = rows.select(key, "_t", "_s", F.posexplode("_s").alias("_i", "_x"))
    end = F.coalesce(F.get("_s", F.col("_i") + 1)["position"], F.length("_t") + 1)
    return rows.select(key, F.col("_x.section").alias("section"), F.col("_x.position").alias("position"), F.substring(F.col("_t"), F.col("_x.position"), end - F.col("_x.position")).alias("content"))


def export_markdown(df: DataFrame, key: str, group: str, order: str, text: str) -> DataFrame:
    """(key, markdown): texts in order under a heading for every stretch of equal ``group``."""
    numbered = runs(df.select(key, group, order, text), [key], order, group)
    w = Window.partitionBy(key, "run").orderBy(order)
    piece = F.concat(F.when(F.row_number().over(w) == 1, F.concat(F.lit("## "), F.coalesce(F.col(group), F.lit("FULL")), F.lit("\n\n"))).otherwise(""), F.coalesce(F.col(text), F.lit("")))
    return numbered.withColumn("_p", piece).groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "_p"))), lambda x: x["_p"]), "\n\n").alias("markdown"))
