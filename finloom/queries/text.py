"""Text: terms, tokens, cleaning, sentences, paragraphs, windows, packing, HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finloom.config import ChunkConfig
from finloom.functions import html, text
from finloom.functions.stem import stems
from finloom.operators import chunking, lexical, transcripts, units
from finloom.plans.runtime import table
from finloom.queries import query

# White space in RE2's spelling.
WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _toks(c: str = "text") -> str:
    return f"list_filter(regexp_split_to_array({c}, '{WS}'), lambda x: x <> '')"


def _terms(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda x: x <> '')"


@query(f"""
SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS occurrences FROM (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_terms('text')}) AS term FROM documents) GROUP BY doc_id, term) GROUP BY term""")
def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    index = lexical.build_index(table(spark, d, "documents"), "doc_id", "text")
    return index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("occurrences"))


@query(f"SELECT chunk_key, CAST(len({_toks()}) AS BIGINT) AS n_tokens, CAST(length(text) // 4 AS BIGINT) AS estimate, CAST(floor(len({_toks()}) * 0.15) AS BIGINT) AS overlap, length(text) AS n_chars FROM chunks")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    n = text.token_count("text")
    return table(spark, d, "chunks").select("chunk_key", n.cast("bigint").alias("n_tokens"), F.floor(F.length("text") / 4).cast("bigint").alias("estimate"), chunking.overlap_tokens(n, 0.15).cast("bigint").alias("overlap"), F.length("text").cast("bigint").alias("n_chars"))


@query(r"""SELECT chunk_key, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n[ \t\n]*\n[ \t]*\n', chr(10) || chr(10), 'g'), '^[ \t\n]+|[ \t\n]+$', '', 'g') AS cleaned FROM chunks""")
def clean_ws(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_key", text.clean_whitespace("text").alias("cleaned"))


_BOILER = "text"
for _p in text.BOILERPLATE:
    _BOILER = f"regexp_replace({_BOILER}, '(?i){_p}', chr(10), 'g')"


@query(f"SELECT chunk_key, {_BOILER} AS stripped FROM chunks")
def strip_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_key", text.strip_boilerplate("text").alias("stripped"))


@query(r"""SELECT doc_id, idx, sentence FROM (SELECT doc_id, unnest(s) AS sentence, CAST(generate_subscripts(s, 1) - 1 AS BIGINT) AS idx FROM (
  SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 0) AS s FROM documents WHERE text IS NOT NULL))""")
def split_sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.sentences("text")).alias("idx", "sentence")).withColumn("idx", F.col("idx").cast("bigint"))


_PARAS = r"list_filter(list_transform(regexp_split_to_array(text, '\n[ \t\r]*\n[ \t\r\n]*'), lambda x: regexp_replace(x, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')), lambda x: x <> '')"


@query(f"SELECT doc_id, CAST(len(p) AS BIGINT) AS n_paragraphs, CAST(list_sum(list_transform(p, lambda x: length(x))) AS BIGINT) AS n_chars FROM (SELECT doc_id, {_PARAS} AS p FROM documents WHERE text IS NOT NULL) WHERE len(p) > 0")
def paragraph_units(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").filter("text is not null").select("doc_id", text.paragraphs("text").alias("p")).filter(F.size("p") > 0)
    return p.select("doc_id", F.size("p").cast("bigint").alias("n_paragraphs"), F.aggregate("p", F.lit(0).cast("bigint"), lambda s, x: s + F.length(x)).alias("n_chars"))


@query(f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS BIGINT) AS unit_index, pos, n_chars FROM (
  SELECT doc_id, i, length(p) AS n_chars, CAST(coalesce(sum(length(p) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, {_PARAS} AS ps FROM documents WHERE text IS NOT NULL))) WHERE n_chars >= 20""")
def split_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    # Positions and numbers run inside one row's array: no shuffle.
    base = table(spark, d, "documents").filter("text is not null").select("doc_id", text.paragraphs("text").alias("p"))
    start = F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("no"), F.array().cast("array<struct<unit_index:bigint,pos:bigint,n_chars:bigint>>").alias("out"))

    def step(s, x):
        n = F.length(x).cast("bigint")
        keep = n >= 20
        row = F.array(F.struct(s["no"].alias("unit_index"), s["pos"].alias("pos"), n.alias("n_chars")))
        return F.struct((s["pos"] + n + 2).alias("pos"), (s["no"] + keep.cast("bigint")).alias("no"), F.when(keep, F.concat(s["out"], row)).otherwise(s["out"]).alias("out"))

    return base.select("doc_id", F.explode(F.aggregate("p", start, step, lambda s: s["out"])).alias("r")).select("doc_id", "r.*")


@query(f"SELECT doc_id, p AS paragraph FROM (SELECT doc_id, unnest({_PARAS}) AS p FROM documents WHERE text IS NOT NULL) WHERE NOT regexp_matches(lower(p), 'cookie|privacy|navigation') AND length(p) >= 100")
def filter_noise(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.explode(text.paragraphs("text")).alias("paragraph"))
    return rows.filter(~text.noise_paragraph("paragraph") & (F.length("paragraph") >= 100))


@query(f"SELECT chunk_key, CAST(len({_toks()}) AS BIGINT) AS n_tokens FROM chunks WHERE text <> '' AND len({_toks()}) >= 50")
def filter_minlen(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").filter("text <> ''").select("chunk_key", text.token_count("text").cast("bigint").alias("n_tokens")).filter("n_tokens >= 50")


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS snippet FROM documents")
def snippet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.snippet("text", 200).alias("snippet"))


@query(r"""SELECT doc_id, nullif(regexp_extract(title, '^([^:]+)', 1), '') AS company, nullif(regexp_extract(title, ': (.+)$', 1), '') AS topic, nullif(regexp_extract(text, 'fiscal (20[0-9][0-9])', 1), '') AS fiscal_year FROM documents""")
def header_extract(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return table(spark, d, "documents").select("doc_id", pick("title", "^([^:]+)").alias("company"), pick("title", ": (.+)$").alias("topic"), pick("text", "fiscal (20[0-9][0-9])").alias("fiscal_year"))


_W = ChunkConfig()


@query(f"""
WITH t AS (SELECT chunk_key, {_toks()} AS w, len({_toks()}) AS n FROM chunks), s AS (SELECT *, unnest(generate_series(0, CAST(greatest(0, ceil((n - 800) / 680.0)) AS BIGINT))) AS i FROM t WHERE n > 0)
SELECT chunk_key, i + 1 AS piece, i * 680 AS start_token, least(i * 680 + 800, n) AS end_token,
  CASE WHEN i > 0 THEN greatest(0, least((i - 1) * 680 + 800, n) - i * 680) ELSE 0 END AS overlap_with_prev,
  CASE WHEN (i + 1) * 680 < n AND i < ceil((n - 800) / 680.0) THEN greatest(0, least(i * 680 + 800, n) - (i + 1) * 680) ELSE 0 END AS overlap_with_next,
  array_to_string(list_slice(w, i * 680 + 1, least(i * 680 + 800, n)), ' ') AS text FROM s""")
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    out = chunking.window_chunks(table(spark, d, "chunks"), "chunk_key", "text", _W)
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("piece", "start_token", "end_token", "overlap_with_prev", "overlap_with_next")})


_SENT = r"list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 0)"


def _sizes(df: DataFrame) -> DataFrame:
    return df.filter("text is not null").select("doc_id", F.transform(text.sentences("text"), lambda s: text.token_count(s)).alias("n"))


@query(f"""
WITH RECURSIVE s AS (SELECT doc_id, list_transform({_SENT}, lambda y: CAST(len({_toks('y')}) AS BIGINT)) AS n FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, n, 1 AS i, 1 AS pack, n[1] AS c FROM s WHERE len(n) > 0
  UNION ALL SELECT doc_id, n, i + 1, CASE WHEN c + n[i + 1] < 100 OR c < 40 THEN pack ELSE pack + 1 END, CASE WHEN c + n[i + 1] < 100 OR c < 40 THEN c + n[i + 1] ELSE n[i + 1] END FROM r WHERE i < len(n))
SELECT doc_id, CAST(pack AS BIGINT) AS pack, count(*) AS n_units, CAST(sum(n[i]) AS BIGINT) AS n_tokens FROM r GROUP BY doc_id, pack""")
def pack_units(spark: SparkSession, d: str) -> DataFrame:
    """Sentences packed to 100 tokens, at least 40."""
    rows = _sizes(table(spark, d, "documents")).withColumn("p", chunking.pack("n", 100, 40))
    flat = rows.select("doc_id", F.explode(F.arrays_zip("n", "p")).alias("z"))
    return flat.groupBy("doc_id", F.col("z.p").cast("bigint").alias("pack")).agg(F.count(F.lit(1)).alias("n_units"), F.sum("z.n").cast("bigint").alias("n_tokens"))


@query(f"""
WITH RECURSIVE s AS (SELECT doc_id, list_transform({_SENT}, lambda y: CAST(len({_toks('y')}) AS BIGINT)) AS n FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, n, 1 AS i, 1 AS g, n[1] AS c FROM s WHERE len(n) > 0
  UNION ALL SELECT doc_id, n, i + 1, CASE WHEN c >= 30 THEN g + 1 ELSE g END, CASE WHEN c >= 30 THEN n[i + 1] ELSE c + n[i + 1] END FROM r WHERE i < len(n)),
l AS (SELECT doc_id, max(g) AS g, arg_max(c, i) AS c FROM r GROUP BY doc_id)
SELECT r.doc_id, CAST(CASE WHEN l.c < 30 AND r.g = l.g AND r.g > 1 THEN r.g - 1 ELSE r.g END AS BIGINT) AS grp, count(*) AS n_units, CAST(sum(n[i]) AS BIGINT) AS n_tokens FROM r JOIN l ON r.doc_id = l.doc_id GROUP BY 1, 2""")
def merge_small(spark: SparkSession, d: str) -> DataFrame:
    rows = _sizes(table(spark, d, "documents")).withColumn("p", chunking.merge_small("n", 30))
    flat = rows.select("doc_id", F.explode(F.arrays_zip("n", "p")).alias("z"))
    return flat.groupBy("doc_id", F.col("z.p").cast("bigint").alias("grp")).agg(F.count(F.lit(1)).alias("n_units"), F.sum("z.n").cast("bigint").alias("n_tokens"))


@query()
def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.semantic_chunks(table(spark, d, "documents"), "doc_id", "text")


_PAGE = "'<html><head><title>' || coalesce(title, '') || '</title><style>p {color: red}</style><script>var x = 1;</script></head><body><nav>Home</nav><h1>' || coalesce(title, 'Untitled') || '</h1><h2 class=\"s\">' || coalesce(source, '') || '</h2><p>' || regexp_replace(text, '[<>]', '', 'g') || '</p><footer>End</footer></body></html>'"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    e = lambda c, other="": F.coalesce(F.col(c), F.lit(other))
    page = F.concat(F.lit("<html><head><title>"), e("title"), F.lit("</title><style>p {color: red}</style><script>var x = 1;</script></head><body><nav>Home</nav><h1>"), e("title", "Untitled"), F.lit('</h1><h2 class="s">'), e("source"), F.lit("</h2><p>"), F.regexp_replace("text", "[<>]", ""), F.lit("</p><footer>End</footer></body></html>"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", page.alias("page"))


_CLEAN = "page"
for _t in ("script", "style", "nav", "header", "footer"):
    _CLEAN = f"regexp_replace({_CLEAN}, '(?is)<{_t}[^>]*>.*?</{_t}>', ' ', 'g')"


@query(f"SELECT doc_id, trim(regexp_replace(regexp_replace({_CLEAN}, '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS cleaned FROM (SELECT doc_id, {_PAGE} AS page FROM documents WHERE text IS NOT NULL)")
def html_clean(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("doc_id", html.html_clean("page").alias("cleaned"))


@query(f"SELECT doc_id, coalesce(nullif(trim(regexp_extract(page, '(?is)<title[^>]*>(.*?)</title>', 1)), ''), nullif(trim(regexp_extract(page, '(?is)<h1[^>]*>(.*?)</h1>', 1)), '')) AS title FROM (SELECT doc_id, {_PAGE} AS page FROM documents WHERE text IS NOT NULL)")
def html_title(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("doc_id", html.html_title("page").alias("title"))


_HEAD = "page"
for _n in range(1, 7):
    _HEAD = f"regexp_replace({_HEAD}, '(?is)<h{_n}[^>]*>(.*?)</h{_n}>', chr(10) || '{'#' * _n} \\1' || chr(10), 'g')"


@query(f"SELECT doc_id, regexp_extract_all(h, '(?m)^#+ .*$') AS headings FROM (SELECT doc_id, {_HEAD} AS h FROM (SELECT doc_id, {_PAGE} AS page FROM documents WHERE text IS NOT NULL))")
def html_headings(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("doc_id", F.regexp_extract_all(html.html_headings("page"), F.lit("(?m)^#+ .*$"), 0).alias("headings"))


@query()
def html_text(spark: SparkSession, d: str) -> DataFrame:
    """By the parser, not by expressions."""
    return _pages(spark, d).select("doc_id", html.html_text("page").alias("text"))


_CT = r"regexp_replace(text, '\r\n?', chr(10), 'g')"
_CT = rf"regexp_replace({_CT}, '(?m)^[ \t]*(?:page )?\d+(?: of \d+)?[ \t]*$', '', 'g')"
_CT = rf"trim(regexp_replace(regexp_replace({_CT}, '(?mi)^.*all rights reserved.*$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'))"


@query(f"SELECT chunk_key, {_CT} AS cleaned FROM chunks WHERE doc_type = 'earnings_transcript'")
def clean_transcript(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").filter("doc_type = 'earnings_transcript'").select("chunk_key", transcripts.clean_transcript("text").alias("cleaned"))


_INSTR = "nullif(coalesce(length(regexp_extract(lower(text), '(?s)^(.*?)(?:{p})', 1)) + 1, 0) * CAST(regexp_matches(lower(text), '{p}') AS BIGINT), 0)"


@query(f"SELECT chunk_key, coalesce({', '.join(_INSTR.format(p=p) for p in transcripts.QA_STARTS)}) AS qa_start FROM chunks WHERE text IS NOT NULL")
def detect_phase(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").filter("text is not null").select("chunk_key", transcripts.qa_start("text").cast("bigint").alias("qa_start"))


@query(r"SELECT chunk_key, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?m)^([A-Z][a-z]+(?: [A-Z][a-z]+)+)(?: --[^:\n]*| \([^)\n]*\))?:', 1))), ';') AS names FROM chunks WHERE text IS NOT NULL")
def extract_speakers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").filter("text is not null").select("chunk_key", F.array_join(F.sort_array(transcripts.speakers("text")), ";").alias("names"))


_LABEL = r"(?m)^([A-Z][a-z]+(?: [A-Z][a-z]+)+)(?: --[^:\n]*| \([^)\n]*\))?:"
_QA_AT = " , ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN length(regexp_extract(lower(text), '(?s)^(.*?)(?:{p})', 1)) + 1 END" for p in ("question[- ]and[- ]answer", "q\\s*&\\s*a session", "first question", "open (?:up )?the (?:call|line|floor) (?:for|to) questions"))
_UTTERANCES = f"""WITH m AS (SELECT chunk_key, coalesce({_QA_AT}) AS qa, string_split(regexp_replace(text, '{_LABEL}', chr(1) || '\\0', 'g'), chr(1)) AS ps FROM chunks WHERE doc_type = 'earnings_transcript' AND text IS NOT NULL),
u AS (SELECT chunk_key, qa, ps, unnest(range(1, len(ps))) AS idx FROM m),
v AS (SELECT chunk_key, qa, idx, regexp_extract(ps[idx + 1], '{_LABEL}', 1) AS speaker, coalesce(list_sum(list_transform(ps[1:idx], lambda x: length(x))), 0) + 1 AS position, trim(regexp_replace(regexp_replace(ps[idx + 1], '{_LABEL}', ''), '\s+', ' ', 'g'), ' ') AS said FROM u)
SELECT chunk_key, CAST(idx AS INTEGER) AS idx, speaker, CAST(position AS INTEGER) AS position, CASE WHEN position >= qa THEN 'qa' ELSE 'prepared_remarks' END AS phase, CASE WHEN qa IS NULL OR position < qa THEN 'statement' WHEN contains(said, '?') THEN 'question' ELSE 'answer' END AS utterance_type, said AS text FROM v WHERE length(said) >= 10"""


@query(_UTTERANCES)
def parse_utterances(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.utterances(table(spark, d, "chunks").filter("doc_type = 'earnings_transcript'"), "chunk_key", "text")


_SECT = " UNION ALL ".join(f"SELECT doc_id, length(text) AS n, '{i}' AS section_id, '{t}' AS title, coalesce(length(regexp_extract(lower(text), '(?s)^(.*?)(?:{p})', 1)) + 1, 0) * CAST(regexp_matches(lower(text), '{p}') AS BIGINT) AS position FROM documents WHERE text IS NOT NULL".replace("{p}", p) for i, t, p in transcripts.SECTIONS)


@query(f'SELECT doc_id, section_id, title, position, coalesce(lead(position) OVER (PARTITION BY doc_id ORDER BY position, section_id) - 1, n) AS "end" FROM ({_SECT}) WHERE position > 0')
def detect_sections(spark: SparkSession, d: str) -> DataFrame:
    out = transcripts.sections(table(spark, d, "documents").filter("text is not null"), "doc_id", "text")
    return out.withColumns({"position": F.col("position").cast("bigint"), "end": F.col("end").cast("bigint")})


_SECT_ENDS = f"SELECT doc_id, section_id, title, position, coalesce(lead(position) OVER (PARTITION BY doc_id ORDER BY position, section_id) - 1, n) AS last FROM ({_SECT}) WHERE position > 0"


def _section_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", "text")
    found = transcripts.sections(docs, "doc_id", "text")
    return found.join(docs, "doc_id").withColumn("content", F.substring("text", F.col("position"), F.col("end") - F.col("position") + 1))


@query(f"SELECT s.doc_id, section_id, substr(text, position, last - position + 1) AS content FROM ({_SECT_ENDS}) s JOIN documents dd ON dd.doc_id = s.doc_id")
def extract_sections(spark: SparkSession, d: str) -> DataFrame:
    return _section_texts(spark, d).select("doc_id", "section_id", "content")


@query(f"SELECT s.doc_id, string_agg('### ' || s.title || ' ###' || chr(10) || substr(text, position, last - position + 1), chr(10) || chr(10) ORDER BY position, section_id) AS joined FROM ({_SECT_ENDS}) s JOIN documents dd ON dd.doc_id = s.doc_id GROUP BY s.doc_id")
def concat_sections(spark: SparkSession, d: str) -> DataFrame:
    block = F.concat(F.lit("### "), "title", F.lit(" ###\n"), "content")
    rows = _section_texts(spark, d).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("position", "section_id", block.alias("b")))).alias("s"))
    return rows.select("doc_id", F.array_join(F.transform("s", lambda x: x["b"]), "\n\n").alias("joined"))


_SPLIT_AT = f"coalesce({', '.join(_INSTR.format(p=p) for p in transcripts.QA_STARTS)})"


@query(f"SELECT chunk_key, phase, block FROM (SELECT chunk_key, unnest(['prepared_remarks', 'qa']) AS phase, unnest([CASE WHEN s IS NULL THEN text ELSE substr(text, 1, s - 1) END, CASE WHEN s IS NULL THEN '' ELSE substr(text, s) END]) AS block FROM (SELECT chunk_key, text, {_SPLIT_AT} AS s FROM chunks WHERE doc_type = 'earnings_transcript' AND text IS NOT NULL)) WHERE block <> ''")
def split_transcript(spark: SparkSession, d: str) -> DataFrame:
    """A transcript's two phases, the second beginning with the words that open it."""
    c = table(spark, d, "chunks").filter("doc_type = 'earnings_transcript' and text is not null").select("chunk_key", "text", transcripts.qa_start("text").alias("s"))
    before, after = F.when(F.col("s").isNull(), F.col("text")).otherwise(F.substring("text", 1, F.col("s") - 1)), F.when(F.col("s").isNull(), "").otherwise(F.expr("substring(text, s)"))
    rows = c.select("chunk_key", F.explode(F.array(F.struct(F.lit("prepared_remarks").alias("phase"), before.alias("block")), F.struct(F.lit("qa").alias("phase"), after.alias("block")))).alias("r"))
    return rows.select("chunk_key", "r.*").filter("block <> ''")


_ITEM = r"rtrim(regexp_replace(regexp_replace(x, '[<>&]', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'), ' ')"


@query(f"SELECT doc_id, array_to_string(list_transform({_SENT}, lambda x, i: i || '. ' || {_ITEM}), chr(10) || chr(10)) AS text FROM documents WHERE text IS NOT NULL")
def html_lists(spark: SparkSession, d: str) -> DataFrame:
    """Ordered and bulleted lists by the parser, over pages made of each document's sentences."""
    items = F.transform(text.sentences("text"), lambda s: F.concat(F.lit("<li>"), F.regexp_replace(s, "[<>&]", " "), F.lit("</li>")))
    page = F.concat(F.lit("<ol>"), F.array_join(items, ""), F.lit("</ol>"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", html.html_text(page).alias("text"))


@query(f"SELECT doc_id, CASE WHEN length(b) > 500 THEN b END AS main FROM (SELECT doc_id, trim(regexp_replace(regexp_replace({_CLEAN}, '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS b FROM (SELECT doc_id, regexp_extract({_PAGE}, '(?is)<body[^>]*>(.*?)</body>', 1) AS page FROM documents WHERE text IS NOT NULL))")
def html_main_text(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("doc_id", html.main_text(F.col("page")).alias("main"))


@query()
def stem_terms(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of Porter stems; the distinct terms are stemmed, not the texts."""
    index = lexical.build_index(table(spark, d, "documents"), "doc_id", "text")
    terms = index.postings.groupBy("term").agg(F.sum("tf").alias("n"))
    return terms.select(F.element_at(stems(F.array("term")), 1).alias("stem"), "n").groupBy("stem").agg(F.sum("n").alias("occurrences"))


@query()
def parse_filing(spark: SparkSession, d: str) -> DataFrame:
    """Units of the documents' pages."""
    meta = table(spark, d, "documents").select("doc_id", "ticker", F.lit("10-K").alias("form_type"), F.year("published_at").alias("fiscal_year"), F.lit("FY").alias("quarter"), F.col("published_at").cast("date").cast("string").alias("filing_date"), F.col("source").alias("source_file"))
    pages = _pages(spark, d).join(meta, "doc_id").withColumn("doc_id", F.col("doc_id").cast("string"))
    return units.filing_units(pages, "page")


@query(f"SELECT chunk_key, regexp_replace(text, '{_LABEL}', '[SPEAKER: \\1]', 'g') AS tagged FROM chunks WHERE doc_type = 'earnings_transcript'")
def tag_speakers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").filter("doc_type = 'earnings_transcript'").select("chunk_key", transcripts.tag_speakers("text").alias("tagged"))


_FORM_SQL = r"""WITH p(form, section, pattern) AS (VALUES
  ('10-K', 'Item 1', '(?i)ITEM\s*1[A-Z]?\b\.?\s*[-–—]?\s*BUSINESS'), ('10-K', 'Item 1A', '(?i)ITEM\s*1A\b\.?\s*[-–—]?\s*RISK\s+FACTORS'), ('10-K', 'Item 1B', '(?i)ITEM\s*1B\b\.?\s*[-–—]?\s*UNRESOLVED\s+STAFF'),
  ('10-K', 'Item 2', '(?i)ITEM\s*2\b\.?\s*[-–—]?\s*PROPERTIES'), ('10-K', 'Item 3', '(?i)ITEM\s*3\b\.?\s*[-–—]?\s*LEGAL\s+PROCEEDINGS'), ('10-K', 'Item 4', '(?i)ITEM\s*4\b\.?\s*[-–—]?\s*MINE\s+SAFETY'),
  ('10-K', 'Item 5', '(?i)ITEM\s*5\b\.?\s*[-–—]?\s*MARKET\s+FOR'), ('10-K', 'Item 6', '(?i)ITEM\s*6\b\.?\s*[-–—]?\s*(?:SELECTED|RESERVED)'), ('10-K', 'Item 7', '(?i)ITEM\s*7[A-Z]?\b\.?\s*[-–—]?\s*MANAGEMENT[''’]?S?\s+DISCUSSION'),
  ('10-K', 'Item 7A', '(?i)ITEM\s*7A\b\.?\s*[-–—]?\s*QUANTITATIVE\s+AND\s+QUALITATIVE'), ('10-K', 'Item 8', '(?i)ITEM\s*8\b\.?\s*[-–—]?\s*FINANCIAL\s+STATEMENTS'), ('10-K', 'Item 9', '(?i)ITEM\s*9[ABC]?\b\.?\s*[-–—]?\s*(?:CHANGES\s+IN|CONTROLS|DISCLOSURE)'),
  ('10-K', 'Item 10', '(?i)ITEM\s*10\b\.?\s*[-–—]?\s*DIRECTORS'), ('10-K', 'Item 11', '(?i)ITEM\s*11\b\.?\s*[-–—]?\s*EXECUTIVE\s+COMPENSATION'), ('10-K', 'Item 12', '(?i)ITEM\s*12\b\.?\s*[-–—]?\s*SECURITY\s+OWNERSHIP'),
  ('10-K', 'Item 13', '(?i)ITEM\s*13\b\.?\s*[-–—]?\s*CERTAIN\s+RELATIONSHIPS'), ('10-K', 'Item 14', '(?i)ITEM\s*14\b\.?\s*[-–—]?\s*PRINCIPAL\s+(?:ACCOUNTANT|ACCOUNTING)'), ('10-K', 'Item 15', '(?i)ITEM\s*15\b\.?\s*[-–—]?\s*EXHIBITS'), ('10-K', 'Item 16', '(?i)ITEM\s*16\b\.?\s*[-–—]?\s*FORM\s+10-K'),
  ('10-Q', 'Part I', '(?i)PART\s+I\.?\s*[-–—]?\s*FINANCIAL\s+INFORMATION'), ('10-Q', 'Item 1', '(?i)ITEM\s*1\b\.?\s*[-–—]?\s*FINANCIAL\s+STATEMENTS'), ('10-Q', 'Item 2', '(?i)ITEM\s*2\b\.?\s*[-–—]?\s*MANAGEMENT[''’]?S?\s+DISCUSSION'),
  ('10-Q', 'Item 3', '(?i)ITEM\s*3\b\.?\s*[-–—]?\s*QUANTITATIVE\s+AND\s+QUALITATIVE'), ('10-Q', 'Item 4', '(?i)ITEM\s*4\b\.?\s*[-–—]?\s*CONTROLS\s+AND\s+PROCEDURES'), ('10-Q', 'Part II', '(?i)PART\s+II\.?\s*[-–—]?\s*OTHER\s+INFORMATION'),
  ('10-Q', 'Item 1A', '(?i)ITEM\s*1A\b\.?\s*[-–—]?\s*RISK\s+FACTORS'), ('10-Q', 'Item 5', '(?i)ITEM\s*5\b\.?\s*[-–—]?\s*OTHER\s+INFORMATION'), ('10-Q', 'Item 6', '(?i)ITEM\s*6\b\.?\s*[-–—]?\s*EXHIBITS')),
d AS (SELECT doc_id, doc_type, '=' || text || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Item 1. Financial Statements ' || text || ' ITEM 2 - Management’s Discussion' || chr(10) || text || 'Part II. Other Information' ELSE 'ITEM 1. BUSINESS ' || text || ' Item 1A. Risk Factors' || chr(10) || text || ' Item 9B. Controls' END AS page FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, section, page, length(string_split_regex(page, pattern)[1]) + 1 AS position FROM d JOIN p ON p.form = d.doc_type WHERE regexp_matches(page, pattern)),
f AS (SELECT * FROM h UNION ALL SELECT doc_id, 'FULL', page, 1 FROM d WHERE doc_id NOT IN (SELECT doc_id FROM h))
SELECT doc_id, section, CAST(position AS BIGINT) AS position, md5(substr(page, position, coalesce(lead(position) OVER (PARTITION BY doc_id ORDER BY position, section) - position, length(page)))) AS content FROM f"""


@query(_FORM_SQL)
def filing_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections by form over pages made of the documents' texts and some of their form's headings."""
    t, n = F.col("text"), F.lit("\n")
    q = F.concat(F.lit("Item 1. Financial Statements "), t, F.lit(" ITEM 2 - Management’s Discussion"), n, t, F.lit("Part II. Other Information"))
    k = F.concat(F.lit("ITEM 1. BUSINESS "), t, F.lit(" Item 1A. Risk Factors"), n, t, F.lit(" Item 9B. Controls"))
    pages = table(spark, d, "documents").filter("text is not null").select("doc_id", "doc_type", F.concat(F.lit("="), t, n, F.when(F.col("doc_id") % 2 == 0, q).otherwise(k)).alias("page"))
    return transcripts.form_sections(pages, "doc_id", "page", "doc_type").select("doc_id", "section", F.col("position").cast("bigint").alias("position"), F.md5("content").alias("content"))
