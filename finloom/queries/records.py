"""Records: keys from names, catalogues, dimensions, enrichment, validation, transcripts' order, metric series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finloom.functions import text
from finloom.operators import analytics, chunking, records, transcripts
from finloom.plans.runtime import scratch, spread, table
from finloom.queries import query
from finloom.queries.text import _toks
from finloom.schemas import CHUNK_REQUIRED, CHUNK_SCHEMA, CHUNK_TYPES, DOC_TYPES, PHASES, QUARTERS, SPEAKER_ROLES, UNIT_SCHEMA
from finloom.sources import sinks
from finloom.streaming import ingest

big = lambda *cs: {c: F.col(c).cast("bigint") for c in cs}


@query(r"""SELECT chunk_key, regexp_extract(source_uri, '^data/([^/]+)/', 1) AS source, regexp_extract(source_uri, '^data/[^/]+/([^/]+)/', 1) AS ticker_key, string_split(source_uri, '/')[-1] AS file, regexp_extract(source_uri, '(20[0-9][0-9])', 1) AS year_key FROM chunks""")
def path_keys(spark: SparkSession, d: str) -> DataFrame:
    u = "source_uri"
    return table(spark, d, "chunks").select("chunk_key", F.regexp_extract(u, "^data/([^/]+)/", 1).alias("source"), F.regexp_extract(u, "^data/[^/]+/([^/]+)/", 1).alias("ticker_key"), text.file_name(u).alias("file"), F.regexp_extract(u, "(20[0-9][0-9])", 1).alias("year_key"))


@query(r"""SELECT chunk_key, nullif(regexp_extract(b, p, 1), '') AS file_ticker, CAST(nullif(regexp_extract(b, p, 2), '') AS BIGINT) AS file_year, CAST(nullif(regexp_extract(b, p, 3), '') AS BIGINT) AS file_quarter FROM (
  SELECT chunk_key, regexp_replace(regexp_replace(string_split(source_uri, '/')[-1], '\.[A-Za-z]+$', ''), '_[0-9]+$', '') AS b, '^([A-Z.]+)_FY(\d{4})_Q([1-4])$' AS p FROM chunks)""")
def filename_parse(spark: SparkSession, d: str) -> DataFrame:
    base = F.regexp_replace(F.regexp_replace(text.file_name("source_uri"), "\\.[A-Za-z]+$", ""), "_[0-9]+$", "")
    return table(spark, d, "chunks").select("chunk_key", text.fiscal_file(base).alias("f")).select("chunk_key", F.col("f.ticker").alias("file_ticker"), F.col("f.fiscal_year").cast("bigint").alias("file_year"), F.col("f.quarter").cast("bigint").alias("file_quarter"))


@query("SELECT doc_id, saved_at, CASE WHEN contains(raw_file, '10-K') THEN 'FY' ELSE coalesce('Q' || nullif(regexp_extract(raw_file, 'Q([1-4])', 1), ''), 'Q1') END AS quarter_key FROM filings")
def quarter_from_name(spark: SparkSession, d: str) -> DataFrame:
    q = F.when(F.col("raw_file").contains("10-K"), "FY").otherwise(F.coalesce(F.concat(F.lit("Q"), F.nullif(F.regexp_extract("raw_file", "Q([1-4])", 1), F.lit(""))), F.lit("Q1")))
    return table(spark, d, "filings").select("doc_id", "saved_at", q.alias("quarter_key"))


@query("""SELECT chunk_key, ticker || '_' || replace(doc_type, '-', '') || '_' || fiscal_year || CASE WHEN doc_type = '10-Q' THEN '_' || quarter ELSE '' END AS doc_key, fiscal_year || '-' || coalesce(quarter, 'FY') AS period_key, format('{}_u_{:04d}', doc_id, chunk_key % 10000) AS unit_id FROM chunks""")
def derive_ids(spark: SparkSession, d: str) -> DataFrame:
    doc = F.concat(F.col("ticker"), F.lit("_"), F.replace("doc_type", F.lit("-"), F.lit("")), F.lit("_"), F.col("fiscal_year").cast("string"), F.when(F.col("doc_type") == "10-Q", F.concat(F.lit("_"), "quarter")).otherwise(""))
    return table(spark, d, "chunks").select("chunk_key", doc.alias("doc_key"), text.period("fiscal_year", "quarter").alias("period_key"), F.format_string("%s_u_%04d", "doc_id", F.col("chunk_key") % 10000).alias("unit_id"))


@query("SELECT ticker, lpad(cast(cast(cik AS BIGINT) AS VARCHAR), 10, '0') AS cik10 FROM filings WHERE cik IS NOT NULL GROUP BY ALL")
def lpad_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "filings").filter("cik is not null").select("ticker", F.lpad(F.col("cik").cast("bigint").cast("string"), 10, "0").alias("cik10")).distinct()


@query("SELECT doc_id, form_type, filing_date FROM filings WHERE form_type IN ('10-K')")
def arrays_zip_explode(spark: SparkSession, d: str) -> DataFrame:
    """Columnar arrays of a company's filings, zipped back to rows and filtered by form."""
    nul = lambda c: F.coalesce(F.col(c), F.lit(""))
    s = F.sort_array(F.collect_list(F.struct("doc_id", "saved_at", "form_type", nul("filing_date").alias("filing_date"))))
    field = lambda c: F.transform("s", lambda x: x[c]).alias(c)
    cols = table(spark, d, "filings").groupBy("ticker").agg(s.alias("s")).select(*map(field, ("doc_id", "form_type", "filing_date")))
    rows = cols.select(F.explode(F.arrays_zip("doc_id", "form_type", "filing_date")).alias("z")).select("z.*")
    return rows.filter(F.col("form_type").isin("10-K")).withColumn("filing_date", F.nullif("filing_date", F.lit("")))


@query("SELECT doc_id, ticker, fiscal_year, source_file, saved_at FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY saved_at DESC, source_file) AS rn FROM calls) WHERE rn = 1")
def upsert_calls(spark: SparkSession, d: str) -> DataFrame:
    return records.upsert(table(spark, d, "calls"), ["doc_id"], [F.col("saved_at").desc(), F.col("source_file").asc_nulls_last()]).select("doc_id", "ticker", "fiscal_year", "source_file", "saved_at")


@query("SELECT doc_id, ticker, form_type, filing_date, saved_at FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY saved_at DESC, filing_date) AS rn FROM filings) WHERE rn = 1")
def upsert_filings(spark: SparkSession, d: str) -> DataFrame:
    return records.upsert(table(spark, d, "filings"), ["doc_id"], [F.col("saved_at").desc(), F.col("filing_date").asc_nulls_last()]).select("doc_id", "ticker", "form_type", "filing_date", "saved_at")


@query("SELECT chunk_id, max(chunked_at) AS chunked_at, count(*) AS n_rows FROM chunks GROUP BY chunk_id")
def dedupe_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Re-ingested chunks: the last one wins."""
    return table(spark, d, "chunks").groupBy("chunk_id").agg(F.max("chunked_at").alias("chunked_at"), F.count(F.lit(1)).alias("n_rows"))


@query("SELECT doc_id, saved_at, CASE WHEN form_type = '10-Q' THEN true ELSE rag_ingested END AS rag_ingested FROM filings")
def mark_ingested(spark: SparkSession, d: str) -> DataFrame:
    return records.mark_ingested(table(spark, d, "filings"), F.col("form_type") == "10-Q").select("doc_id", "saved_at", "rag_ingested")


@query("SELECT c.ticker, coalesce(f.cik, c.cik) AS cik FROM companies c LEFT JOIN (SELECT ticker, max(lpad(cik, 10, '0')) AS cik FROM filings GROUP BY ticker) f ON c.ticker = f.ticker")
def cik_update(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "filings").groupBy("ticker").agg(F.max(F.lpad("cik", 10, "0")).alias("cik"))
    return records.update_missing(table(spark, d, "companies"), new, "ticker", "cik").select("ticker", "cik")


@query("SELECT f.doc_id, f.saved_at, c.company_name, c.sector FROM filings f LEFT JOIN companies c ON f.ticker = c.ticker")
def dim_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "filings").select("doc_id", "saved_at", "ticker").join(table(spark, d, "companies"), "ticker", "left").select("doc_id", "saved_at", "company_name", "sector")


@query("SELECT sector, count(DISTINCT industry) AS industries, count(*) AS companies FROM companies GROUP BY sector")
def distinct_dim(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "companies").groupBy("sector").agg(F.countDistinct("industry").alias("industries"), F.count(F.lit(1)).alias("companies"))


@query("SELECT ticker, company_name, sector FROM companies WHERE upper(sector) = 'TECHNOLOGY' OR upper(ticker) = 'ZNLN'")
def lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "companies").filter((F.upper("sector") == "TECHNOLOGY") | (F.upper("ticker") == "ZNLN")).select("ticker", "company_name", "sector")


@query("SELECT ticker, doc_id, filing_date, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC NULLS LAST, doc_id, saved_at) AS rank FROM filings) WHERE rank <= 3")
def topn_per_group(spark: SparkSession, d: str) -> DataFrame:
    out = records.top_per_group(table(spark, d, "filings"), ["ticker"], [F.col("filing_date").desc_nulls_last(), F.col("doc_id"), F.col("saved_at")], 3)
    return out.select("ticker", "doc_id", "filing_date", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT ticker, count(*) AS files FROM (SELECT DISTINCT ticker, source_uri FROM chunks) GROUP BY ticker")
def files_per_company(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("ticker", "source_uri").distinct().groupBy("ticker").agg(F.count(F.lit(1)).alias("files"))


@query("SELECT doc_id, saved_at, CAST(unnest(generate_series(0, 3)) AS BIGINT) AS back, date_trunc('quarter', CAST(filing_date AS DATE)) - to_months(CAST(3 * unnest(generate_series(0, 3)) AS INTEGER)) AS q FROM filings WHERE filing_date IS NOT NULL".replace(" AS q FROM", " AS quarter_start FROM"))
def recent_quarters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "filings").filter("filing_date is not null").select("doc_id", "saved_at", F.posexplode(records.recent_quarters(F.col("filing_date").cast("date"), 4)).alias("back", "quarter_start"))
    return rows.withColumn("back", F.col("back").cast("bigint")).withColumn("quarter_start", F.col("quarter_start").cast("timestamp_ntz"))


_CATS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in records.CATEGORIES.items())


@query(f"SELECT chunk_key, CASE regexp_extract(lower(coalesce(section_title, '')), '([a-z&]+)', 1) {_CATS} ELSE 'other' END AS category FROM chunks")
def categorize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_key", records.category("section_title").alias("category"))


@query("""SELECT chunk_key, coalesce(nullif(ticker, ''), first_value(nullif(ticker, '') IGNORE NULLS) OVER w, 'UNKNOWN') AS ticker, coalesce(nullif(phase, ''), first_value(nullif(phase, '') IGNORE NULLS) OVER w, 'qa') AS phase
  FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_key ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def enrich_transcripts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("chunk_key", "doc_id", "ticker", "phase")
    return records.fill_missing(c, ["doc_id"], "chunk_key", {"ticker": F.lit("UNKNOWN"), "phase": F.lit("qa")}).select("chunk_key", "ticker", "phase")


@query("""SELECT doc_id, saved_at, coalesce(nullif(filing_date, ''), first_value(nullif(filing_date, '') IGNORE NULLS) OVER w, fiscal_year || '-12-31') AS filing_date, coalesce(nullif(raw_file, ''), first_value(nullif(raw_file, '') IGNORE NULLS) OVER w, 'unknown') AS raw_file
  FROM filings WINDOW w AS (PARTITION BY doc_id ORDER BY saved_at ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def enrich_filings(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "filings").select("doc_id", "saved_at", "filing_date", "raw_file", "fiscal_year")
    return records.fill_missing(f, ["doc_id"], "saved_at", {"filing_date": F.concat(F.col("fiscal_year").cast("string"), F.lit("-12-31")), "raw_file": F.lit("unknown")}).drop("fiscal_year")


_ROLE = "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(speaker_role, '')), '{p}') THEN '{n}'" for n, p in transcripts.ROLES) + " ELSE 'unknown' END"


@query(f"SELECT chunk_key, {_ROLE} AS role FROM chunks")
def classify_role(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_key", transcripts.role("speaker_role").alias("role"))


@query(r"SELECT DISTINCT trim(regexp_replace(regexp_replace(k, '\s+', ' ', 'g'), '(?i)^(?:mr|mrs|ms|dr|prof)\.?\s+', '')) AS name, v AS listed FROM (SELECT unnest(map_entries(speakers)).key AS k, unnest(map_entries(speakers)).value AS v FROM calls WHERE speakers IS NOT NULL)")
def normalize_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "calls").select(F.explode("speakers").alias("k", "v")).select(transcripts.clean_name("k").alias("name"), F.col("v").alias("listed")).distinct()


_U = "u AS (SELECT doc_id, chunk_id, chunk_key, speaker, speaker_role, text, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id, chunk_key) AS idx FROM chunks WHERE doc_type = 'earnings_transcript')"


def _units(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").filter("doc_type = 'earnings_transcript'").select("doc_id", "chunk_id", "chunk_key", "speaker", "speaker_role", "text")
    return c.withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id", "chunk_key")))


@query(f"WITH {_U}, l AS (SELECT *, CASE WHEN idx > 1 AND speaker IS NOT DISTINCT FROM lag(speaker) OVER (PARTITION BY doc_id ORDER BY idx) THEN 0 ELSE 1 END AS new FROM u) SELECT doc_id, chunk_key, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY idx) AS BIGINT) AS run FROM l")
def speaker_runs(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.runs(_units(spark, d), ["doc_id"], "idx", "speaker").select("doc_id", "chunk_key", F.col("run").cast("bigint").alias("run"))


_EX = f"""WITH {_U}, a AS (SELECT *, coalesce(lower(speaker_role) = 'analyst', false) AS q, coalesce(lower(speaker_role) IN ('ceo', 'cfo', 'chief executive officer', 'chief financial officer'), false) AS a FROM u),
b AS (SELECT *, sum(CAST(q AS INT)) OVER (PARTITION BY doc_id ORDER BY idx) AS ex FROM a), c AS (SELECT *, sum(CAST(a AS INT)) OVER (PARTITION BY doc_id, ex ORDER BY idx) AS n FROM b),
e AS (SELECT doc_id, chunk_key, idx, text, ex, CASE WHEN q THEN 'question' WHEN a AND n = 1 AND ex > 0 THEN 'answer' END AS exchange_role FROM c)"""


def _exchanges(spark: SparkSession, d: str) -> DataFrame:
    r = F.lower("speaker_role")
    return transcripts.exchanges(_units(spark, d), "doc_id", "idx", r == "analyst", r.isin("ceo", "cfo", "chief executive officer", "chief financial officer"))


@query(_EX + " SELECT chunk_key, exchange_role, CASE WHEN exchange_role IS NOT NULL THEN CAST(ex AS BIGINT) END AS exchange_no FROM e")
def qa_exchanges(spark: SparkSession, d: str) -> DataFrame:
    return _exchanges(spark, d).select("chunk_key", "exchange_role", F.col("exchange_no").cast("bigint").alias("exchange_no"))


@query(_EX + " SELECT doc_id, CAST(ex AS BIGINT) AS exchange_no, count(*) AS n_units, string_agg(CAST(chunk_key AS VARCHAR), ',' ORDER BY idx) AS members FROM e WHERE exchange_role IS NOT NULL GROUP BY doc_id, ex")
def group_exchange(spark: SparkSession, d: str) -> DataFrame:
    rows = _exchanges(spark, d).filter("exchange_no is not null").groupBy("doc_id", F.col("exchange_no").cast("bigint").alias("exchange_no"))
    return rows.agg(F.count(F.lit(1)).alias("n_units"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "chunk_key"))), lambda x: x["chunk_key"].cast("string")), ",").alias("members"))


@query(f"WITH {_U} SELECT doc_id, string_agg(text, ' ' ORDER BY idx) AS text, count(*) AS n_units FROM u WHERE text <> '' GROUP BY doc_id")
def combine_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = _units(spark, d).filter("text <> ''").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", "text"))).alias("s"))
    return rows.select("doc_id", F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"), F.size("s").cast("bigint").alias("n_units"))


@query(f"""WITH {_U.replace("WHERE doc_type = 'earnings_transcript'", "").replace("speaker, speaker_role", "section_title")}, l AS (SELECT *, CASE WHEN idx > 1 AND section_title IS NOT DISTINCT FROM lag(section_title) OVER (PARTITION BY doc_id ORDER BY idx) THEN '' ELSE '## ' || coalesce(section_title, 'FULL') || chr(10) || chr(10) END AS head FROM u)
SELECT doc_id, string_agg(head || coalesce(text, ''), chr(10) || chr(10) ORDER BY idx) AS markdown FROM l GROUP BY doc_id""")
def export_markdown(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id", "chunk_key")))
    return transcripts.export_markdown(c, "doc_id", "section_title", "idx", "text")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM events")
def section_asof(spark: SparkSession, d: str) -> DataFrame:
    """Each position gets the last section opened at or before it."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.struct("ts", "event_id").alias("o"))
    return transcripts.label_asof(e, ["user_id"], "o", F.when(F.col("event_type") == "signup", F.col("event_id")), "section").select("event_id", "section")


def _tokens_true(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "chunks").select("chunk_type", "section_title", "phase", "text")).withColumn("n", text.token_count("text").cast("bigint"))


_STATS = "count(*) AS n, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, median(n) AS median, CAST(sum(n) AS BIGINT) AS total"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("mean", F.round("mean", 6))


@query(f"SELECT chunk_type, {_STATS} FROM (SELECT chunk_type, CAST(len({_toks()}) AS BIGINT) AS n FROM chunks) GROUP BY chunk_type")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(analytics.token_statistics(_tokens_true(spark, d), ["chunk_type"], "n").withColumnRenamed("n", "n"))


@query(f"SELECT coalesce(section_title, phase, 'none') AS part, {_STATS} FROM (SELECT section_title, phase, CAST(len({_toks()}) AS BIGINT) AS n FROM chunks) GROUP BY 1")
def chunk_stats_by_part(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(analytics.token_statistics(_tokens_true(spark, d).withColumn("part", F.coalesce("section_title", "phase", F.lit("none"))), ["part"], "n"))


@query("SELECT count_if(overlap_with_prev > 0) AS with_prev, count_if(overlap_with_next > 0) AS with_next, round(avg(CASE WHEN overlap_with_prev > 0 THEN overlap_with_prev END), 6) AS mean_prev FROM chunks")
def overlap_stats(spark: SparkSession, d: str) -> DataFrame:
    p, n = F.col("overlap_with_prev"), F.col("overlap_with_next")
    return table(spark, d, "chunks").agg(F.count_if(p > 0).alias("with_prev"), F.count_if(n > 0).alias("with_next"), F.round(F.avg(F.when(p > 0, p)), 6).alias("mean_prev"))


def _enum(col: str, values: list[str]) -> str:
    return f"CASE WHEN {col} IS NOT NULL AND {col} NOT IN ({', '.join(repr(v) for v in values)}) THEN 'enum: {col}=' || {col} END"


_ERR = ", ".join(
    [f"CASE WHEN {c} IS NULL THEN 'missing: {c}' END" for c in CHUNK_REQUIRED]
    + [_enum(c, v) for c, v in (("doc_type", DOC_TYPES), ("quarter", QUARTERS), ("chunk_type", CHUNK_TYPES), ("phase", PHASES), ("speaker_role", SPEAKER_ROLES))]
    + [f"CASE WHEN doc_type IN ('10-K', '10-Q') AND {c} IS NOT NULL THEN 'family: {c}' END" for c in ("speaker", "phase")]
    + ["CASE WHEN doc_type = 'earnings_transcript' AND section_id IS NOT NULL THEN 'family: section_id' END", "CASE WHEN trim(text) = '' THEN 'text: blank' END", "CASE WHEN NOT regexp_matches(chunk_id, '_chunk_[0-9]{4,}$') THEN 'chunk_id: form' END", "CASE WHEN chunk_tokens < 100 THEN 'tokens: few' END", "CASE WHEN chunk_tokens > 800 THEN 'tokens: many' END"]
    + ["CASE WHEN chunk_type = 'windowed_overlap' AND end_token - start_token <> chunk_tokens THEN 'window: span' END", "CASE WHEN chunk_type = 'windowed_overlap' AND overlap_with_prev IS NULL THEN 'overlap: missing' END", "CASE WHEN overlap_with_prev >= chunk_tokens THEN 'overlap: size' END"]
)
_ERR = f"list_filter([{_ERR}], lambda x: x IS NOT NULL)"


@query(f"SELECT chunk_key, array_to_string({_ERR}, '; ') AS errors FROM chunks")
def validate_chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_key", F.array_join(records.chunk_errors(columns=CHUNK_SCHEMA.names), "; ").alias("errors"))


@query(f"SELECT kind, count(*) AS n FROM (SELECT unnest(CASE WHEN len(e) = 0 THEN ['valid'] ELSE list_transform(e, lambda x: string_split(x, ':')[1]) END) AS kind FROM (SELECT {_ERR} AS e FROM chunks)) GROUP BY kind")
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    return records.error_report(table(spark, d, "chunks"), records.chunk_errors(columns=CHUNK_SCHEMA.names))


@query("""SELECT chunk_key, list_filter([CASE WHEN doc_id IS NULL THEN 'missing: doc_id' END, CASE WHEN chunk_id IS NULL THEN 'missing: chunk_id' END, CASE WHEN ticker IS NULL THEN 'missing: ticker' END, CASE WHEN company IS NULL THEN 'missing: company' END, CASE WHEN doc_type IS NULL THEN 'missing: doc_type' END,
  CASE WHEN fiscal_year IS NULL THEN 'missing: fiscal_year' END, CASE WHEN quarter IS NULL THEN 'missing: quarter' END, CASE WHEN period IS NULL THEN 'missing: period' END, 'missing: filing_date', 'missing: unit_type', 'missing: unit_index', CASE WHEN text IS NULL THEN 'missing: text' END, 'missing: char_count', 'missing: word_count', 'missing: source_file', 'missing: parsed_at',
  CASE WHEN doc_type NOT IN ('10-K', '10-Q', 'earnings_transcript') THEN 'enum: doc_type=' || doc_type END, CASE WHEN quarter NOT IN ('Q1', 'Q2', 'Q3', 'Q4', 'FY') THEN 'enum: quarter=' || quarter END, CASE WHEN doc_type IN ('10-K', '10-Q') AND section_id IS NULL THEN 'missing: section_id' END,
  CASE WHEN doc_type = 'earnings_transcript' AND phase IS NULL THEN 'missing: phase' END, CASE WHEN doc_type = 'earnings_transcript' THEN 'missing: speaker_name' END, CASE WHEN doc_type = 'earnings_transcript' AND speaker_role IS NULL THEN 'missing: speaker_role' END, CASE WHEN doc_type = 'earnings_transcript' THEN 'missing: utterance_id' END, CASE WHEN doc_type = 'earnings_transcript' THEN 'missing: utterance_type' END], lambda x: x IS NOT NULL) AS errors FROM chunks""")
def validate_units(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return c.select("chunk_key", records.unit_errors(c.columns).alias("errors"))


_PIPELINE = f"""WITH RECURSIVE u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id, chunk_key) AS unit FROM chunks WHERE CONDITION),
g AS (SELECT doc_id, chunk_id, unit, text, CAST(len({_toks()}) AS BIGINT) AS n, CASE WHEN doc_type IN ('10-K', '10-Q') THEN 's:' || coalesce(section_id, 'FULL') WHEN doc_type = 'earnings_transcript' AND phase = 'prepared_remarks' THEN 'p:prepared' WHEN doc_type = 'earnings_transcript' AND phase = 'qa' AND chunk_type = 'qa_exchange' THEN 'q:' || chunk_id END AS grp FROM u),
f AS (SELECT doc_id, grp, min(unit) AS first_unit FROM g WHERE grp IS NOT NULL GROUP BY doc_id, grp),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, grp ORDER BY unit) AS k FROM g WHERE grp IS NOT NULL AND n > 0),
r AS (SELECT doc_id, grp, k, chunk_id, text, n, 1 AS pack, n AS c FROM k WHERE k = 1
  UNION ALL SELECT k.doc_id, k.grp, k.k, k.chunk_id, k.text, k.n, CASE WHEN k.grp LIKE 'q:%' OR r.c + k.n < 600 OR r.c < 200 THEN r.pack ELSE r.pack + 1 END, CASE WHEN k.grp LIKE 'q:%' OR r.c + k.n < 600 OR r.c < 200 THEN r.c + k.n ELSE k.n END FROM r JOIN k ON k.doc_id = r.doc_id AND k.grp = r.grp AND k.k = r.k + 1),
p AS (SELECT doc_id, grp, pack, list(chunk_id ORDER BY k) AS source_units, CAST(sum(n) AS BIGINT) AS n, string_agg(text, ' ' ORDER BY k) AS text FROM r GROUP BY doc_id, grp, pack),
t AS (SELECT p.*, first_unit, {_toks('p.text')} AS w, unnest(CASE WHEN n > 800 THEN generate_series(0, CAST(ceil((n - 800) / 680.0) AS BIGINT)) ELSE [0] END) AS i FROM p JOIN f ON f.doc_id = p.doc_id AND f.grp = p.grp)
SELECT doc_id || '_chunk_' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_unit, grp, pack, i) AS VARCHAR), 4, '0') AS chunk_id, doc_id, source_units, CASE WHEN n > 800 THEN 'windowed_overlap' WHEN grp LIKE 's:%' THEN 'section_packed' WHEN grp LIKE 'p:%' THEN 'prepared_packed' ELSE 'qa_exchange' END AS chunk_type,
  CAST(CASE WHEN n > 800 THEN least(i * 680 + 800, n) - i * 680 ELSE n END AS INTEGER) AS chunk_tokens, CAST(CASE WHEN n > 800 THEN i * 680 ELSE 0 END AS INTEGER) AS start_token, CAST(CASE WHEN n > 800 THEN least(i * 680 + 800, n) ELSE 0 END AS INTEGER) AS end_token,
  CASE WHEN n > 800 THEN array_to_string(list_slice(w, i * 680 + 1, least(i * 680 + 800, n)), ' ') ELSE text END AS text FROM t"""


@query(_PIPELINE.replace("CONDITION", "true"))
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """The pipeline over units: here the rows of chunks, each an own unit of its document."""
    return _unit_chunks(spark, d, "true")


_LABEL = "CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive' WHEN event_type = 'error' THEN 'negative' ELSE 'neutral' END"
_SENT = f"SELECT user_id, CAST(ts AS DATE) AS day, event_id, {_LABEL} AS label, least(1.0, value / 100) AS score FROM events"
_SIGNED = "CASE label WHEN 'positive' THEN score WHEN 'negative' THEN -score ELSE 0.0 END"
_AGG = f"count(*) AS n, count_if(label = 'positive') AS positive, count_if(label = 'negative') AS negative, count_if(label = 'neutral') AS neutral, round(avg({_SIGNED}), 6) AS signed, CASE WHEN count_if(label = 'positive') > count_if(label = 'negative') THEN 'positive' WHEN count_if(label = 'negative') > count_if(label = 'positive') THEN 'negative' ELSE 'neutral' END AS label, round(abs(avg({_SIGNED})), 6) AS strength"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("event_type").isin("purchase", "signup"), "positive").when(F.col("event_type") == "error", "negative").otherwise("neutral")
    return table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", label.alias("label"), F.least(F.lit(1.0), F.col("value") / 100).alias("score"))


def _round_sent(df: DataFrame) -> DataFrame:
    return df.withColumns({"signed": F.round("signed", 6), "strength": F.round("strength", 6)})


@query(f"SELECT user_id, {_AGG} FROM ({_SENT}) GROUP BY user_id")
def sentiment_agg(spark: SparkSession, d: str) -> DataFrame:
    return _round_sent(analytics.aggregate_sentiment(_scored(spark, d), ["user_id"], "label", "score"))


@query(f"SELECT day, {_AGG} FROM ({_SENT}) GROUP BY day")
def sentiment_daily(spark: SparkSession, d: str) -> DataFrame:
    return _round_sent(analytics.aggregate_sentiment(_scored(spark, d), ["day"], "label", "score"))


@query(f"SELECT event_id, day, {_SIGNED} AS weighted FROM ({_SENT})")
def sentiment_series(spark: SparkSession, d: str) -> DataFrame:
    w = F.when(F.col("label") == "positive", F.col("score")).when(F.col("label") == "negative", -F.col("score")).otherwise(0.0)
    return _scored(spark, d).select("event_id", "day", w.alias("weighted"))


_WORDS = "regexp_split_to_array(substr(lower(coalesce(text, '')), 1, 2000), '[^a-z-]+')"
_COUNT = lambda vocab: f"len(list_filter({_WORDS}, lambda w: w IN ({', '.join(repr(x) for x in vocab)})))"
_P, _N = _COUNT(analytics.POSITIVE), _COUNT(analytics.NEGATIVE)


@query(f"SELECT doc_id, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS label, CASE WHEN p + n > 0 THEN round(abs(p - n) / (p + n), 6) ELSE 0.0 END AS score FROM (SELECT doc_id, {_P} AS p, {_N} AS n FROM documents)")
def sentiment_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", analytics.sentiment("text").alias("s")).select("doc_id", "s.label", F.round("s.score", 6).alias("score"))


def _series(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.to_date("ts").alias("day"), "event_type", "value", "ts", "event_id")


@query("SELECT event_type, count(*) AS points, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY event_type")
def metric_range(spark: SparkSession, d: str) -> DataFrame:
    return analytics.metric_range(_series(spark, d), "event_type", "day", "value", "2024-01-05", "2024-01-20").withColumn("mean", F.round("mean", 6))


@query("SELECT event_type, arg_max(value, (ts, event_id)) AS latest, max(ts) AS at FROM events GROUP BY event_type")
def latest_metric(spark: SparkSession, d: str) -> DataFrame:
    return analytics.latest(_series(spark, d), ["event_type"], ["ts", "event_id"], "value")


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("SELECT CAST(ts AS DATE) AS day, " + ", ".join(f"round(sum(CASE WHEN event_type = '{t}' THEN value END), 4) AS {t}" for t in _TYPES) + " FROM events GROUP BY 1")
def metric_pivot(spark: SparkSession, d: str) -> DataFrame:
    p = analytics.pivot(_series(spark, d), "day", "event_type", "value", _TYPES)
    return p.select("day", *[F.round(t, 4).alias(t) for t in _TYPES])


@query("SELECT chunk_key, list_filter([CASE WHEN speaker IS NULL THEN 'speaker' END, CASE WHEN phase IS NULL THEN 'phase' END, CASE WHEN ticker IS NULL THEN 'ticker' END], lambda x: x IS NOT NULL) AS missing FROM chunks")
def missing_fields(spark: SparkSession, d: str) -> DataFrame:
    need = ["speaker", "phase", "ticker"]
    have = F.map_keys(F.map_filter(F.create_map(*[x for c in need for x in (F.lit(c), F.col(c))]), lambda k, v: v.isNotNull()))
    return table(spark, d, "chunks").select("chunk_key", F.array_except(F.array(*map(F.lit, need)), have).alias("missing"))


@query(r"SELECT doc_id, CAST(row_no AS BIGINT) AS row_no, CAST(col_no AS BIGINT) AS col_no, trim(cell) AS cell FROM (SELECT doc_id, row_no, unnest(cells) AS cell, generate_subscripts(cells, 1) AS col_no FROM (SELECT doc_id, row_no, string_split(line, '|') AS cells FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS row_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE len(string_split(line, '|')) > 2))")
def table_cells(spark: SparkSession, d: str) -> DataFrame:
    """Rows of cells of the tables in texts, one row a cell."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("r", "line"))
    cells = lines.withColumn("c", F.split("line", "\\|")).filter(F.size("c") > 2).select("doc_id", "r", F.posexplode("c").alias("k", "cell"))
    return cells.select("doc_id", (F.col("r") + 1).cast("bigint").alias("row_no"), (F.col("k") + 1).cast("bigint").alias("col_no"), F.trim("cell").alias("cell"))


@query("SELECT time_bucket(INTERVAL 6 hours, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows; the same function serves a stream."""
    out = ingest.windowed_counts(table(spark, d, "events"), "ts", "6 hours", "1 day", "event_type")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 hours THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = ingest.session_counts(table(spark, d, "events"), "ts", "2 hours", "1 day", "user_id")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT doc_id, saved_at, string_split(coalesce(nullif(source_file, ''), nullif(call_file, ''), doc_id), '/')[-1] AS name FROM calls")
def source_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "calls").select("doc_id", "saved_at", text.file_name(text.first_present("source_file", "call_file", "doc_id")).alias("name"))


@query("SELECT format('{}_chunk_{:04d}', doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id, chunk_key)) AS new_id, chunk_key, CASE WHEN doc_type IN ('10-K', '10-Q') THEN 'section_packed' WHEN phase = 'prepared_remarks' THEN 'prepared_packed' ELSE 'qa_exchange' END AS kind FROM chunks")
def build_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunk numbers within a document and the kind by family."""
    no = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id", "chunk_key"))
    kind = F.when(F.col("doc_type").isin("10-K", "10-Q"), "section_packed").when(F.col("phase") == "prepared_remarks", "prepared_packed").otherwise("qa_exchange")
    return table(spark, d, "chunks").select(F.format_string("%s_chunk_%04d", "doc_id", no).alias("new_id"), "chunk_key", kind.alias("kind"))


@query("SELECT doc_type, count(*) AS n, count(DISTINCT chunk_id) AS ids, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM chunks GROUP BY doc_type")
def scan_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written as JSON lines by ticker and read back with the chunk reader."""
    path = scratch(spark, "chunks")
    c = table(spark, d, "chunks").select(*CHUNK_SCHEMA.names)
    sinks.write_chunks(c.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(8))), path, ("part",))
    rows = spark.read.schema(CHUNK_SCHEMA).json(path)
    return rows.groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chunk_id").alias("ids"), F.sum(F.length("text")).cast("bigint").alias("n_chars"))


@query("SELECT doc_type, count(DISTINCT chunk_id) AS n FROM chunks WHERE chunked_at IS NOT NULL GROUP BY doc_type")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The same chunks as a stream of files: each id is appended once."""
    base = scratch(spark, "stream")
    table(spark, d, "chunks").select(*CHUNK_SCHEMA.names).write.json(f"{base}/in")
    ingest.append_to(ingest.chunk_stream(spark, f"{base}/in", late="36500 days"), f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"))


def _unit_chunks(spark: SparkSession, d: str, cond: str) -> DataFrame:
    u = table(spark, d, "chunks").filter(cond).withColumn("unit_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id", "chunk_key"))).withColumn("exchange_id", F.when(F.col("chunk_type") == "qa_exchange", F.col("chunk_id")))
    return chunking.chunk_documents(u)


@query(_PIPELINE.replace("CONDITION", "doc_type IN ('10-K', '10-Q')"))
def chunk_filings(spark: SparkSession, d: str) -> DataFrame:
    return _unit_chunks(spark, d, "doc_type in ('10-K', '10-Q')")


@query(_PIPELINE.replace("CONDITION", "doc_type = 'earnings_transcript'"))
def chunk_transcripts(spark: SparkSession, d: str) -> DataFrame:
    return _unit_chunks(spark, d, "doc_type = 'earnings_transcript'")


@query("SELECT chunk_key, speaker, phase, section_title FROM chunks WHERE chunk_tokens >= 50 AND text <> ''")
def metadata_map(spark: SparkSession, d: str) -> DataFrame:
    """Non-null metadata as a map, and read back from it."""
    cols = ["speaker", "phase", "section_title"]
    m = F.map_filter(F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c))]), lambda k, v: v.isNotNull())
    rows = table(spark, d, "chunks").filter("chunk_tokens >= 50 and text <> ''").select("chunk_key", m.alias("m"))
    return rows.select("chunk_key", *[F.try_element_at("m", F.lit(c)).alias(c) for c in cols])


@query(r"""SELECT chunk_key, CASE WHEN regexp_matches(c, '(?i)\b(?:CEO|Chief Executive Officer)\b') THEN 'CEO' WHEN regexp_matches(c, '(?i)\b(?:CFO|Chief Financial Officer)\b') THEN 'CFO' WHEN regexp_matches(c, '(?i)\b(?:COO|Chief Operating Officer)\b') THEN 'COO'
  WHEN regexp_matches(c, '(?i)\b(?:CTO|Chief Technology Officer)\b') THEN 'CTO' WHEN regexp_matches(c, '(?i)\bPresident\b') THEN 'President' WHEN regexp_matches(c, '(?i)\bChairman\b') THEN 'Chairman' WHEN firm IS NOT NULL THEN 'Analyst' WHEN regexp_matches(c, '(?i)\b(?:Operator|Moderator)\b') THEN 'Operator' ELSE 'Unknown' END AS role,
  CASE WHEN NOT regexp_matches(c, '(?i)\b(?:CEO|Chief Executive Officer|CFO|Chief Financial Officer|COO|Chief Operating Officer|CTO|Chief Technology Officer|President|Chairman)\b') THEN firm END AS firm
  FROM (SELECT *, list_filter(['Goldman Sachs', 'Morgan Stanley', 'JP Morgan', 'JPMorgan', 'Bank of America', 'Citigroup', 'Wells Fargo', 'Barclays', 'UBS', 'Credit Suisse', 'Deutsche Bank', 'Piper Sandler', 'Raymond James', 'Evercore', 'Jefferies', 'Stifel', 'Oppenheimer', 'Cowen', 'Bernstein', 'RBC', 'BMO', 'Mizuho', 'Needham'], lambda f: contains(lower(c), lower(f)))[1] AS firm
  FROM (SELECT chunk_key, coalesce(speaker, '') || ' ' || coalesce(speaker_role, '') || ' ' || coalesce(['of UBS', 'from Jefferies, CEO', 'Operator at Needham', ''][1 + chunk_key % 4], '') AS c FROM chunks))""")
def context_roles(spark: SparkSession, d: str) -> DataFrame:
    """Role and firm by what stands around a name: the executive's title first, then the firm, then the operator."""
    more = F.element_at(F.array(*map(F.lit, ("of UBS", "from Jefferies, CEO", "Operator at Needham", ""))), (F.col("chunk_key") % 4 + 1).cast("int"))
    said = F.concat(F.coalesce("speaker", F.lit("")), F.lit(" "), F.coalesce("speaker_role", F.lit("")), F.lit(" "), more)
    return table(spark, d, "chunks").select("chunk_key", transcripts.speaker_role(said).alias("r")).select("chunk_key", "r.role", "r.firm")


@query("""SELECT chunk_key, array_to_string(list_filter([CASE WHEN chunk_id IS NULL THEN 'chunk_id' END, CASE WHEN doc_id IS NULL THEN 'doc_id' END, CASE WHEN ticker IS NULL THEN 'ticker' END, CASE WHEN company IS NULL THEN 'company' END, CASE WHEN doc_type IS NULL THEN 'doc_type' END,
  CASE WHEN fiscal_year IS NULL THEN 'fiscal_year' END, CASE WHEN period IS NULL THEN 'period' END, CASE WHEN text IS NULL THEN 'text' END, CASE WHEN chunk_tokens IS NULL THEN 'chunk_tokens' END, CASE WHEN chunk_type IS NULL THEN 'chunk_type' END, CASE WHEN chunked_at IS NULL THEN 'chunked_at' END], lambda x: x IS NOT NULL), ',') AS missing,
  coalesce(chunk_type IN ('section_packed', 'windowed_overlap', 'prepared_packed', 'qa_exchange', 'packed'), false) AS known_type FROM chunks""")
def required_fields(spark: SparkSession, d: str) -> DataFrame:
    """Which required fields a chunk lacks, and whether its type is a known one."""
    lacks = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in CHUNK_REQUIRED])), ",")
    return table(spark, d, "chunks").select("chunk_key", lacks.alias("missing"), F.coalesce(F.col("chunk_type").isin(CHUNK_TYPES), F.lit(False)).alias("known_type"))


@query("SELECT unit_type, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, text, CASE WHEN doc_type = 'earnings_transcript' THEN 'utterance' ELSE 'paragraph' END AS unit_type FROM chunks) GROUP BY unit_type")
def scan_units(spark: SparkSession, d: str) -> DataFrame:
    """Units written as JSON lines, with blank lines between, and read back with the unit reader."""
    kind = F.when(F.col("doc_type") == "earnings_transcript", "utterance").otherwise("paragraph")
    units = table(spark, d, "chunks").select("doc_id", "chunk_id", "ticker", "doc_type", "text", kind.alias("unit_type"))
    path = scratch(spark, "units")
    units.select(F.concat(F.to_json(F.struct("*")), F.lit("\n")).alias("value")).write.text(path)
    rows = spark.read.schema(UNIT_SCHEMA).json(path)
    return rows.groupBy("unit_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("bigint").alias("n_chars"), F.count_distinct("doc_id").alias("docs"))


@query("SELECT category, count(*) AS n, round(100.0 * avg(CASE WHEN answer_unit IS NOT NULL THEN 1 ELSE 0 END), 6) AS rate, CASE WHEN 100.0 * avg(CASE WHEN answer_unit IS NOT NULL THEN 1 ELSE 0 END) >= 80 THEN 'good' WHEN 100.0 * avg(CASE WHEN answer_unit IS NOT NULL THEN 1 ELSE 0 END) >= 75 THEN 'fair' ELSE 'poor' END AS verdict FROM eval_questions WHERE answer_value IS NOT NULL GROUP BY category")
def success_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of checks that succeed, by category; failed ones (without a value) are left out first."""
    rows = table(spark, d, "eval_questions").select("category", F.col("answer_unit").isNotNull().alias("ok"), F.when(F.col("answer_value").isNull(), "no value").alias("error"))
    return analytics.success_rates(rows, "category", "ok", "error")
