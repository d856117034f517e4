"""Composite parsers: a filing's page or a transcript's text into unit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finloom.functions.html import html_text
from finloom.functions.text import paragraphs, period, token_count
from finloom.operators.transcripts import SECTIONS, clean_name, role, utterances
from finloom.schemas import UNIT_SCHEMA


def _units(df: DataFrame) -> DataFrame:
    """All columns of the unit schema in its order and types; those that a family lacks are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in UNIT_SCHEMA])


def _ids(df: DataFrame, doc_type: str) -> DataFrame:
    return df.withColumns({"doc_type": F.col(doc_type), "period": period("fiscal_year", "quarter"), "company": F.col("ticker"), "chunk_id": F.format_string("%s_u_%04d", "doc_id", "unit_index"), "char_count": F.length("text"), "word_count": token_count("text"), "token_count": token_count("text")})


def filing_units(pages: DataFrame, html: str = "html", least: int = 20) -> DataFrame:
    """Paragraph units of filings: ``doc_id, ticker, form_type, fiscal_year, quarter, filing_date, source_file`` and a
    page. Headings are looked for in the same text that is cut into paragraphs, so a section holds from its heading's
    paragraph on; paragraphs below ``least`` characters are left out after the sections are known."""
    rows = pages.select(*[c for c in pages.columns if c != html], html_text(html).alias("_t"))
    rows = rows.select(*[c for c in rows.columns if c != "_t"], F.posexplode(paragraphs("_t")).alias("_i", "text"))
    low = F.lower(F.col("text"))
    here = F.coalesce(*[F.when(low.rlike(f"^[#\\s]*{p}"), F.struct(F.lit(i).alias("section_id"), F.lit(t).alias("section_title"))) for i, t, p in SECTIONS])
    w = Window.partitionBy("doc_id").orderBy("_i")
    rows = rows.withColumn("_s", F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.length("text") >= least)
    rows = rows.withColumns({"unit_index": F.row_number().over(w) - 1, "unit_type": F.lit("paragraph"), "section_id": F.coalesce("_s.section_id", F.lit("FULL")), "section_title": F.col("_s.section_title")})
    return _units(_ids(rows, "form_type"))


def transcript_units(calls: DataFrame, text: str = "text", least: int = 10) -> DataFrame:
    """Utterance units of transcripts: ``doc_id, ticker, fiscal_year, quarter, filing_date, source_file`` and a text.
    A question opens an exchange, the first answer behind it closes it."""
    from finloom.operators.transcripts import exchanges

    said = utterances(calls, "doc_id", text, least).withColumnRenamed("text", "_u")
    rows = calls.drop(text).join(said, "doc_id").withColumnRenamed("_u", "text")
    rows = rows.withColumns({"unit_index": F.row_number().over(Window.partitionBy("doc_id").orderBy("idx")) - 1, "unit_type": F.lit("utterance"), "speaker_name": clean_name("speaker"), "speaker_role": role("speaker")})
    rows = exchanges(rows, "doc_id", "unit_index", F.col("utterance_type") == "question", F.col("utterance_type") == "answer")
    rows = rows.withColumns({"exchange_id": F.when(F.col("exchange_no").isNotNull(), F.format_string("ex_%03d", "exchange_no")), "form": F.lit("earnings_transcript")})
    rows = _ids(rows, "form")
    return _units(rows.withColumn("utterance_id", F.col("chunk_id")))
