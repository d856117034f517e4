"""Schemas and closed vocabularies of the two record families, units and chunks."""

from __future__ import annotations

from pyspark.sql import types as T


_S, _I, _A = T.StringType(), T.IntegerType(), T.ArrayType(T.StringType())

#: A unit: a paragraph of a filing or an utterance of a transcript.
UNIT_SCHEMA = T.StructType([T.StructField(n, k) for n, k in [
    ("doc_id", _S),
    ("chunk_id", _S),
    ("ticker", _S),
    ("company", _S),
    ("doc_type", _S),
    ("fiscal_year", _I),
    ("quarter", _S),
    ("period", _S),
    ("filing_date", _S),
    ("section_id", _S),
    ("section_title", _S),
    ("unit_type", _S),
    ("unit_index", _I),
    ("text", _S),
    ("char_count", _I),
    ("word_count", _I),
    ("source_file", _S),
    ("parsed_at", _S),
    ("phase", _S),
    ("speaker_name", _S),
    ("speaker_role", _S),
    ("speaker_firm", _S),
    ("utterance_id", _S),
    ("utterance_type", _S),
    ("token_count", _I),
    ("exchange_id", _S),
    ("exchange_role", _S),
]])
CHUNK_SCHEMA = T.StructType([T.StructField(n, k) for n, k in [
    ("chunk_id", _S),
    ("doc_id", _S),
    ("source_units", _A),
    ("source_uri", _S),
    ("ticker", _S),
    ("company", _S),
    ("doc_type", _S),
    ("fiscal_year", _I),
    ("quarter", _S),
    ("period", _S),
    ("section_id", _S),
    ("section_title", _S),
    ("speaker", _S),
    ("speaker_role", _S),
    ("phase", _S),
    ("chunk_tokens", _I),
    ("start_token", _I),
    ("end_token", _I),
    ("chunk_type", _S),
    ("overlap_with_prev", _I),
    ("overlap_with_next", _I),
    ("text", _S),
    ("chunked_at", _S),
]])

# The closed vocabularies.
DOC_TYPES = ["10-K", "10-Q", "earnings_transcript"]
QUARTERS = ["Q1", "Q2", "Q3", "Q4", "FY"]
PHASES = ["prepared_remarks", "qa"]
SPEAKER_ROLES = ["CEO", "CFO", "COO", "CTO", "executive", "analyst", "operator", "unknown"]
UNIT_TYPES = ["paragraph", "utterance"]
UTTERANCE_TYPES = ["statement", "question", "answer"]
CHUNK_TYPES = ["section_packed", "windowed_overlap", "prepared_packed", "qa_exchange", "packed"]

#: Fields that must be there: of every unit, and further ones by family.
UNIT_REQUIRED = "doc_id chunk_id ticker company doc_type fiscal_year quarter period filing_date unit_type unit_index text char_count word_count source_file parsed_at".split()
UNIT_REQUIRED_BY_TYPE = {"filing": ["section_id"], "transcript": ["phase", "speaker_name", "speaker_role", "utterance_id", "utterance_type"]}
CHUNK_REQUIRED = "chunk_id doc_id ticker company doc_type fiscal_year period text chunk_tokens chunk_type chunked_at".split()
