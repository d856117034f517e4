"""Queries of the operators on training text, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finloom.functions.text import token_count
from finloom.llm import bpe, leak, lines, name_variants, packing, spam, splitting, turns
from finloom.plans.runtime import spread, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_lines(table(spark, sf_dir, "chunks"))


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks")
    return lines.without_lines(chunks, lines.repeated_lines(chunks))


def p2_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk_id once (its latest row), sized by its true token count, packed per ticker and chunk_type."""
    cols = ["chunk_id", "ticker", "chunk_type", "source_units", "chunked_at", "chunk_key"]
    rows = spread(table(spark, sf_dir, "chunks").select(*cols, "text")).select(*cols, token_count("text").cast("int").alias("n_tokens"))
    latest = rows.withColumn("chunk_id", F.coalesce("chunk_id", F.concat(F.lit("#"), "chunk_key"))).groupBy("chunk_id").agg(F.max_by(F.struct("ticker", "chunk_type", "source_units", "n_tokens"), F.struct("chunked_at", "chunk_key")).alias("c"))
    packed = packing.pack_items(latest.select("chunk_id", "c.*"), ["ticker", "chunk_type"], "chunk_id", "n_tokens")
    return packed.select("ticker", "chunk_type", "container_no", "chunk_id", "piece_no", "piece_size", "n_tokens", "source_units")


def p3_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.speaker_turns(table(spark, sf_dir, "chunks"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_turns(spark, sf_dir).select("chunk_key", "turn_no", "speaker_no", "n_words")


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_variants.link_names(table(spark, sf_dir, "chunks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_variants.same_name_pairs(p4_links(spark, sf_dir))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "chunks"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pieces(spark, sf_dir).select("chunk_key").distinct()


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_questions"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.stuffed_pages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_clean": p1_clean,
    "p2_packs": p2_packs,
    "p3_found": p3_found,
    "p3_turns": p3_turns,
    "p4_found": p4_found,
    "p4_links": p4_links,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p8_found": p8_found,
}

#: None of these can be put in SQL; they are tested against brute force, a round trip or an independent encoder.
SQL: dict[str, str] = {}
