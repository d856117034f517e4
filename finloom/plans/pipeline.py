"""Batch build: raw files to units, chunks and indexes, each a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finloom.config import ChunkConfig
from finloom.operators.chunking import chunk_documents, semantic_chunks
from finloom.operators.dense import hash_embedder
from finloom.operators.units import filing_units, transcript_units
from finloom.sources import readers, sinks


def build_units(filings: DataFrame | None, calls: DataFrame | None, out: str) -> DataFrame:
    """Units of filings' pages and of transcripts, written to ``out/units``."""
    parts = [f for f in (filing_units(filings) if filings is not None else None, transcript_units(calls) if calls is not None else None) if f is not None]
    units = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    units.write.mode("overwrite").partitionBy("doc_type").parquet(f"{out}/units")
    return units.sparkSession.read.parquet(f"{out}/units")


def build_chunks(units: DataFrame, out: str, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of units with their documents' metadata, written to ``out/chunks``."""
    meta = units.groupBy("doc_id").agg(*[F.min(c).alias(c) for c in ("ticker", "doc_type", "fiscal_year", "quarter", "period")])
    chunk_documents(units, cfg).join(meta, "doc_id").write.mode("overwrite").parquet(f"{out}/chunks")
    return units.sparkSession.read.parquet(f"{out}/chunks")


def build_indexes(chunks: DataFrame, out: str, embed=None, least_tokens: int = 50) -> None:
    """Lexical and dense indexes over the same chunks, below ``out``."""
    kept = chunks.filter((F.col("chunk_tokens") >= least_tokens) & (F.length("text") > 0))
    sinks.write_index(kept, "chunk_id", ["text", "ticker", "doc_type"], f"{out}/lexical")
    sinks.write_vectors(kept, embed or hash_embedder(), f"{out}/vectors", least=least_tokens)


def ingest_folder(spark: SparkSession, path: str, out: str, size: int = 1000) -> DataFrame:
    """Files of any known kind to character-bounded chunks at ``out/chunks``; files that cannot be read go to
    ``out/errors``."""
    docs = readers.read_documents(spark, path)
    docs.filter("error is not null").select("path", "error").write.mode("overwrite").parquet(f"{out}/errors")
    pieces = semantic_chunks(docs.filter("text is not null"), "path", "text", size)
    rows = pieces.select(F.concat_ws("#", "path", "piece").alias("chunk_id"), F.col("path").alias("doc_id"), "piece", "start", "end", "text")
    rows.write.mode("overwrite").parquet(f"{out}/chunks")
    return spark.read.parquet(f"{out}/chunks")
