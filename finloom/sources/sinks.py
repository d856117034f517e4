"""Sinks: partitioned tables, JSON lines, Markdown, CSV of tables, index tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finloom.functions.html import html_tables
from finloom.functions.text import words
from finloom.operators.lexical import Index, build_index
from finloom.operators.records import upsert


def write_chunks(chunks: DataFrame, path: str, keys: tuple[str, ...] = ("ticker",)) -> None:
    """JSON lines below one folder a key; what was there is replaced."""
    chunks.repartition(*keys).write.mode("overwrite").partitionBy(*keys).json(path)


def write_filings(filings: DataFrame, path: str) -> None:
    """Parquet by ticker and form; a missing quarter of a 10-Q comes from its filing date."""
    q = F.when(F.col("form_type") == "10-Q", F.coalesce(F.col("quarter"), F.quarter(F.to_date("filing_date")))).otherwise(F.col("quarter"))
    filings.withColumn("quarter", q).write.mode("overwrite").partitionBy("ticker", "form_type").parquet(path)


def append_catalogue(old: DataFrame, new: DataFrame, keys: list[str], path: str) -> None:
    """The catalogue with new entries in the place of old ones of the same key, written to a new path."""
    both = old.unionByName(new, allowMissingColumns=True)
    upsert(both, keys, [F.col("saved_at").desc()]).write.mode("overwrite").parquet(path)


def write_transcripts(calls: DataFrame, path: str, text: str = "text") -> None:
    """Transcripts by ticker, year and quarter; those without text are left out, the latest ``saved_at`` of a call stands."""
    kept = upsert(calls.filter(F.length(text) > 0), ["ticker", "fiscal_year", "quarter"], [F.col("saved_at").desc_nulls_last()])
    kept.write.mode("overwrite").partitionBy("ticker", "fiscal_year", "quarter").parquet(path)


def rewrite_metadata(rows: DataFrame, fill: dict[str, Column], path: str) -> None:
    """JSON lines with the columns of ``fill`` set where they were null, at a new path: what is read is not overwritten."""
    rows.withColumns({c: F.coalesce(F.col(c), v) if c in rows.columns else v for c, v in fill.items()}).write.mode("errorifexists").json(path)


def write_evaluation(results: DataFrame, path: str, **about: str) -> None:
    """Measures of an evaluation as JSON lines, each with what the run was about."""
    results.withColumns({k: F.lit(v) for k, v in about.items()}).write.mode("overwrite").json(path)


def delete_documents(ids: DataFrame, tables: dict[str, DataFrame], path: str, doc: str = "doc_id") -> None:
    """Every table without the rows of the documents in ``ids``, written to ``path/<name>``: chunks, vectors and
    catalogue go together."""
    gone = ids.select(doc).distinct()
    for name, df in tables.items():
        df.join(gone, doc, "left_anti").write.mode("errorifexists").parquet(f"{path}/{name}")


def write_markdown(pages: DataFrame, path: str, key: str = "doc_id", text: str = "markdown") -> None:
    """One text file a key below ``path/key=...``."""
    pages.select(key, F.col(text).alias("value")).repartition(key).write.mode("overwrite").option("lineSep", "\n").partitionBy(key).text(path)


def table_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table_no, row_no, col_no, cell) of the tables in pages."""
    t = pages.select(key, F.posexplode(html_tables(html)).alias("table_no", "rows")).select(key, "table_no", F.posexplode("rows").alias("row_no", "cells"))
    return t.select(key, "table_no", "row_no", F.posexplode("cells").alias("col_no", "cell"))


def write_tables(pages: DataFrame, key: str, html: str, path: str) -> None:
    table_cells(pages, key, html).write.mode("overwrite").option("header", "true").csv(path)


def write_index(docs: DataFrame, doc: str, fields: list[str], path: str, split: Callable = words) -> None:
    """The lexical index as four tables; postings and terms are ranged and sorted by term, so that a lookup of terms
    reads few row groups. Rows with a null id or without text are left out; of rows of one id the one with the greatest
    fields stands."""
    kept = docs.filter(F.col(doc).isNotNull() & (F.length(fields[0]) > 0)).groupBy(doc).agg(F.max(F.struct(*fields)).alias("_r")).select(doc, "_r.*")
    save_index(build_index(kept, doc, *fields, split=split), path)


def save_index(index: Index, path: str) -> None:
    index.postings.repartitionByRange("term").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(f"{path}/postings")
    index.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    index.stats.write.mode("overwrite").parquet(f"{path}/stats")
    stored = index.lengths.sparkSession.read.parquet(f"{path}/postings")
    stored.groupBy("term").agg(F.count(F.lit(1)).alias("df")).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")


def read_index(spark, path: str, split: Callable = words) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "lengths", "stats", "terms")), split)


def write_vectors(chunks: DataFrame, embed, path: str, key: str = "chunk_id", text: str = "text", tokens: str = "chunk_tokens", least: int = 50) -> None:
    """Embeddings keyed by the chunk's own id, with its non-null metadata as a map; chunks below ``least`` tokens or
    without text are left out."""
    meta = [c for c, t in chunks.dtypes if c not in (key, text) and not t.startswith(("array", "map", "struct"))]
    kept = chunks.filter((F.col(tokens) >= least) & (F.length(text) > 0))
    pairs = F.create_map(*[x for c in meta for x in (F.lit(c), F.col(c).cast("string"))])
    kept.select(key, text, F.map_filter(pairs, lambda k, v: v.isNotNull()).alias("metadata"), embed(text).alias("embedding")).write.mode("overwrite").parquet(path)
