"""Readers: JSON lines, text, binary office files, JSON catalogues; keys from paths; listings."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finloom.functions.html import to_text
from finloom.schemas import CHUNK_SCHEMA, UNIT_SCHEMA


def read_units(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Units as JSON lines; blank lines are skipped. A line that is no JSON gives nulls and stands in
    ``_corrupt_record``; ``strict`` fails on it instead."""
    return _json(spark, path, UNIT_SCHEMA, strict)


def read_chunks(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Chunks as JSON lines, like ``read_units``."""
    return _json(spark, path, CHUNK_SCHEMA, strict)


def _json(spark, path, schema, strict):
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    if strict:
        return reader.schema(schema).option("mode", "FAILFAST").json(path)
    return reader.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").json(path)


def with_path_keys(df: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Adds the groups of ``pattern`` in the file's path as columns; null where it does not match."""
    path = F.col("_metadata.file_path")
    return df.select("*", *[F.nullif(F.regexp_extract(path, pattern, i + 1), F.lit("")).alias(n) for i, n in enumerate(names)])


def read_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(path, text): one row a file."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def list_files(spark: SparkSession, path: str, glob: str = "*", exclude_prefix: str = "raw_") -> DataFrame:
    """(path, name, size, modified) of files whose names do not begin with ``exclude_prefix``; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    df = df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return df.filter(~F.col("name").startswith(exclude_prefix)) if exclude_prefix else df


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def docx_text(data: bytes) -> str:
    """Paragraphs of a Word file, one a line."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p"))


def xlsx_text(data: bytes) -> str:
    """Sheets of an Excel file under banners, cells parted by tabs."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in names else {}
        out = []
        for i, sheet in enumerate(book.iter(f"{_S}sheet"), 1):
            target = rels.get(sheet.get(f"{_R}id"), f"worksheets/sheet{i}.xml").lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            out.append(f"--- Sheet: {sheet.get('name')} ---")
            for row in root.iter(f"{_S}row"):
                cells = []
                for c in row.iter(f"{_S}c"):
                    v = c.find(f"{_S}v")
                    inline = c.find(f"{_S}is")
                    cells.append(shared[int(v.text)] if c.get("t") == "s" and v is not None else "".join(t.text or "" for t in inline.iter(f"{_S}t")) if inline is not None else (v.text or "") if v is not None else "")
                out.append("\t".join(cells))
    return "\n".join(out)


def pdf_text(data: bytes, joiner: str = "\n") -> str:
    """Pages of a PDF; a page that cannot be read is skipped. Needs pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the package pypdf") from e
    pages = []
    for page in PdfReader(io.BytesIO(data)).pages:
        try:
            pages.append(page.extract_text() or "")
        except Exception:  # noqa: BLE001
            continue
    return joiner.join(pages)


READERS = {
    "docx": docx_text,
    "xlsx": xlsx_text,
    "pdf": pdf_text,
    "txt": lambda b: b.decode("utf-8", "ignore"),
    "md": lambda b: b.decode("utf-8", "ignore"),
    "htm": lambda b: to_text(b.decode("utf-8", "ignore")),
    "html": lambda b: to_text(b.decode("utf-8", "ignore")),
}


def read_documents(spark: SparkSession, path: str, joiner: str = "\n") -> DataFrame:
    """(path, text, error) of all files below a path, read by their extension; a file that cannot be read, or of an
    unknown kind, is a row with an error and no text. ``joiner`` stands between a PDF's pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, data in zip(b["path"], b["content"], strict=True):
                kind = re.sub(r".*\.", "", p).lower()
                try:
                    if kind not in READERS:
                        raise ValueError(f"unknown file type: {kind}")
                    out.append((p, pdf_text(bytes(data), joiner) if kind == "pdf" else READERS[kind](bytes(data)), None))
                except Exception as e:  # noqa: BLE001
                    out.append((p, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, text string, error string")


def read_companies(spark: SparkSession, path: str | None, fallback: list[dict] | None = None) -> DataFrame:
    """The company dimension from a JSON array; where no path is given, from ``fallback``."""
    schema = "ticker string, company_name string, sector string, industry string, cik string"
    if path:
        return spark.read.schema(schema).option("multiLine", "true").json(path)
    return spark.createDataFrame([tuple(r.get(c) for c in ("ticker", "company_name", "sector", "industry", "cik")) for r in fallback or []], schema)


def explode_catalogue(df: DataFrame, array: str) -> DataFrame:
    """Catalogue files ``{ticker, <array>: [{...}]}`` as one row an entry."""
    return df.select("ticker", F.explode(array).alias("e")).select("ticker", "e.*")


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions from a JSON array; the answer's value, of any type, is kept as JSON text."""
    raw = spark.read.option("multiLine", "true").option("primitivesAsString", "true").text(path, wholetext=True)
    schema = "array<struct<id:string,question:string,company:string,filings:array<struct<form:string,year:int,source:string>>,answer:map<string,string>,category:string,is_unanswerable:boolean>>"
    return raw.select(F.explode(F.from_json("value", schema)).alias("q")).select("q.*")
