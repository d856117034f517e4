"""Catalogues, dimensions, enrichment and validation of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finloom.schemas import CHUNK_REQUIRED, CHUNK_TYPES, DOC_TYPES, PHASES, QUARTERS, SPEAKER_ROLES, UNIT_REQUIRED, UNIT_REQUIRED_BY_TYPE


def upsert(table: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """One row a key: the one that comes first by ``newest``. Nulls in keys are equal to each other."""
    w = Window.partitionBy(*keys).orderBy(*newest)
    return table.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def mark_ingested(table: DataFrame, match: Column, when: Column | None = None) -> DataFrame:
    """``rag_ingested`` set where ``match`` holds (and ``ingested_at`` to ``when``), the other rows as they were."""
    out = table.withColumn("rag_ingested", F.when(match, True).otherwise(F.col("rag_ingested")))
    return out.withColumn("ingested_at", F.when(match, when)) if when is not None else out


def delete_by_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def update_missing(table: DataFrame, new: DataFrame, key: str, col: str) -> DataFrame:
    """``col`` of ``new`` where it is there, else the old value; one row a key must be in ``new``."""
    return table.join(new.select(key, F.col(col).alias("_new")), key, "left").withColumn(col, F.coalesce("_new", col)).drop("_new")


def top_per_group(table: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return table.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def fill_missing(table: DataFrame, keys: list[str], order: str, defaults: dict[str, Column | None]) -> DataFrame:
    """Each column's nulls and empty strings filled with the first present value of its group in order, else with the
    default."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for c, default in defaults.items():
        present = F.nullif(F.col(c), F.lit("")) if dict(table.dtypes)[c] == "string" else F.col(c)
        options = [present, F.first(present, ignorenulls=True).over(w)] + ([default] if default is not None else [])
        table = table.withColumn(c, F.coalesce(*options))
    return table


def recent_quarters(start: Column, n: int) -> Column:
    """Array of the n quarters' first days up to the one of ``start``, newest first."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.add_months(F.trunc(start, "quarter"), (-3 * i).cast("int")))


# Section titles' first words and the categories they belong to.
CATEGORIES = {"business": "business", "risk": "risk", "properties": "operations", "legal": "legal", "management": "analysis", "md&a": "analysis", "market": "risk", "financial": "financials", "controls": "controls", "exhibits": "exhibits"}


def category(title: str | Column) -> Column:
    col = F.col(title) if isinstance(title, str) else title
    word = F.regexp_extract(F.lower(F.coalesce(col, F.lit(""))), "([a-z&]+)", 1)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])[word], F.lit("other"))


def _missing(cols: list[str], have: list[str]) -> list[Column]:
    return [F.when(F.col(c).isNull(), F.lit(f"missing: {c}")) if c in have else F.lit(f"missing: {c}") for c in cols]


def _outside(col: str, values: list[str]) -> Column:
    return F.when(F.col(col).isNotNull() & ~F.col(col).isin(values), F.concat(F.lit("enum: "), F.lit(col), F.lit("="), F.col(col)))


def unit_errors(columns: list[str]) -> Column:
    """Array of what is wrong with a unit; empty where it is right."""
    filing = F.col("doc_type").isin("10-K", "10-Q")
    parts = _missing(UNIT_REQUIRED, columns) + [_outside("doc_type", DOC_TYPES), _outside("quarter", QUARTERS)]
    parts += [F.when(filing, e) for e in _missing(UNIT_REQUIRED_BY_TYPE["filing"], columns)]
    parts += [F.when(F.col("doc_type") == "earnings_transcript", e) for e in _missing(UNIT_REQUIRED_BY_TYPE["transcript"], columns)]
    return F.array_compact(F.array(*parts))


def chunk_errors(least: int = 200, most: int = 800, columns: list[str] | None = None) -> Column:
    """Array of what is wrong with a chunk: missing fields, values outside the vocabularies, fields of the other family,
    blank text, an id of another form, sizes out of bounds, overlaps that do not fit. ``columns`` are the table's: a
    required field that it lacks is missing in every row; without them ``company``, which a table may lack, is not looked at."""
    filing, n = F.col("doc_type").isin("10-K", "10-Q"), F.col("chunk_tokens")
    parts = [F.lit(f"missing: {c}") if columns and c not in columns else F.when(F.col(c).isNull(), F.lit(f"missing: {c}")) for c in CHUNK_REQUIRED if columns or c != "company"]
    parts += [_outside("doc_type", DOC_TYPES), _outside("quarter", QUARTERS), _outside("chunk_type", CHUNK_TYPES), _outside("phase", PHASES), _outside("speaker_role", SPEAKER_ROLES)]
    parts += [F.when(filing & F.col(c).isNotNull(), F.lit(f"family: {c}")) for c in ("speaker", "phase")]
    parts += [F.when((F.col("doc_type") == "earnings_transcript") & F.col("section_id").isNotNull(), F.lit("family: section_id"))]
    parts += [F.when(F.trim("text") == "", "text: blank"), F.when(~F.col("chunk_id").rlike("_chunk_\\d{4,}$"), "chunk_id: form")]
    parts += [F.when(n < least / 2, "tokens: few"), F.when(n > most, "tokens: many")]
    windowed = F.col("chunk_type") == "windowed_overlap"
    parts += [F.when(windowed & (F.col("end_token") - F.col("start_token") != n), "window: span"), F.when(windowed & F.col("overlap_with_prev").isNull(), "overlap: missing"), F.when(F.col("overlap_with_prev") >= n, "overlap: size")]
    return F.array_compact(F.array(*parts))


def error_report(table: DataFrame, errors: Column) -> DataFrame:
    """(kind, n): how often each kind of error occurs, the kind being what stands before the colon, and ``valid`` for
    rows without one."""
    rows = table.select(errors.alias("e"))
    return rows.select(F.explode(F.when(F.size("e") == 0, F.array(F.lit("valid"))).otherwise(F.transform("e", lambda x: F.element_at(F.split(x, ":"), 1)))).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
