"""Weighted reciprocal-rank fusion of ranked lists, its explanation, reranking and prompt assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF_K = 60


def fuse(legs: dict[str, tuple[DataFrame, float]], query: str = "query", doc: str = "doc", k: int = RRF_K) -> DataFrame:
    """(query, doc, score, <leg>_rank, <leg>_score for every leg) of the union of ranked lists.

    ``legs``: name -> (DataFrame with query, doc, rank; weight); weights are made to sum to 1. score = sum of weight /
    (k + rank); a leg that did not retrieve a document gives null rank and 0. One aggregation, no outer join. A document
    that a leg lists twice keeps its best rank."""
    total = sum(w for _, w in legs.values())
    if total <= 0:
        raise ValueError("weights must have a positive sum")
    rows = None
    for name, (df, w) in legs.items():
        part = df.select(query, doc, F.col("rank").cast("int").alias("rank"), F.lit(name).alias("leg"), F.lit(w / total).alias("w"))
        rows = part if rows is None else rows.unionByName(part)
    ranks = {n: F.min(F.when(F.col("leg") == n, F.col("rank"))).alias(f"{n}_rank") for n in legs}
    out = rows.groupBy(query, doc).agg(*ranks.values())
    for n, (_, w) in legs.items():
        out = out.withColumn(f"{n}_score", F.coalesce(F.lit(w / total) / (F.lit(float(k)) + F.col(f"{n}_rank")), F.lit(0.0)))
    return out.withColumn("score", sum((F.col(f"{n}_score") for n in legs), F.lit(0.0)))


def best(fused: DataFrame, legs: list[str], n: int, query: str = "query", doc: str = "doc") -> DataFrame:
    """The first n of each query with ``rank``: by score, then best rank in any leg, then the earlier leg, then doc."""
    ranks = [F.coalesce(F.col(f"{x}_rank"), F.lit(2**31 - 1)) for x in legs]
    w = Window.partitionBy(query).orderBy(F.round("score", 9).desc(), F.least(*ranks) if len(ranks) > 1 else ranks[0], *ranks, F.col(doc))
    return fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def explain(fused: DataFrame, legs: list[str]) -> DataFrame:
    """Adds ``explanation``: the rank and share of every leg in words."""
    parts = [F.concat(F.lit(f"{x}: "), F.coalesce(F.concat(F.lit("rank "), F.col(f"{x}_rank").cast("string")), F.lit("not retrieved"))) for x in legs]
    return fused.withColumn("explanation", F.concat_ws("; ", *parts))


def adjust(base: Column, rules: list[tuple[Column, Column]]) -> Column:
    """A score after a list of (condition, new score as an expression of column ``s``), the first that holds; clamped
    to 0..1. The rules are data: none are built in."""
    out = base
    for cond, new in reversed(rules):
        out = F.when(cond, new).otherwise(out)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))


def parse_score(text: str | Column) -> Column:
    """The first number of a model's answer, clamped to 0..1; 0.5 where there is none."""
    col = F.col(text) if isinstance(text, str) else text
    number = F.nullif(F.regexp_extract(col, r"(\d+\.?\d*)", 1), F.lit("")).cast("double")
    return F.when(number.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def parse_scores(text: str | Column, n: int | Column) -> Column:
    """n scores of a model's answer to a batch: of its JSON array if there is one, else its numbers in order; clamped,
    cut to n and filled up with 0.5."""
    col = F.col(text) if isinstance(text, str) else text
    size = F.lit(n) if isinstance(n, int) else n
    inside = F.coalesce(F.nullif(F.regexp_extract(col, r"\[([^\[\]]*)\]", 1), F.lit("")), col)
    found = F.transform(F.regexp_extract_all(inside, F.lit(r"(\d+\.?\d*)"), 1), lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double"))))
    return F.slice(F.concat(F.coalesce(found, F.array().cast("array<double>")), F.array_repeat(F.lit(0.5), size)), F.lit(1), size)


def build_prompts(context: DataFrame, query: str, rank: str, source: str, text: str, question: str, excerpt: int = 500) -> DataFrame:
    """(query, prompt): per query its sources in rank order, numbered, with excerpts, and the question."""
    block = F.concat(F.lit("Source "), F.col(rank).cast("string"), F.lit(" ("), F.coalesce(F.col(source), F.lit("unknown")), F.lit("):\n"), F.substring(F.coalesce(F.col(text), F.lit("")), 1, excerpt))
    rows = context.select(query, question, F.col(rank).alias("_r"), block.alias("_b"))
    out = rows.groupBy(query).agg(F.first(question).alias("_q"), F.sort_array(F.collect_list(F.struct("_r", "_b"))).alias("_s"))
    return out.select(query, F.concat(F.array_join(F.transform("_s", lambda s: s["_b"]), "\n\n"), F.lit("\n\nQuestion: "), F.coalesce(F.col("_q"), F.lit(""))).alias("prompt"))


def query_intent(question: str | Column) -> Column:
    """struct<period_type, fiscal_year, quarter> read from a question.

    Quarterly if it names a quarter, else annual; the year is the latest 20dd, else the last two-digit fiscal year;
    a quarter only of quarterly questions."""
    q = F.lower(F.coalesce(F.col(question) if isinstance(question, str) else question, F.lit("")))
    quarterly = q.rlike(r"\bq[1-4]\b|quarter")
    years = F.array_max(F.transform(F.regexp_extract_all(q, F.lit(r"\b(20\d\d)\b"), 1), lambda y: y.cast("int")))
    short = F.regexp_extract_all(q, F.lit(r"(?:fy|fiscal)\s*'?(\d\d)\b"), 1)
    late = F.try_element_at(short, F.lit(-1)).cast("int")
    named = [("first", 1), ("second", 2), ("third", 3), ("fourth", 4)]
    quarter = F.nullif(F.regexp_extract(q, r"\bq([1-4])\b", 1), F.lit("")).cast("int")
    for word, n in reversed(named):
        quarter = F.coalesce(quarter, F.when(q.contains(f"{word} quarter"), F.lit(n)))
    return F.struct(
        F.when(quarterly, "quarterly").otherwise("annual").alias("period_type"),
        F.coalesce(years, F.when(late < 50, 2000 + late).otherwise(1900 + late)).alias("fiscal_year"),
        F.when(quarterly, quarter).alias("quarter"),
    )
