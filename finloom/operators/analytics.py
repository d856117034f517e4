"""Sentiment, metric series, chunk statistics and retrieval measures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words by which the offline scorer tells good news from bad.
POSITIVE = "accelerated expanded improved raised recovered outpaced strong growth record gain gains beat stabilized rebuilt confirmed doubled".split()
NEGATIVE = "lowered trimmed postponed absorbed underestimated impairment write-down deficit loss losses weak decline declined fell risk shortfall churn lawsuit".split()


def sentiment(text: str | Column, head: int | None = None) -> Column:
    """struct<label, score> of a text by counted words: score = |p - n| / (p + n), label by the majority; neutral with 0
    where neither or both equally occur. The whole text counts; ``head`` bounds it to so many characters, as a plugged-in
    model may need. The stand-in for a model."""
    col = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    col = F.lower(F.replace(col, F.lit("İ"), F.lit("i")))  # else lower() makes it an i and a mark, which ends the word
    col = col if head is None else F.substring(col, 1, head)
    words = F.split(col, "[^a-z-]+")
    count = lambda vocab: F.size(F.filter(words, lambda w: w.isin(vocab)))
    p, n = count(POSITIVE), count(NEGATIVE)
    return F.struct(F.when(p > n, "positive").when(n > p, "negative").otherwise("neutral").alias("label"), F.when(p + n > 0, F.abs(p - n) / (p + n)).otherwise(F.lit(0.0)).alias("score"))


def model_scorer(score):
    """A pandas UDF string -> double around any ``score(list of texts) -> list of floats`` (a model, a service)."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(score(texts.fillna("").tolist()), dtype="float64")

    return run


def aggregate_sentiment(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Per group: counts by label, ``signed`` (mean of +score, -score, 0), ``label`` (majority of positive and negative)
    and ``strength`` = |signed|. An empty table without keys gives neutral and 0."""
    is_ = lambda x: F.col(label) == x
    signed = F.when(is_("positive"), F.col(score)).when(is_("negative"), -F.col(score)).otherwise(0.0)
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_("positive")).alias("positive"), F.count_if(is_("negative")).alias("negative"), F.count_if(is_("neutral")).alias("neutral"), F.coalesce(F.avg(signed), F.lit(0.0)).alias("signed"))
    return out.withColumn("label", F.when(F.col("positive") > F.col("negative"), "positive").when(F.col("negative") > F.col("positive"), "negative").otherwise("neutral")).withColumn("strength", F.abs("signed"))


def metric_range(series: DataFrame, name: str, date: str, value: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Points, mean and bounds of every metric within dates, both ends included; a missing end is open."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        cond = cond & (F.col(date) <= F.lit(end).cast("date"))
    return series.filter(cond).groupBy(name).agg(F.count(F.lit(1)).alias("points"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))


def latest(series: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    return series.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("latest"), F.max(order[0]).alias("at"))


def pivot(series: DataFrame, date: str, name: str, value: str, names: list[str]) -> DataFrame:
    """One row a date, one column a metric; the names are given, so that no job looks for them."""
    return series.groupBy(date).pivot(name, names).agg(F.sum(value))


def token_statistics(chunks: DataFrame, keys: list[str], tokens: str) -> DataFrame:
    return chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(tokens).alias("least"), F.max(tokens).alias("most"), F.avg(tokens).alias("mean"), F.median(tokens).alias("median"), F.sum(tokens).alias("total"))


def rank_measures(ranked: DataFrame, query: str, rank: str, relevant: Column, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Per query: hit@k (0 or 1), precision@k (over min(k, retrieved)), reciprocal rank (0 without a hit)."""
    rel = F.coalesce(relevant, F.lit(False))
    rows = ranked.select(query, F.col(rank).alias("_r"), rel.alias("_rel"))
    aggs = [F.max(F.when(F.col("_rel") & (F.col("_r") <= k), 1).otherwise(0)).alias(f"hit_{k}") for k in ks]
    aggs += [(F.sum(F.when(F.col("_rel") & (F.col("_r") <= k), 1).otherwise(0)) / F.least(F.lit(k), F.count(F.lit(1)))).alias(f"precision_{k}") for k in ks]
    return rows.groupBy(query).agg(*aggs, F.coalesce(F.lit(1.0) / F.min(F.when(F.col("_rel"), F.col("_r"))), F.lit(0.0)).alias("reciprocal_rank"))


def either_contains(a: str | Column, b: str | Column) -> Column:
    """Whether one non-empty text contains the other, case aside."""
    x, y = (F.lower(F.col(c) if isinstance(c, str) else c) for c in (a, b))
    return (F.length(x) > 0) & (F.length(y) > 0) & (x.contains(y) | y.contains(x))


def answer_in(answer: str | Column, text: str | Column) -> Column:
    """Whether an answer's value stands in a text: as it is, or as a number with or without thousands separators."""
    a, t = (F.col(c) if isinstance(c, str) else c for c in (answer, text))
    squeezed = lambda c: F.regexp_replace(F.lower(c), ",", "")
    return (F.length(a) > 0) & squeezed(t).contains(squeezed(a))


def success_rates(checks: DataFrame, category: str, ok: str, error: str | None = None, good: float = 80.0, fair: float = 75.0) -> DataFrame:
    """(category, n, rate, verdict): the share of checks that succeed, in percent, and whether it is good, fair or poor.
    Checks with an ``error`` are left out first; a null ``ok`` is a failure."""
    rows = checks.filter(F.col(error).isNull()) if error else checks
    rate = 100.0 * F.avg(F.coalesce(F.col(ok), F.lit(False)).cast("int"))
    out = rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"), rate.alias("_r"))
    return out.select(category, "n", F.round("_r", 6).alias("rate"), F.when(F.col("_r") >= good, "good").when(F.col("_r") >= fair, "fair").otherwise("poor").alias("verdict"))
