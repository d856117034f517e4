"""BM25 over an inverted index kept as ordinary tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finloom.functions.text import terms
from finloom.plans.runtime import few, small, spread

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Asked terms up to which a lookup is pushed into the scan of the postings, besides the join.
PUSHED_TERMS = 256


class Index(NamedTuple):
    """postings(term, doc, tf, n_terms), n_terms being the document's length; lengths(doc, n_terms); stats(n_docs,
    avg_terms), one row; terms(term, df), if it is stored; the function that splits texts and questions."""

    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    terms: DataFrame | None = None
    split: Callable = terms


def build_index(docs: DataFrame, doc: str, *fields: str, split: Callable = terms) -> Index:
    """Index of the terms of all ``fields`` together. Null texts count as empty; rows of equal ``doc`` must not occur.

    The postings are one explode and one aggregation with map-side counts; write them partitioned or sorted by term to
    look terms up without a scan."""
    words = F.concat(*[split(f) for f in fields]) if len(fields) > 1 else split(fields[0])
    base = spread(docs.select(F.col(doc).alias("doc"), *fields)).select("doc", words.alias("w"))
    lengths = base.select("doc", F.size("w").alias("n_terms"))
    # An outer explode: for an inner one the optimizer infers a filter that computes the terms a second time.
    postings = base.select("doc", F.size("w").alias("n_terms"), "w").select("doc", "n_terms", F.explode_outer("w").alias("term")).filter("term is not null").groupBy("term", "doc", "n_terms").agg(F.count(F.lit(1)).alias("tf"))
    stats = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n_terms").alias("avg_terms"))
    return Index(postings, lengths, stats, None, split)


def bm25(index: Index, queries: DataFrame, query: str, text: str, match_all: bool = False) -> DataFrame:
    """(query, doc, score) of every document with a term of the query (with ``match_all``: all its terms).

    All queries are answered by one plan. Repeated terms of a query count once; a query without terms has no rows. The
    query terms are broadcast if a count shows them to be few, so only postings of asked terms are shuffled; with a
    stored index few terms are also looked up by the scan, and their document frequencies are read, not counted."""
    asked = queries.select(F.col(query).alias("query"), F.explode(F.array_distinct(index.split(text))).alias("term"))
    words = asked.select("term").distinct()
    postings = index.postings
    if index.terms is not None:
        known = [r.term for r in words.limit(PUSHED_TERMS + 1).collect()]
        if 0 < len(known) <= PUSHED_TERMS:
            one_of = reduce(lambda a, b: a | b, [F.col("term") == w for w in known])
            postings, df = postings.filter(one_of), index.terms.filter(one_of)
        else:
            df = index.terms.join(small(words), "term", "left_semi")
        hits = postings.join(small(words), "term", "left_semi")
    else:
        hits = postings.join(small(words), "term", "left_semi")
        df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n_docs, avg_terms = (index.stats.select(c).scalar() for c in ("n_docs", "avg_terms"))
    idf = F.ln((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.select("term", idf.alias("idf"), avg_terms.alias("avg_terms")).withColumn("idf", F.when(F.col("idf") > 0, F.col("idf")).otherwise(F.lit(LEAST_IDF)))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_terms") / F.col("avg_terms")))
    scored = hits.join(few(weights, words, 1), "term").select("doc", "term", part.alias("part"))
    found = scored.join(small(asked), "term").groupBy("query", "doc").agg(F.sum("part").alias("score"), F.count(F.lit(1)).alias("matched"))
    if match_all:
        found = found.join(asked.groupBy("query").agg(F.count(F.lit(1)).alias("asked")), "query").filter("matched = asked").drop("asked")
    return found.select(F.col("query").alias(query), "doc", "score")


def top_k(scored: DataFrame, query: str, k: int, score: str = "score", descending: bool = True, ties: str = "doc", digits: int | None = 6) -> DataFrame:
    """The best k rows of each query with ``rank`` from 1; scores are compared as rounded, ties by ``ties``."""
    value = F.round(F.col(score), digits) if digits is not None else F.col(score)
    w = Window.partitionBy(query).orderBy(value.desc() if descending else value.asc(), F.col(ties))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def has_all_terms(text: str | Column, words: list[str]) -> Column:
    col = terms(text)
    return F.forall(F.array(*[F.lit(w) for w in words]), lambda w: F.array_contains(col, w))
