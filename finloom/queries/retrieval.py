"""Retrieval: predicates, BM25, nearest neighbours, fusion, reranking, prompts and their measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finloom.functions.text import MARKED, terms, words
from finloom.operators import analytics, dense, fusion, lexical, records
from finloom.operators.predicates import compile_where
from finloom.plans.runtime import few, kept, small, table
from finloom.queries import query
from finloom.queries.text import _terms
from finloom.sources import sinks


def _where(spark: SparkSession, d: str, where: dict) -> DataFrame:
    return table(spark, d, "chunks").filter(compile_where(where, {"company": "ticker"})).select("chunk_key", "ticker", "doc_type", "fiscal_year", "quarter")


_COLS = "SELECT chunk_key, ticker, doc_type, fiscal_year, quarter FROM chunks WHERE "


@query(_COLS + "ticker = 'ZNLN'")
def filter_eq(spark: SparkSession, d: str) -> DataFrame:
    return _where(spark, d, {"company": "ZNLN"})


@query(_COLS + "fiscal_year >= 2020 AND fiscal_year <= 2022")
def filter_range(spark: SparkSession, d: str) -> DataFrame:
    return _where(spark, d, {"fiscal_year": {"$gte": 2020, "$lte": 2022}})


@query(_COLS + "quarter IN ('Q1', 'FY')")
def filter_in(spark: SparkSession, d: str) -> DataFrame:
    return _where(spark, d, {"quarter": {"$in": ["Q1", "FY"]}})


@query(_COLS + "ticker = 'QVXA' AND doc_type = '10-K'")
def filter_and(spark: SparkSession, d: str) -> DataFrame:
    return _where(spark, d, {"ticker": "QVXA", "doc_type": "10-K"})


@query(_COLS + "(doc_type = '10-Q' AND fiscal_year > 2021) OR (quarter NOT IN ('Q1', 'Q2') AND ticker <> 'ZNLN' AND fiscal_year < 2019)")
def filter_tree(spark: SparkSession, d: str) -> DataFrame:
    return _where(spark, d, {"$or": [{"$and": [{"doc_type": "10-Q"}, {"fiscal_year": {"$gt": 2021}}]}, {"quarter": {"$nin": ["Q1", "Q2"]}, "ticker": {"$ne": "ZNLN", "$gt": ""}, "fiscal_year": {"$lt": 2019}}]})


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every item whose id is divisible by 100."""
    return table(spark, d, "eval_questions").filter("item_id % 100 = 0").select(F.col("item_id").alias("query"), "question", "ticker")


def _index(spark: SparkSession, d: str, split=terms) -> lexical.Index:
    """The stored index of the documents, built by the first query that asks it."""
    build = lambda path: sinks.save_index(lexical.build_index(table(spark, d, "documents"), "doc_id", "text", "ticker", "doc_type", split=split), path)
    return sinks.read_index(spark, kept(spark, f"{split.__name__} {d}", build), split)


_WORDS = "concat(" + ", ".join(_terms(f"coalesce({c}, '')") for c in ("text", "ticker", "doc_type")) + ")"
_WORDS = " || ".join(_terms(f"coalesce({c}, '')") for c in ("text", "ticker", "doc_type"))
_BM25 = f"""
w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS t FROM documents), len AS (SELECT doc_id, len(t) AS dl FROM w), st AS (SELECT count(*) AS n, avg(dl) AS al FROM len),
q AS (SELECT DISTINCT item_id AS query, term FROM (SELECT item_id, unnest({_terms('question')}) AS term FROM eval_questions WHERE item_id % 100 = 0)),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
idf AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf, al FROM df, st),
s AS (SELECT query, p.doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))) AS score, count(*) AS matched FROM p JOIN q USING (term) JOIN idf USING (term) JOIN len USING (doc_id) GROUP BY query, p.doc_id),
lex AS (SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s)"""


@query(f"WITH {_BM25} SELECT query, doc_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM lex WHERE rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    got = lexical.top_k(lexical.bm25(_index(spark, d), _questions(spark, d), "query", "question"), "query", 10)
    return got.select("query", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_SHORT = "seed plant freight cost"


@query(f"SELECT doc_id FROM documents WHERE list_has_all({_terms('text')}, {_SHORT.split()})")
def match_all_terms(spark: SparkSession, d: str) -> DataFrame:
    """AND of all terms as a predicate of the scan, for one short query."""
    return table(spark, d, "documents").filter(lexical.has_all_terms("text", _SHORT.split())).select("doc_id")


@query(f"WITH {_BM25.replace('WHERE item_id % 100 = 0', 'WHERE item_id % 100 = 0 AND false UNION ALL SELECT 1, unnest(' + str(_SHORT.split()) + ')')} SELECT query, doc_id, round(score, 6) AS score FROM s WHERE matched = {len(_SHORT.split())}")
def bm25_and(spark: SparkSession, d: str) -> DataFrame:
    q = spark.createDataFrame([(1, _SHORT)], "query bigint, question string")
    got = lexical.bm25(_index(spark, d), q, "query", "question", match_all=True)
    return got.select("query", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"SELECT item_id, count(*) AS docs FROM (SELECT DISTINCT item_id, doc_id FROM (SELECT item_id, unnest({_terms('question')}) AS term FROM eval_questions WHERE item_id % 100 = 0) JOIN (SELECT doc_id, unnest({_terms('text')}) AS term FROM documents) USING (term)) GROUP BY item_id")
def semi_terms(spark: SparkSession, d: str) -> DataFrame:
    """For each stated query, the documents that share a term: partial sets of terms first, then the join."""
    q = _questions(spark, d).select(F.col("query").alias("item_id"), F.explode(F.array_distinct(lexical.terms("question"))).alias("term"))
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(lexical.terms("text"))).alias("term"))
    return docs.join(q, "term").select("item_id", "doc_id").distinct().groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"))


@query("SELECT count(*) AS docs, count(DISTINCT source) AS sources, count(text) AS with_text FROM documents")
def corpus_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("docs"), F.countDistinct("source").alias("sources"), F.count("text").alias("with_text"))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings")
    return v, v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "embedding")


_L2 = "list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_KNN = f"den AS (SELECT b.vec_id AS query, a.vec_id AS doc_id, {_L2} AS distance FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0), knn AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 6), doc_id) AS rank FROM den)"


@query(f"WITH {_KNN} SELECT query, doc_id, round(distance, 6) AS distance, CAST(rank AS BIGINT) AS rank FROM knn WHERE rank <= 10")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    return dense.knn(*_vectors(spark, d), 10).select("query", F.col("doc").alias("doc_id"), F.abs(F.round("distance", 6)).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


@query()
def knn_lsh(spark: SparkSession, d: str) -> DataFrame:
    """Approximate; its recall against knn_topk is measured in the tests."""
    return dense.lsh_knn(*_vectors(spark, d), 10).select("query", F.col("doc").alias("doc_id"), F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


@query("""SELECT a.vec_id, b.vec_id AS other, round(list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda z: z[1] * z[2])) /
  (sqrt(list_sum(list_transform(CAST(a.embedding AS DOUBLE[]), lambda x: x * x))) * sqrt(list_sum(list_transform(CAST(b.embedding AS DOUBLE[]), lambda x: x * x)))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with its successor."""
    v = table(spark, d, "embeddings")
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("next")), "vec_id").select("vec_id", "other", F.round(dense.cosine("embedding", "next"), 6).alias("cosine"))


@query("SELECT vec_id, (embedding IS NOT NULL AND len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))) AS ok FROM embeddings")
def validate_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return dense.check_vectors(table(spark, d, "embeddings")).select("vec_id", "ok")


@query()
def embed_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", dense.hash_embedder()("text").alias("embedding"))


def _legs(spark: SparkSession, d: str, fetch: int) -> dict[str, tuple[DataFrame, float]]:
    """Lexical ranks of the stated questions and dense ranks of the vectors of the same ids."""
    lex = lexical.top_k(lexical.bm25(_index(spark, d), _questions(spark, d), "query", "question"), "query", fetch).select("query", "doc", "rank")
    v, q = _vectors(spark, d)
    den = dense.knn(v, q, fetch).join(small(_questions(spark, d).select("query")), "query", "left_semi").select("query", "doc", "rank")
    return {"lexical": (lex, 0.5), "dense": (den, 0.5)}


_FUSED = f"""WITH {_BM25}, {_KNN},
l AS (SELECT query, doc_id, rank FROM lex WHERE rank <= 30), v AS (SELECT query, doc_id, rank FROM knn WHERE rank <= 30 AND query IN (SELECT item_id FROM eval_questions WHERE item_id % 100 = 0)),
f AS (SELECT coalesce(l.query, v.query) AS query, coalesce(l.doc_id, v.doc_id) AS doc_id, l.rank AS lr, v.rank AS dr, coalesce(0.5 / (60 + l.rank), 0) AS ls, coalesce(0.5 / (60 + v.rank), 0) AS ds FROM l FULL OUTER JOIN v ON l.query = v.query AND l.doc_id = v.doc_id),
o AS (SELECT *, ls + ds AS score, row_number() OVER (PARTITION BY query ORDER BY round(ls + ds, 9) DESC, least(coalesce(lr, 2147483647), coalesce(dr, 2147483647)), coalesce(lr, 2147483647), coalesce(dr, 2147483647), doc_id) AS rank FROM f)"""


@query(_FUSED + " SELECT query, doc_id, round(score, 9) AS score FROM o")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(_legs(spark, d, 30)).select("query", F.col("doc").alias("doc_id"), F.round("score", 9).alias("score"))


@query(_FUSED + " SELECT query, doc_id, round(score, 9) AS score, CAST(rank AS BIGINT) AS rank FROM o WHERE rank <= 10")
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    got = fusion.best(fusion.fuse(_legs(spark, d, 30)), ["lexical", "dense"], 10)
    return got.select("query", F.col("doc").alias("doc_id"), F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(_FUSED + " SELECT query, doc_id, CAST(rank AS BIGINT) AS rank, 'lexical: ' || coalesce('rank ' || lr, 'not retrieved') || '; dense: ' || coalesce('rank ' || dr, 'not retrieved') AS explanation, round(ls, 9) AS lexical_score, round(ds, 9) AS dense_score FROM o WHERE rank <= 10")
def explain_hybrid(spark: SparkSession, d: str) -> DataFrame:
    legs = ["lexical", "dense"]
    got = fusion.explain(fusion.best(fusion.fuse(_legs(spark, d, 30)), legs, 10), legs)
    return got.select("query", F.col("doc").alias("doc_id"), F.col("rank").cast("bigint").alias("rank"), "explanation", F.round("lexical_score", 9).alias("lexical_score"), F.round("dense_score", 9).alias("dense_score"))


@query("SELECT a AS lexical, b AS dense, abs(a - b) <= 0.1 * greatest(a, b) AS parity FROM (SELECT count(*) AS a FROM documents), (SELECT count(*) AS b FROM embeddings)")
def index_parity(spark: SparkSession, d: str) -> DataFrame:
    count = lambda t: table(spark, d, t).agg(F.count(F.lit(1))).scalar()
    both = spark.range(1).select(count("documents").alias("lexical"), count("embeddings").alias("dense"))
    return both.withColumn("parity", F.abs(F.col("lexical") - F.col("dense")) <= 0.1 * F.greatest("lexical", "dense"))


_RERANK = _FUSED + """, pool AS (SELECT o.*, dd.lang, dd.text, dd.source, least(1.0, score * 60) AS base FROM o JOIN documents dd USING (doc_id) WHERE rank <= 20),
r AS (SELECT *, greatest(0.0, least(1.0, CASE WHEN lang IS NULL THEN base * 0.5 WHEN length(text) < 200 THEN least(base, 0.3) ELSE base END)) AS s FROM pool),
z AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 6) DESC, doc_id) AS place FROM r)"""


def _reranked(spark: SparkSession, d: str, k: int) -> DataFrame:
    """The fused pool of 20, adjusted by rules given as data (short texts are capped, unknown languages halved)."""
    pool = fusion.best(fusion.fuse(_legs(spark, d, 30)), ["lexical", "dense"], 20).withColumnRenamed("doc", "doc_id")
    rows = table(spark, d, "documents").select("doc_id", "lang", "text", "source").join(few(pool, _questions(spark, d), 20), "doc_id")
    s = F.least(F.lit(1.0), F.col("score") * 60)
    rows = rows.withColumn("s", fusion.adjust(s, [(F.col("lang").isNull(), s * 0.5), (F.length("text") < 200, F.least(s, F.lit(0.3)))]))
    return lexical.top_k(rows.drop("rank"), "query", k, "s", ties="doc_id")


@query(_RERANK + " SELECT query, doc_id, round(s, 6) AS score, CAST(place AS BIGINT) AS rank FROM z WHERE place <= 5")
def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d, 5).select("query", "doc_id", F.round("s", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(_RERANK + " SELECT query, doc_id, CAST(place AS BIGINT) AS rank, source, substr(text, 1, 500) AS excerpt FROM z WHERE place <= 5")
def retrieve_context(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d, 5).select("query", "doc_id", F.col("rank").cast("bigint").alias("rank"), "source", F.substring("text", 1, 500).alias("excerpt"))


@query(_RERANK + """ SELECT z.query, string_agg('Source ' || place || ' (' || coalesce(source, 'unknown') || '):' || chr(10) || substr(coalesce(text, ''), 1, 500), chr(10) || chr(10) ORDER BY place) || chr(10) || chr(10) || 'Question: ' || any_value(q.question) AS prompt
  FROM z JOIN eval_questions q ON q.item_id = z.query WHERE place <= 5 GROUP BY z.query""")
def build_prompt(spark: SparkSession, d: str) -> DataFrame:
    rows = _reranked(spark, d, 5).join(small(_questions(spark, d).select("query", "question")), "query")
    return fusion.build_prompts(rows, "query", "rank", "source", "text", "question")


@query(r"""SELECT item_id, CASE WHEN quarterly THEN 'quarterly' ELSE 'annual' END AS period_type,
  coalesce(list_max(list_transform(regexp_extract_all(q, '\b(20\d\d)\b', 1), lambda x: CAST(x AS INT))), CASE WHEN y < 50 THEN 2000 + y ELSE 1900 + y END) AS fiscal_year,
  CASE WHEN quarterly THEN coalesce(CAST(nullif(regexp_extract(q, '\bq([1-4])\b', 1), '') AS INT), CASE WHEN contains(q, 'first quarter') THEN 1 WHEN contains(q, 'second quarter') THEN 2 WHEN contains(q, 'third quarter') THEN 3 WHEN contains(q, 'fourth quarter') THEN 4 END) END AS quarter
  FROM (SELECT item_id, lower(question) AS q, regexp_matches(lower(question), '\bq[1-4]\b|quarter') AS quarterly, CAST(nullif(regexp_extract_all(lower(question), '(?:fy|fiscal)\s*''?(\d\d)\b', 1)[-1], '') AS INT) AS y FROM eval_questions)""")
def query_intent(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_questions").select("item_id", fusion.query_intent("question").alias("i")).select("item_id", "i.*")


@query(r"SELECT item_id, CASE WHEN regexp_matches(answer_value, '\d') THEN greatest(0.0, least(1.0, CAST(regexp_extract(answer_value, '(\d+\.?\d*)', 1) AS DOUBLE))) ELSE 0.5 END AS score FROM eval_questions")
def parse_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_questions").select("item_id", fusion.parse_score("answer_value").alias("score"))


@query(r"""SELECT item_id, list_slice(list_concat(list_transform(regexp_extract_all('0.25, ' || item_id % 3, '(\d+\.?\d*)', 1), lambda x: greatest(0.0, least(1.0, CAST(x AS DOUBLE)))), [0.5, 0.5, 0.5]), 1, 3) AS scores FROM eval_questions""")
def parse_scores(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.coalesce("answer_value", F.lit("")), F.lit(" [0.25, "), (F.col("item_id") % 3).cast("string"), F.lit("]"))
    return table(spark, d, "eval_questions").select("item_id", fusion.parse_scores(said, 3).alias("scores"))


_IR = _FUSED + ", j AS (SELECT o.query, o.rank, coalesce(dd.ticker = q.ticker, false) AS rel, q.category FROM o JOIN eval_questions q ON q.item_id = o.query JOIN documents dd USING (doc_id) WHERE rank <= 30)"


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """A document counts as relevant if it is about the question's company."""
    got = fusion.best(fusion.fuse(_legs(spark, d, 30)), ["lexical", "dense"], 30).withColumnRenamed("doc", "doc_id")
    q = table(spark, d, "eval_questions").select(F.col("item_id").alias("query"), F.col("ticker").alias("asked"), "category")
    return table(spark, d, "documents").select("doc_id", "ticker").join(few(got.select("query", "doc_id", "rank"), _questions(spark, d), 30), "doc_id").join(small(q), "query").withColumn("rel", F.col("ticker") == F.col("asked"))


_MEASURES = ", ".join(f"max(CASE WHEN rel AND rank <= {k} THEN 1 ELSE 0 END) AS hit_{k}, sum(CASE WHEN rel AND rank <= {k} THEN 1.0 ELSE 0.0 END) / least({k}, count(*)) AS precision_{k}" for k in (1, 3, 5)) + ", coalesce(1.0 / min(CASE WHEN rel THEN rank END), 0.0) AS reciprocal_rank"


@query(_IR + f" SELECT query, {_MEASURES} FROM j GROUP BY query")
def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    return analytics.rank_measures(_judged(spark, d), "query", "rank", F.col("rel"))


@query(_IR + f" SELECT coalesce(category, 'all') AS category, count(*) AS n, round(avg(hit_5), 6) AS hit_5, round(avg(precision_5), 6) AS precision_5, round(avg(reciprocal_rank), 6) AS mrr, round(max(reciprocal_rank), 6) AS best FROM (SELECT query, any_value(category) AS category, {_MEASURES} FROM j GROUP BY query) GROUP BY ROLLUP (category)")
def ir_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = _judged(spark, d)
    per = analytics.rank_measures(rows, "query", "rank", F.col("rel")).join(rows.select("query", "category").distinct(), "query")
    r6 = lambda c, n: F.round(c, 6).alias(n)
    out = per.rollup("category").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("hit_5"), "hit_5"), r6(F.avg("precision_5"), "precision_5"), r6(F.avg("reciprocal_rank"), "mrr"), r6(F.max("reciprocal_rank"), "best"))
    return out.withColumn("category", F.coalesce("category", F.lit("all")))


@query("""SELECT i.item_id, count(*) AS docs, count_if(length(i.answer_value) > 0 AND contains(replace(lower(dd.text), ',', ''), replace(lower(i.answer_value), ',', ''))) AS with_answer
  FROM eval_questions i JOIN documents dd ON length(dd.ticker) > 0 AND length(i.ticker) > 0 AND (contains(lower(dd.ticker), lower(i.ticker)) OR contains(lower(i.ticker), lower(dd.ticker))) WHERE i.item_id % 100 = 0 GROUP BY i.item_id""")
def ir_hits(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose source name contains the expected one or the other way round, and those that hold the answer."""
    q = table(spark, d, "eval_questions").filter("item_id % 100 = 0").select("item_id", F.col("ticker").alias("asked"), "answer_value")
    docs = table(spark, d, "documents").select("ticker", "text")
    rows = docs.join(small(q), analytics.either_contains("ticker", "asked"))
    return rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"), F.count_if(analytics.answer_in("answer_value", "text")).alias("with_answer"))


@query(_FUSED + " SELECT query, doc_id, CASE WHEN lr IS NOT NULL AND dr IS NOT NULL THEN 'both' WHEN lr IS NOT NULL THEN 'lexical' ELSE 'dense' END AS leg FROM o")
def union_hits(spark: SparkSession, d: str) -> DataFrame:
    leg = F.when(F.col("lexical_rank").isNotNull() & F.col("dense_rank").isNotNull(), "both").when(F.col("lexical_rank").isNotNull(), "lexical").otherwise("dense")
    return fusion.fuse(_legs(spark, d, 30)).select("query", F.col("doc").alias("doc_id"), leg.alias("leg"))


@query("SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def anti_delete(spark: SparkSession, d: str) -> DataFrame:
    """Documents left after the deletion of those whose ids the vectors have."""
    return records.delete_by_ids(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


def _any_script(c: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(lower({c}), '{''.join(MARKED)}', '{''.join(MARKED.values())}'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


_W_WORDS = " || ".join(_any_script(f"coalesce({c}, '')") for c in ("text", "ticker", "doc_type"))
_INDEX = f"""
w AS MATERIALIZED (SELECT doc_id, {_W_WORDS} AS t FROM documents), len AS (SELECT doc_id, len(t) AS dl FROM w), st AS (SELECT count(*) AS n, avg(dl) AS al FROM len),
q AS (SELECT DISTINCT item_id AS query, term FROM (SELECT item_id, unnest({_any_script('question')}) AS term FROM eval_questions WHERE QUERIES)),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
idf AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf, al FROM df, st),
s AS (SELECT query, p.doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))) AS score, count(*) AS matched FROM p JOIN q USING (term) JOIN idf USING (term) JOIN len USING (doc_id) GROUP BY query, p.doc_id),
lex AS (SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s)"""
_STATED, _EVERY = _INDEX.replace("QUERIES", "item_id % 100 = 0"), _INDEX.replace("QUERIES", "true")


@query(f"SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df FROM (SELECT doc_id, unnest({_W_WORDS}) AS term FROM documents) GROUP BY term")
def index_terms(spark: SparkSession, d: str) -> DataFrame:
    """Words of any script with their document frequencies, as the stored index has them."""
    return _index(spark, d, words).terms


@query(f"WITH {_STATED} SELECT query, doc_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM lex WHERE rank <= 10")
def index_topk(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over words of any script, from the stored index."""
    got = lexical.top_k(lexical.bm25(_index(spark, d, words), _questions(spark, d), "query", "question"), "query", 10)
    return got.select("query", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_EVERY} SELECT query, doc_id, round(score, 6) AS score FROM s WHERE matched = (SELECT count(*) FROM q WHERE q.query = s.query)")
def index_all_terms(spark: SparkSession, d: str) -> DataFrame:
    """AND search: documents with all words of a question, for every question."""
    q = table(spark, d, "eval_questions").select(F.col("item_id").alias("query"), "question")
    got = lexical.bm25(_index(spark, d, words), q, "query", "question", match_all=True)
    return got.select("query", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


_HYBRID = _FUSED.replace(_BM25, _STATED)


@query(_HYBRID + " SELECT query, doc_id, round(score, 9) AS score, CAST(rank AS BIGINT) AS rank FROM o WHERE rank <= 10")
def index_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Fused ranks of the stored index over words of any script and of the vectors."""
    lex = lexical.top_k(lexical.bm25(_index(spark, d, words), _questions(spark, d), "query", "question"), "query", 30).select("query", "doc", "rank")
    legs = {**_legs(spark, d, 30), "lexical": (lex, 0.5)}
    got = fusion.best(fusion.fuse(legs), ["lexical", "dense"], 10)
    return got.select("query", F.col("doc").alias("doc_id"), F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_LEXICAL_IR = f"""WITH {_EVERY}, j AS (SELECT lex.query, lex.rank, coalesce(dd.ticker = i.ticker, false) AS rel, i.category FROM lex JOIN eval_questions i ON i.item_id = lex.query JOIN documents dd USING (doc_id) WHERE rank <= 5),
m AS (SELECT query, any_value(category) AS category, max(CASE WHEN rel AND rank <= 1 THEN 1.0 ELSE 0.0 END) AS h1, max(CASE WHEN rel AND rank <= 3 THEN 1.0 ELSE 0.0 END) AS h3, max(CASE WHEN rel THEN 1.0 ELSE 0.0 END) AS h5, coalesce(1.0 / min(CASE WHEN rel THEN rank END), 0.0) AS rr FROM j GROUP BY query)"""


@query(_LEXICAL_IR + " SELECT coalesce(category, 'all') AS category, count(*) AS n, round(100 * avg(h1), 6) AS hit_1, round(100 * avg(h3), 6) AS hit_3, round(100 * avg(h5), 6) AS hit_5, round(avg(rr), 6) AS mrr FROM m GROUP BY ROLLUP (category)")
def lexical_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Measures of the lexical leg alone over all questions, in percent, by category and over all."""
    q = table(spark, d, "eval_questions").select(F.col("item_id").alias("query"), "question", F.col("ticker").alias("asked"), "category")
    hits = lexical.top_k(lexical.bm25(_index(spark, d, words), q, "query", "question"), "query", 5).select("query", F.col("doc").alias("doc_id"), "rank")
    rows = table(spark, d, "documents").select("doc_id", "ticker").join(few(hits, q, 5), "doc_id").join(small(q.drop("question")), "query")
    rel = F.coalesce(F.col("ticker") == F.col("asked"), F.lit(False))
    hit = lambda k: F.max(F.when(rel & (F.col("rank") <= k), 1.0).otherwise(0.0)).alias(f"h{k}")
    per = rows.groupBy("query", "category").agg(hit(1), hit(3), hit(5), F.coalesce(1.0 / F.min(F.when(rel, F.col("rank"))), F.lit(0.0)).alias("rr"))
    out = per.rollup("category").agg(F.count(F.lit(1)).alias("n"), *[F.round(100 * F.avg(f"h{k}"), 6).alias(f"hit_{k}") for k in (1, 3, 5)], F.round(F.avg("rr"), 6).alias("mrr"))
    return out.withColumn("category", F.coalesce("category", F.lit("all")))


_OVERLAP = _FUSED.replace("o AS (SELECT *, ls + ds", "o0 AS (SELECT *, ls + ds") + """, ws AS (SELECT unnest([0.3, 0.5, 0.7]) AS lw),
r3 AS (SELECT lw, query, doc_id, row_number() OVER (PARTITION BY lw, query ORDER BY round(2 * (lw * ls + (1 - lw) * ds), 9) DESC, least(coalesce(lr, 2147483647), coalesce(dr, 2147483647)), coalesce(lr, 2147483647), coalesce(dr, 2147483647), doc_id) AS rank FROM f, ws)"""


@query(_OVERLAP + " SELECT a.lw AS lexical_weight, a.query, count(b.doc_id) AS shared FROM r3 a LEFT JOIN r3 b ON b.lw = 0.5 AND b.query = a.query AND b.doc_id = a.doc_id AND b.rank <= 3 WHERE a.rank <= 3 GROUP BY a.lw, a.query")
def weight_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How many of the best three under several weights are also among the best three under equal weights."""
    legs, names = _legs(spark, d, 30), ["lexical", "dense"]
    best = lambda w: fusion.best(fusion.fuse({"lexical": (legs["lexical"][0], w), "dense": (legs["dense"][0], 1 - w)}), names, 3)
    even = best(0.5).select("query", "doc", F.lit(1).alias("hit"))
    parts = [best(w).select(F.lit(w).cast("decimal(2,1)").alias("lexical_weight"), "query", "doc").join(even, ["query", "doc"], "left") for w in (0.3, 0.5, 0.7)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lexical_weight", "query").agg(F.count("hit").alias("shared"))
