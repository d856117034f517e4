import math
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from finloom.config import SearchConfig
from finloom.operators import dense, fusion, lexical
from finloom.operators.predicates import compile_where

DOCS = [(1, "revenue grew at the seed plant", "10k"), (2, "freight cost and revenue revenue", "10q"), (3, "", "10k"), (4, None, None), (5, "cost of freight; cost of sales", "10k"), (6, "Revenue!", "q")]


def _fts5(query, rows):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(content, kind, tokenize='unicode61')")
    con.executemany("INSERT INTO t(rowid, content, kind) VALUES (?, ?, ?)", [(i, a or "", b or "") for i, a, b in rows])
    q = " AND ".join(f'"{w}"' for w in query.split())
    return dict(con.execute("SELECT rowid, -bm25(t) FROM t WHERE t MATCH ?", (q,)).fetchall())


@pytest.mark.parametrize("query", ["revenue", "freight cost", "cost of", "seed plant revenue", "nothing"])
def test_bm25_like_fts5(spark, query):
    docs = spark.createDataFrame(DOCS, "id bigint, content string, kind string")
    index = lexical.build_index(docs, "id", "content", "kind")
    q = spark.createDataFrame([("a", query)], "query string, text string")
    got = {r.doc: r.score for r in lexical.bm25(index, q, "query", "text", match_all=True).collect()}
    want = _fts5(query, DOCS)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_bm25_many_queries_and_ties(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(5)] + [(9, "other")], "id bigint, content string")
    q = spark.createDataFrame([(1, "words"), (2, ""), (3, None), (4, "other words words")], "query int, text string")
    top = lexical.top_k(lexical.bm25(lexical.build_index(docs, "id", "content"), q, "query", "text"), "query", 3)
    got = sorted((r.query, r["rank"], r.doc) for r in top.collect())
    assert [x for x in got if x[0] == 1] == [(1, 1, 0), (1, 2, 1), (1, 3, 2)]
    assert {x[0] for x in got} == {1, 4} and (4, 1, 9) in got
    empty = lexical.build_index(docs.limit(0), "id", "content")
    assert lexical.bm25(empty, q, "query", "text").count() == 0


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((200, 8)).astype(np.float32)
    v[5] = v[7]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0, 2.0]), (902, [float("nan")] * 8), (903, [None] * 8)]
    vec = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    q = vec.filter("vec_id in (7, 20, 901)").select(F.col("vec_id").alias("query"), "embedding")
    for metric, dist in (("l2", lambda a, b: ((a - b) ** 2).sum()), ("cosine", lambda a, b: 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b))):
        got = {}
        for r in dense.knn(vec, q, 5, metric=metric).orderBy("query", "rank").collect():
            got.setdefault(r.query, []).append(r.doc)
        for i in (7, 20):
            want = sorted(range(200), key=lambda j, i=i: (round(float(dist(v[i].astype(float), v[j].astype(float))), 6), j))[:5]
            assert got[i] == want
        assert got[901] == [901]
    assert dense.knn(vec.limit(0), q, 5).count() == 0


def test_lsh_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 32))
    v = [centres[i % 20] + 0.35 * rng.standard_normal(32) for i in range(1500)]
    vec = spark.createDataFrame([(i, [float(y) for y in x / np.linalg.norm(x)]) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>")
    q = vec.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "embedding")
    exact = {(r.query, r.doc) for r in dense.knn(vec, q, 10).collect()}
    near = {(r.query, r.doc) for r in dense.lsh_knn(vec, q, 10).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_check_vectors_and_cosine(spark):
    t = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("inf"), 0.0]), (5, [1.0])], "vec_id int, embedding array<float>")
    got = {r.vec_id: r.problem for r in dense.check_vectors(t, dim=2).collect()}
    assert got == {1: None, 2: None, 3: "missing", 4: "not finite", 5: "dimension"}
    assert t.filter("vec_id < 3").select(dense.cosine("embedding", "embedding").alias("c")).collect() == [(1.0,), (0.0,)]


def test_hash_embedder(spark):
    e = dense.hash_embedder(16)
    rows = spark.createDataFrame([("a b",), ("b a",), (None,), ("",)], "t string").select(e("t").alias("e")).collect()
    assert rows[0] == rows[1] and abs(np.linalg.norm(rows[0].e) - 1) < 1e-5 and not any(rows[2].e) and not any(rows[3].e)


def test_fusion(spark):
    leg = lambda rows: spark.createDataFrame(rows, "query int, doc string, rank int")
    legs = {"lexical": (leg([(1, "a", 1), (1, "b", 2), (1, "b", 5), (2, "z", 1)]), 0.5), "dense": (leg([(1, "b", 1), (1, "c", 2)]), 1.5)}
    fused = fusion.fuse(legs)
    got = {(r.query, r.doc): r.score for r in fused.collect()}
    want = {(1, "a"): 0.25 / 61, (1, "b"): 0.25 / 62 + 0.75 / 61, (1, "c"): 0.75 / 62, (2, "z"): 0.25 / 61}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    best = fusion.best(fused, ["lexical", "dense"], 2)
    assert [(r.query, r["rank"], r.doc) for r in best.orderBy("query", "rank").collect()] == [(1, 1, "b"), (1, 2, "c"), (2, 1, "z")]
    said = {r.doc: r.explanation for r in fusion.explain(best, ["lexical", "dense"]).collect()}
    assert said["c"] == "lexical: not retrieved; dense: rank 2"
    with pytest.raises(ValueError):
        fusion.fuse({"a": (legs["dense"][0], 0)})
    # Equal weights and ranks in other legs: the earlier leg goes first.
    tie = fusion.best(fusion.fuse({"lexical": (leg([(1, "x", 1)]), 1), "dense": (leg([(1, "a", 1)]), 1)}), ["lexical", "dense"], 2)
    assert [r.doc for r in tie.orderBy("rank").collect()] == ["x", "a"]
    assert SearchConfig().fetch(10) == 30 and SearchConfig().fetch(50) == 100 and SearchConfig(lexical_weight=1, dense_weight=3).weights() == (0.25, 0.75)


def test_scores_of_models(spark):
    t = spark.createDataFrame([("Score: 0.8",), ("7 of 10",), ("none",), (None,), ("[0.1, 3, 0.5]",), ("a 0.2 b 0.4",)], "t string")
    assert [r[0] for r in t.select(fusion.parse_score("t")).collect()] == [0.8, 1.0, 0.5, 0.5, 0.1, 0.2]
    assert [r[0] for r in t.select(fusion.parse_scores("t", 2)).collect()] == [[0.8, 0.5], [1.0, 1.0], [0.5, 0.5], [0.5, 0.5], [0.1, 1.0], [0.2, 0.4]]
    adj = t.limit(1).select(fusion.adjust(F.lit(0.9), [(F.lit(False), F.lit(0.1)), (F.lit(True), F.lit(1.4))]))
    assert adj.first()[0] == 1.0


@pytest.mark.parametrize("text, want", [("revenue in 2023 and 2024?", ("annual", 2024, None)), ("q3 2024 margin", ("quarterly", 2024, 3)), ("the second quarter of fiscal 23", ("quarterly", 2023, 2)), ("fy99 sales", ("annual", 1999, None)), (None, ("annual", None, None))])
def test_intent(spark, text, want):
    t = spark.createDataFrame([(text,)], "q string").select(fusion.query_intent("q").alias("i")).first().i
    assert tuple(t) == want


def test_predicates(spark):
    t = spark.createDataFrame([(1, "a", 2020), (2, "b", 2021), (3, None, 2022)], "id int, ticker string, year int")
    ids = lambda w, **k: [r.id for r in t.filter(compile_where(w, **k)).orderBy("id").collect()]
    assert ids({}) == ids(None) == [1, 2, 3]
    assert ids({"ticker": "a"}) == [1] and ids({"company": "b"}, aliases={"company": "ticker"}) == [2]
    assert ids({"ticker": {"$ne": "a"}}) == [2, 3] and ids({"ticker": {"$nin": ["a"]}}) == [2, 3] and ids({"ticker": None}) == [3]
    assert ids({"year": {"$gt": 2020, "$lte": 2022}}) == [2, 3] and ids({"year": {"$in": [2020, 2022]}}) == [1, 3]
    assert ids({"$or": [{"$and": [{"ticker": "a"}, {"year": {"$lt": 2021}}]}, {"year": {"$gte": 2022}}]}) == [1, 3]
    for bad in ({"year": {"$near": 1}}, {"$not": []}, {"$and": []}):
        with pytest.raises(ValueError):
            compile_where(bad)


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).withColumn("year", F.lit(2020)).withColumn("text", F.lit("x")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).filter(compile_where({"year": {"$gte": 2021}})).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(year,2021)" in plan and "text" not in plan.split("ReadSchema")[1]
