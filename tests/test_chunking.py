import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from finloom.config import ChunkConfig
from finloom.operators import analytics, chunking, records, transcripts


def _one(spark, col, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_windows_golden(spark):
    got = _one(spark, chunking.windows("n"), [(1500,), (0,), (800,), (801,), (None,)], "n int")
    pairs = [[tuple(w) for w in ws] for ws in got]
    assert pairs == [[(0, 800), (680, 1480), (1360, 1500)], [], [(0, 800)], [(0, 800), (680, 801)], []]


def test_window_overlaps_golden(spark):
    t = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(1500)))], "k int, text string")
    got = [tuple(r) for r in chunking.window_chunks(t, "k", "text").select("start_token", "end_token", "overlap_with_prev", "overlap_with_next").orderBy("start_token").collect()]
    assert got == [(0, 800, 0, 120), (680, 1480, 120, 120), (1360, 1500, 120, 0)]
    assert chunking.window_chunks(spark.createDataFrame([(1, None), (2, ""), (3, "  ")], "k int, text string"), "k", "text").count() == 0


def test_overlap_tokens(spark):
    assert _one(spark, chunking.overlap_tokens("n", 0.15), [(600,)], "n int") == [90]
    assert _one(spark, chunking.overlap_tokens("n", 0.2), [(800,)], "n int") == [160]


def test_window_coverage(spark):
    rows = [(n,) for n in range(1, 400, 7)]
    for cfg in (ChunkConfig(max_tokens=50, overlap_ratio=0.2), ChunkConfig(max_tokens=7, overlap_ratio=0.0)):
        for (n,), ws in zip(rows, _one(spark, chunking.windows("n", cfg), rows, "n int"), strict=True):
            at, want = 0, []
            while True:
                want.append((at, min(at + cfg.max_tokens, n)))
                if at + cfg.max_tokens >= n:
                    break
                at += cfg.step
            assert [tuple(w) for w in ws] == want


def _pack(sizes, target, least):
    out, n, c = [], 0, 0
    for u in sizes:
        if n and (c + u < target or c < least):
            c += u
        else:
            n, c = n + 1, u
        out.append(n)
    return out


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), max_size=30), min_size=1, max_size=8))
def test_pack_against_a_loop(spark, lists):
    got = _one(spark, chunking.pack("s", 600, 200), [(x,) for x in lists], "s array<int>")
    assert got == [_pack(x, 600, 200) for x in lists]


def test_merge_small(spark):
    assert _one(spark, chunking.merge_small("s", 5), [([1, 2, 6],), ([6, 6],), ([6, 1],), ([],), ([1],)], "s array<int>") == [[1, 1, 1], [1, 2], [1, 1], [], [1]]


def test_speaker_runs_and_exchanges(spark):
    t = spark.createDataFrame([(1, 1, "CEO"), (1, 2, "CEO"), (1, 3, "CFO"), (1, 4, None), (1, 5, None), (2, 1, "CEO")], "d int, o int, s string")
    assert [r.run for r in transcripts.runs(t, ["d"], "o", "s").orderBy("d", "o").collect()] == [1, 1, 2, 3, 3, 1]
    e = spark.createDataFrame([(1, 1, "a"), (1, 2, "q"), (1, 3, "x"), (1, 4, "a"), (1, 5, "a"), (1, 6, "q"), (1, 7, "q"), (1, 8, "a"), (1, 9, None)], "d int, o int, k string")
    got = [(r.exchange_no, r.exchange_role) for r in transcripts.exchanges(e, "d", "o", F.col("k") == "q", F.col("k") == "a").orderBy("o").collect()]
    assert got == [(None, None), (1, "question"), (None, None), (1, "answer"), (None, None), (2, "question"), (3, "question"), (3, "answer"), (None, None)]


def test_chunk_documents(spark):
    unit = "doc_id string, chunk_id string, doc_type string, section_id string, phase string, exchange_id string, unit_index int, text string"
    rows = [("f", f"f{i}", "10-K", "s1" if i < 3 else "s2", None, None, i, " ".join(["w"] * 150)) for i in range(6)]
    rows += [("t", "t1", "earnings_transcript", None, "prepared_remarks", None, 1, "hello all"), ("t", "t2", "earnings_transcript", None, "qa", "e1", 2, "q ?"), ("t", "t3", "earnings_transcript", None, "qa", "e1", 3, " ".join(["a"] * 900))]
    rows += [("t", "t4", "earnings_transcript", None, "qa", None, 4, "dropped"), ("t", "t5", "earnings_transcript", None, None, None, 5, "dropped"), ("x", "x1", "memo", None, None, None, 1, "dropped"), ("f", "f9", "10-K", "s1", None, None, 9, None)]
    got = chunking.chunk_documents(spark.createDataFrame(rows, unit)).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.chunk_type, r.chunk_tokens, r.start_token) for r in got] == [
        ("f_chunk_0001", "section_packed", 450, 0), ("f_chunk_0002", "section_packed", 450, 0),
        ("t_chunk_0001", "prepared_packed", 2, 0), ("t_chunk_0002", "windowed_overlap", 800, 0), ("t_chunk_0003", "windowed_overlap", 222, 680),
    ]
    assert got[0].source_units == ["f0", "f1", "f2"] and got[4].source_units == ["t2", "t3"]
    assert chunking.chunk_documents(spark.createDataFrame([], unit)).count() == 0


def test_semantic_chunks(spark):
    text = "A first paragraph.\n\nA second one. " + "x" * 30 + ".\n\n" + "y" * 95
    rows = chunking.semantic_chunks(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, text string"), "k", "text", 40).collect()
    assert {r.k for r in rows} == {1} and all(len(r.text) <= 40 and text[r.start : r.end] == r.text for r in rows)
    assert "".join("".join(r.text.split()) for r in rows) == "".join(text.split())


def test_phases_roles_sections(spark):
    assert _one(spark, transcripts.qa_start("t"), [("intro. First question from",), ("none",), ("first question ... question-and-answer session",), (None,)], "t string") == [8, None, 20, None]
    assert _one(spark, transcripts.role("t"), [("Jane, Chief Executive Officer",), ("the Operator",), ("X Securities",), (None,)], "t string") == ["ceo", "operator", "analyst", "unknown"]
    assert _one(spark, transcripts.clean_name("t"), [("Dr.  Jane   Doe",)], "t string") == ["Jane Doe"]
    t = spark.createDataFrame([(1, "Item 1. Business text Item 7. MD text Item 1A. risk")], "k int, t string")
    assert [(r.section_id, r.position, r.end) for r in transcripts.sections(t, "k", "t").orderBy("position").collect()] == [("item_1", 1, 22), ("item_7", 23, 38), ("item_1a", 39, 51)]
    u = spark.createDataFrame([(1, "Jane Doe: Welcome to all of you.\nJohn Roe (X): First question, why is that?\nJane Doe: Because it is so.\nJohn Roe: ok")], "k int, t string")
    assert [(r.speaker, r.phase, r.utterance_type) for r in transcripts.utterances(u, "k", "t").orderBy("idx").collect()] == [("Jane Doe", "prepared_remarks", "statement"), ("John Roe", "prepared_remarks", "statement"), ("Jane Doe", "qa", "answer")]


def test_records(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 1, "z"), (None, 3, None)], "k string, at int, v string")
    assert sorted((r.k or "", r.v or "") for r in records.upsert(t, ["k"], [F.col("at").desc()]).collect()) == [("", ""), ("a", "y")]
    f = records.fill_missing(spark.createDataFrame([("d", 1, None, None), ("d", 2, "", 5), ("e", 1, None, None)], "d string, o int, s string, n int"), ["d"], "o", {"s": F.lit("dflt"), "n": None})
    assert sorted((r.d, r.o, r.s, r.n) for r in f.collect()) == [("d", 1, "dflt", 5), ("d", 2, "dflt", 5), ("e", 1, "dflt", None)]
    assert _one(spark, records.recent_quarters(F.col("d"), 3), [(dt.date(2024, 2, 10),)], "d date") == [[dt.date(2024, 1, 1), dt.date(2023, 10, 1), dt.date(2023, 7, 1)]]
    assert _one(spark, records.category("t"), [("Risk Factors",), (None,), ("Oddities",)], "t string") == ["risk", "other", "other"]


def test_chunk_errors(spark):
    good = dict(chunk_id="d_chunk_0001", doc_id="d", ticker="T", doc_type="10-K", fiscal_year=2024, quarter="FY", period="2024-FY", chunk_tokens=300, start_token=0, end_token=0, chunk_type="section_packed", overlap_with_prev=0, text="x", chunked_at="t", speaker=None, speaker_role=None, phase=None, section_id="s")
    bad = good | dict(chunk_id="x", doc_type="memo", text=" ", chunk_tokens=900, ticker=None)
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in good.items())
    got = [r[0] for r in spark.createDataFrame([tuple(good.values()), tuple(bad.values())], schema).select(records.chunk_errors()).collect()]
    assert got[0] == [] and got[1] == ["missing: ticker", "enum: doc_type=memo", "text: blank", "chunk_id: form", "tokens: many"]


def test_analytics(spark):
    s = spark.createDataFrame([("strong growth",), ("weak decline and loss",), ("plain",), (None,)], "t string").select(analytics.sentiment("t").alias("s")).select("s.*").collect()
    assert [(r.label, r.score) for r in s] == [("positive", 1.0), ("negative", 1.0), ("neutral", 0.0), ("neutral", 0.0)]
    empty = analytics.aggregate_sentiment(spark.createDataFrame([], "label string, score double"), [], "label", "score").first()
    assert (empty.n, empty.label, empty.strength) == (0, "neutral", 0.0)
    m = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, None)], "q int, r int, rel boolean")
    got = {r.q: r for r in analytics.rank_measures(m, "q", "r", F.col("rel")).collect()}
    assert (got[1].hit_1, got[1].hit_3, got[1].precision_5, got[1].reciprocal_rank) == (0, 1, pytest.approx(2 / 3), 0.5) and got[2].reciprocal_rank == 0.0
    assert _one(spark, analytics.either_contains("a", "b"), [("AAPL", "aapl_10k"), ("", "x"), ("a", "b")], "a string, b string") == [True, False, False]
    assert _one(spark, analytics.answer_in("a", "b"), [("1,234", "was 1234 units"), ("", "x"), (None, "x")], "a string, b string") == [True, False, None]
