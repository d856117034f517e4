import random
import sqlite3

from pyspark.sql import functions as F

from finloom.engine import Engine
from finloom.functions.stem import stem, stems
from finloom.operators.units import filing_units, transcript_units
from finloom.plans.pipeline import build_chunks, build_indexes, build_units, ingest_folder
from finloom.schemas import UNIT_SCHEMA
from finloom.sources.sinks import read_index

PAGE = "<html><body><h1>Item 1. Business</h1><p>We make clocks of all kinds and sell them everywhere.</p><p>short</p><h2>Item 1A. Risk Factors</h2><p>Clocks may stop, and people may stop buying clocks.</p></body></html>"
CALL = "Jane Doe: Welcome to the call of the clock company.\nOperator Desk: First question please, who asks?\nJohn Roe (X Securities): What of the margin this year?\nJane Doe: It rose by a third, we think.\nJane Doe: And it will rise again."


def _filings(spark):
    return spark.createDataFrame([("F1", "CLK", "10-K", 2024, "FY", "2024-02-01", "f.htm", PAGE), ("F2", "CLK", "10-K", 2023, "FY", None, "g.htm", None)], "doc_id string, ticker string, form_type string, fiscal_year int, quarter string, filing_date string, source_file string, html string")


def _calls(spark):
    return spark.createDataFrame([("T1", "CLK", 2024, "Q1", "2024-03-01", "t.txt", CALL)], "doc_id string, ticker string, fiscal_year int, quarter string, filing_date string, source_file string, text string")


def test_units(spark):
    u = filing_units(_filings(spark))
    assert u.columns == UNIT_SCHEMA.names
    assert [(r.unit_index, r.section_id, r.text[:12]) for r in u.orderBy("unit_index").collect()] == [(0, "item_1", "We make cloc"), (1, "item_1a", "## Item 1A. "), (2, "item_1a", "Clocks may s")]
    t = transcript_units(_calls(spark)).orderBy("unit_index").collect()
    assert [(r.speaker_name, r.utterance_type, r.exchange_id) for r in t][2:] == [("John Roe", "question", "ex_001"), ("Jane Doe", "answer", "ex_001"), ("Jane Doe", "answer", None)]


def test_build_and_search(spark, tmp_path):
    units = build_units(_filings(spark), _calls(spark), str(tmp_path))
    chunks = build_chunks(units, str(tmp_path))
    assert {r.chunk_type for r in chunks.collect()} == {"section_packed", "prepared_packed", "qa_exchange"}
    build_indexes(chunks, str(tmp_path), least_tokens=1)
    e = Engine(chunks, index=read_index(spark, str(tmp_path / "lexical")), vectors=spark.read.parquet(str(tmp_path / "vectors")))
    q = spark.createDataFrame([(1, "people buying clocks"), (2, "margin rose"), (3, "")], "query int, question string")
    top = {r.query: r.doc for r in e.search(q, 3).filter("rank = 1").collect()}
    text = {r.chunk_id: r.text for r in chunks.collect()}
    assert "stop buying" in text[top[1]] and "rose" in text[top[2]]
    only = e.search(q, 5, {"doc_type": "earnings_transcript"}).join(chunks.withColumnRenamed("chunk_id", "doc"), "doc")
    assert {r.doc_type for r in only.collect()} == {"earnings_transcript"}
    said = e.explain(q, 1).filter("query = 1").first().explanation
    assert said.startswith("lexical: rank 1")
    worst = e.retrieve(q.filter("query = 1"), 1, rescore=lambda df: df.withColumn("rescored", -F.col("score"))).first()
    assert worst.doc != top[1]
    assert "Source 1 (" in e.prompts(q, 2).filter("query = 2").first().prompt and e.stats().first().chunks == chunks.count()


def test_ingest_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("One paragraph.\n\nAnother one.")
    (tmp_path / "in" / "b.zip").write_bytes(b"x")
    rows = ingest_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), 20).collect()
    assert sorted(r.text for r in rows) == ["Another one.", "One paragraph."]
    assert spark.read.parquet(str(tmp_path / "out" / "errors")).count() == 1


def test_porter_like_fts5(spark):
    rng = random.Random(8)
    roots = "relat condit valenc hesit digit conform radic differ vile analog vietnam predic operat feudal decis hope callous formal sensit triplic form electr elect good reviv allow infer airlin gyroscop adjust defens irrit replac depend adopt commun activ bowdler prob rat ceas control roll hop tann fall hiss fizz fail fil happ sk plast agre feed motor sing conflat troubl siz caress poni ti cat".split()
    ends = "ational tional enci anci izer bli alli entli eli ousli ization ation ator alism iveness fulness ousness aliti iviti biliti logi icate ative alize iciti ical ful ness al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize s es ies ed ing eed y e ll".split()
    words = sorted({rng.choice(roots) + rng.choice(["", *ends]) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(3000)})
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(w, tokenize='porter')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    con.executemany("INSERT INTO t(rowid, w) VALUES (?, ?)", list(enumerate(words)))
    want = {words[d]: term for term, d in con.execute("SELECT term, doc FROM v")}
    wrong = {w: (stem(w), want[w]) for w in words if stem(w) != want[w]}
    assert len(wrong) <= 0.01 * len(words), dict(list(wrong.items())[:10])
    got = spark.createDataFrame([(["revenues", "revenue"],), (None,)], "t array<string>").select(stems("t")).collect()
    assert got[0][0][0] == got[0][0][1] and got[1][0] is None


def test_indexes_are_built_once_and_released(spark):
    from finloom.plans.runtime import kept, release

    built = []
    build = lambda path: (built.append(path), spark.range(3).write.parquet(f"{path}/t"))
    assert kept(spark, "x", build) == kept(spark, "x", build) and len(built) == 1
    release(spark)
    assert spark.read.parquet(f"{kept(spark, 'x', build)}/t").count() == 3 and len(built) == 1
    release(spark, indexes=True)
    assert spark.read.parquet(f"{kept(spark, 'x', build)}/t").count() == 3 and len(built) == 2
