"""Parsers, sinks and sources against small cases worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from finloom.functions import html, text
from finloom.operators import analytics, transcripts
from finloom.sources import remote, sinks


@pytest.mark.parametrize(
    "page, want",
    [
        ("<nav><ul><li>a<li>b</ul></nav><p>Body text that must stay.</p>", "Body text that must stay."),
        ("<div><nav><p>menu</div><p>kept</p>", "kept"),
        ("<header><td>x</header></p></td>kept", "kept"),
        ("<div class='Top-Navigation'><p>a<p>b</div>kept", "kept"),
        ("<div style='display: none'>a<br>b</div>kept", "kept"),
        ("<ix:header><ix:hidden>a</ix:hidden></ix:header>kept", "kept"),
        ("</div></nav>kept", "kept"),
    ],
)
def test_dropped_elements(page, want):
    assert html.to_text(page) == want


def test_utterances_have_their_place_in_the_text(spark):
    t = "Preface of many words.\n\nJane Doe:   Welcome   to all of you.\nKim Poe: ok\nJohn Roe (X): We open the call for questions.\nJane Doe: Because it is so."
    rows = transcripts.utterances(spark.createDataFrame([(1, t), (2, None), (3, "no label")], "k int, t string"), "k", "t").orderBy("idx").collect()
    assert [(r.speaker, t[r.position - 1 :].startswith(r.speaker), r.phase) for r in rows] == [("Jane Doe", True, "prepared_remarks"), ("John Roe", True, "prepared_remarks"), ("Jane Doe", True, "qa")]
    assert [r.idx for r in rows] == [1, 3, 4]


def test_sections_by_form(spark):
    t = "x 🙂 PART I - FINANCIAL INFORMATION Item 1. Financial Statements a ITEM 2. Management's Discussion b Part II. Other Information Item 1A. Risk Factors c"
    k = "ITEM 1 BUSINESS a Item 1B. Unresolved Staff b ITEM 16. Form 10-K"
    df = spark.createDataFrame([(1, "10-Q", t), (2, "10-K", k), (3, "8-K", "some text"), (4, "10-K", None), (5, "10-K", "none here")], "k int, f string, t string")
    got = {}
    for r in transcripts.form_sections(df, "k", "t", "f").orderBy("k", "position").collect():
        got.setdefault(r.k, []).append((r.section, r.content))
    assert [s for s, _ in got[1]] == ["Part I", "Item 1", "Item 2", "Part II", "Item 1A"] and got[1][2][1] == "ITEM 2. Management's Discussion b "
    assert [s for s, _ in got[2]] == ["Item 1", "Item 1B", "Item 16"] and got[3] == [("FULL", "some text")] and 4 not in got and got[5] == [("FULL", "none here")]


def test_roles_by_context(spark):
    t = "Jane Doe, CEO, formerly of UBS\nKim Poe -- Jefferies\nOperator Max\nJane Doe: hello"
    df = spark.createDataFrame([(n, t) for n in ("Jane Doe", "Kim Poe", "Max", "Nobody", "", None)], "n string, t string")
    got = df.select("n", transcripts.speaker_role(transcripts.context_of("t", "n")).alias("r")).collect()
    assert {r.n: (r.r.role, r.r.firm) for r in got} == {"Jane Doe": ("CEO", None), "Kim Poe": ("Analyst", "Jefferies"), "Max": ("Unknown", None), "Nobody": ("Unknown", None), "": ("Unknown", None), None: ("Unknown", None)}


def test_words_of_any_script(spark):
    df = spark.createDataFrame([("Größe der Überschüsse, déjà-vu; 株価は上昇 Q3's",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.words("t")).collect()] == [["große", "der", "uberschusse", "deja", "vu", "株価は上昇", "q3", "s"], [], []]


def test_success_rates(spark):
    df = spark.createDataFrame([("a", True, None), ("a", True, None), ("a", False, "boom"), ("b", None, None), ("b", True, None)], "c string, ok boolean, e string")
    assert {(r.c, r.n, r.rate, r.verdict) for r in analytics.success_rates(df, "c", "ok", "e").collect()} == {("a", 2, 100.0, "good"), ("b", 2, 50.0, "poor")}


def test_sinks(spark, tmp_path):
    calls = spark.createDataFrame([("T", 2024, 1, "old", "2024-01-01"), ("T", 2024, 1, "new", "2024-02-01"), ("T", 2024, 2, "", None)], "ticker string, fiscal_year int, quarter int, text string, saved_at string")
    sinks.write_transcripts(calls, str(tmp_path / "t"))
    assert [r.text for r in spark.read.parquet(str(tmp_path / "t")).collect()] == ["new"]
    sinks.rewrite_metadata(calls.limit(3), {"saved_at": F.lit("never"), "kind": F.lit("call")}, str(tmp_path / "m"))
    assert {(r.saved_at, r.kind) for r in spark.read.json(str(tmp_path / "m")).collect()} == {("2024-01-01", "call"), ("2024-02-01", "call"), ("never", "call")}
    sinks.write_evaluation(spark.createDataFrame([(1, 0.5)], "query int, mrr double"), str(tmp_path / "e"), run="lexical")
    assert spark.read.json(str(tmp_path / "e")).collect()[0].asDict() == {"query": 1, "mrr": 0.5, "run": "lexical"}
    a, b = spark.createDataFrame([("d1", 1), ("d2", 2)], "doc_id string, c int"), spark.createDataFrame([("d2", 7)], "doc_id string, v int")
    sinks.delete_documents(spark.createDataFrame([("d2",), ("d2",)], "doc_id string"), {"chunks": a, "vectors": b}, str(tmp_path / "d"))
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "d/chunks")).collect()] == ["d1"] and spark.read.parquet(str(tmp_path / "d/vectors")).count() == 0


def test_pages_to_the_last(spark):
    def get(url):
        p = int(url.rsplit("=", 1)[1])
        return json.dumps({"data": [{"id": p, "attributes": {"title": f"t{p}", "publishOn": "x"}}], "meta": {"page": {"totalPages": 3}}})

    spark.dataSource.register(remote.transcript_source(get, 0))
    read = spark.read.format("transcript_list").option("base", "u?p={page}")
    assert {r.id for r in read.load().collect()} == {"1", "2", "3"} and {r.id for r in read.option("pages", 2).load().collect()} == {"1", "2"}


def test_transcript_pages(spark):
    page = "<html><title>Acme Q3 2024 Earnings Call</title><body><p>Jane Doe: Welcome.</p><p>Kim Poe: Thanks.</p></body></html>"
    r = remote.transcript_pages(spark.createDataFrame([(1, page)], "k int, html string")).first()
    assert (r.quarter, r.fiscal_year, r.participants) == (3, 2024, ["Jane Doe", "Kim Poe"]) and "Welcome." in r.text
