import io
import json
import zipfile

from pyspark.sql import functions as F

from finloom.functions import html
from finloom.functions import text as tx
from finloom.operators.dense import hash_embedder
from finloom.operators.lexical import bm25
from finloom.sources import readers, remote, sinks
from finloom.streaming import ingest

PAGE = "<html><head><title>A &amp; B</title><style>x</style></head><body><nav>n</nav><h1>Head</h1><p>One <b>two</b></p><ol><li>a<li>b</ol><ul><li>c</li></ul><table><tr><th>x</th><th>y</th></tr><tr><td>1</td><td>2</td></tr></table><ix:hidden>no</ix:hidden><script>var a = '<p>';</script></body>"


def test_html(spark):
    text = html.to_text(PAGE)
    assert "# Head" in text and "One two" in text and "1. a" in text and "2. b" in text and "• c" in text and "x | y\n1 | 2" in text
    assert not any(w in text for w in ("var a", "A & B", "no\n")) and html.to_text(None) is None and html.to_text("") == "" and html.to_text("<p>open") == "open"
    df = spark.createDataFrame([(1, PAGE), (2, None)], "k int, page string")
    assert [r[0] for r in df.select(html.html_title("page")).collect()] == ["A &amp; B", None]
    assert [r[0] for r in df.select(html.html_text("page")).collect()] == [text, None]
    cells = {(r.row_no, r.col_no): r.cell for r in sinks.table_cells(df, "k", "page").collect()}
    assert cells == {(0, 0): "x", (0, 1): "y", (1, 0): "1", (1, 1): "2"}
    assert df.select(html.main_text(F.concat(F.lit("<article>"), F.repeat(F.lit("w "), 400), F.lit("</article>")))).first()[0].startswith("w w")


def test_text_expressions(spark):
    t = spark.createDataFrame([("a  \n\n\n\n b\r\nc",), (None,), ("",)], "t string")
    assert [r[0] for r in t.select(tx.clean_whitespace("t")).collect()] == ["a\n\n b\nc", None, ""]
    assert [r[0] for r in spark.createDataFrame([("One. Two? Three",)], "t string").select(tx.sentences("t")).collect()] == [["One.", "Two?", "Three"]]
    assert [r[0] for r in spark.createDataFrame([("p one\n\n \np two\n\np three",)], "t string").select(tx.paragraphs("t")).collect()] == [["p one", "p two", "p three"]]
    assert [r[0] for r in spark.createDataFrame([("a b c d",), (None,), (" ",)], "t string").select(tx.token_count("t")).collect()] == [4, 0, 0]
    got = spark.createDataFrame([("AAA_FY2024_Q3.pdf",), ("x.pdf",)], "t string").select(tx.fiscal_file("t").alias("f")).collect()
    assert tuple(got[0].f) == ("AAA", 2024, 3) and got[1].f is None


def _docx():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>all</w:t></w:r></w:p><w:p><w:r><w:t>Bye</w:t></w:r></w:p></w:body></w:document>")
    return b.getvalue()


def _xlsx():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S1" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c></row></sheetData></worksheet>')
    return b.getvalue()


def test_read_documents(spark, tmp_path):
    for name, data in {"a.docx": _docx(), "b.xlsx": _xlsx(), "c.txt": b"plain \xff", "d.html": b"<p>hi</p>", "e.bin": b"?", "f.docx": b"broken"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"].text == "Hello all\nBye" and got["b.xlsx"].text == "--- Sheet: S1 ---\nname\t7" and got["c.txt"].text == "plain " and got["d.html"].text == "hi"
    assert got["e.bin"].text is None and "unknown" in got["e.bin"].error and got["f.docx"].error
    assert {r.name for r in readers.list_files(spark, str(tmp_path), "*.txt").collect()} == {"c.txt"}


def test_jsonl_and_keys(spark, tmp_path):
    d = tmp_path / "AAA" / "x"
    d.mkdir(parents=True)
    (d / "1_chunks.jsonl").write_text(json.dumps({"chunk_id": "c1", "text": "t", "fiscal_year": 2024}) + "\n\n{broken\n")
    rows = readers.read_chunks(spark, str(tmp_path)).collect()
    assert sorted((r.chunk_id or "", r.fiscal_year or 0, r._corrupt_record or "") for r in rows) == [("", 0, "{broken"), ("c1", 2024, "")]
    keyed = readers.with_path_keys(spark.read.option("recursiveFileLookup", "true").text(str(tmp_path)), r"/([A-Z]+)/x/", ["ticker"])
    assert {r.ticker for r in keyed.collect()} == {"AAA"}


def test_remote_sources(spark):
    pages = {
        "http://x/t.json": json.dumps({"0": {"ticker": "aa", "cik_str": 12, "title": "A"}}),
        "http://x/CIK0000000012.json": json.dumps({"cik": "12", "name": "A", "filings": {"recent": {"accessionNumber": ["1-2", "3-4"], "filingDate": ["2024-01-01", "2023-01-01"], "reportDate": ["a", "b"], "form": ["10-K", "8-K"], "primaryDocument": ["d.htm", "e.htm"]}}}),
        "http://x/p1": json.dumps({"data": [{"id": 1, "attributes": {"title": "Q4 2024 Call", "publishOn": "x"}}]}),
        "http://x/p2": json.dumps({"data": []}),
    }
    get = pages.__getitem__
    for s in (remote.ticker_source(get), remote.submissions_source(get), remote.transcript_source(get, 0.0)):
        spark.dataSource.register(s)
    assert [tuple(r) for r in spark.read.format("filer_tickers").option("url", "http://x/t.json").load().collect()] == [("AA", "0000000012", "A")]
    f = spark.read.format("filer_submissions").option("base", "http://x").option("ciks", "12").load()
    assert f.count() == 2
    top = remote.latest_filings(f, ["10-K"], 1).select(remote.document_url("http://y/", "cik", "accession_number", "primary_document").alias("u")).collect()
    assert [r.u for r in top] == ["http://y/12/12/d.htm"]
    t = spark.read.format("transcript_list").option("base", "http://x/p{page}").option("pages", "2").load()
    assert [tuple(r.q) for r in t.select(remote.quarter_of_title("title").alias("q")).collect()] == [(4, 2024)]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("a", "red fox", 60), ("b", "blue fox", 10), ("c", "", 90), (None, "red", 90)], "chunk_id string, text string, chunk_tokens int")
    sinks.write_index(docs, "chunk_id", ["text"], str(tmp_path / "i"))
    q = spark.createDataFrame([(1, "red")], "query int, t string")
    assert [r.doc for r in bm25(sinks.read_index(spark, str(tmp_path / "i")), q, "query", "t").collect()] == ["a"]
    sinks.write_vectors(docs, hash_embedder(8), str(tmp_path / "v"))
    rows = spark.read.parquet(str(tmp_path / "v")).collect()
    assert [(r.chunk_id, r.metadata) for r in rows if r.chunk_id] == [("a", {"chunk_tokens": "60"})]
    old = spark.createDataFrame([("k", 1, "old"), ("j", 1, "j")], "date string, saved_at int, v string")
    sinks.append_catalogue(old, spark.createDataFrame([("k", 2, "new")], "date string, saved_at int, v string"), ["date"], str(tmp_path / "c"))
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "c")).collect()) == ["j", "new"]
    sinks.write_markdown(spark.createDataFrame([("d", "# x\n\ny")], "doc_id string, markdown string"), str(tmp_path / "m"))
    assert next((tmp_path / "m" / "doc_id=d").glob("*.txt")).read_text() == "# x\n\ny\n"


def test_stream_takes_each_chunk_once(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    line = lambda i, at: json.dumps({"chunk_id": i, "ticker": "T", "text": "x", "chunked_at": at}) + "\n"
    (d / "1.jsonl").write_text(line("a", "2024-01-01T00:00:00Z") + line("b", "2024-01-01T00:00:01Z") + line("a", "2024-01-01T01:00:00Z"))
    run = lambda: ingest.append_to(ingest.chunk_stream(spark, str(d), where={"ticker": "T"}), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    run()
    (d / "2.jsonl").write_text(line("b", "2024-01-02T00:00:00Z") + line("c", "2024-01-02T00:00:00Z"))
    run()
    assert sorted(r.chunk_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
