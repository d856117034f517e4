"""Operators do the whole job: no prefixes, samples or caps below what was asked for."""

from finloom.operators import analytics


def test_sentiment_reads_the_whole_text(spark):
    texts = ["plain " * 400 + "strong growth", "gain " + "plain " * 400 + "loss decline churn", "x" * 3000 + " risk"]
    assert all(len(t) > 2000 for t in texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.s.label, r.s.score) for r in df.select("i", analytics.sentiment("t").alias("s")).collect()}
    assert got == {0: ("positive", 1.0), 1: ("negative", 0.5), 2: ("negative", 1.0)}
    bounded = {r.i: r.s.label for r in df.select("i", analytics.sentiment("t", head=2000).alias("s")).collect()}
    assert bounded == {0: "neutral", 1: "positive", 2: "neutral"}


def test_no_cap_below_the_rows_asked_for(spark):
    from finloom.engine import Engine

    chunks = spark.createDataFrame([(f"c{i:03}", f"freight cost {i}", "ABC", "10-K") for i in range(150)], "chunk_id string, text string, ticker string, doc_type string")
    q = spark.createDataFrame([(1, "freight cost")], "query int, question string")
    e = Engine(chunks)
    assert e.retrieve(q, 50).count() == 50 and e.lexical(q, e.config.fetch(120)).count() == 120 and e.search(q, 120).count() == 120
    assert [e.config.fetch(k) for k in (5, 10, 34, 120)] == [15, 30, 100, 120]


def test_sentiment_label_like_its_sql_on_odd_short_texts(spark, tmp_path):
    import duckdb
    from compare import both, connect

    from finloom import catalog

    # Up to the 2,000 characters that the SQL reads; the dotted capital I is one letter, not an i and a mark.
    texts = [None, "", " \n", "GAİN", "RİSK İ loss", "ris\u212a", "Write-Down -gain gain1loss", "égain gaiń", "İ" * 1994 + " gain"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    _, mine, theirs = both(spark, connect(str(tmp_path)), str(tmp_path), catalog.QUERIES["sentiment_label"], catalog.SQL["sentiment_label"])
    assert mine == theirs and (3, "positive", 1.0) in mine and (4, "negative", 1.0) in mine
