"""What must hold of every result, on the small test tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from finloom.functions.text import token_count
from finloom.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.read.parquet(f"{SF}/chunks.parquet")


def test_clean_texts_keep_all_other_lines(spark, chunks):
    gone = {(r.chunk_key, r.line_no) for r in queries.p1_found(spark, SF).collect()}
    clean = {r.chunk_key: r.text for r in queries.p1_clean(spark, SF).collect()}
    assert gone
    for r in chunks.select("chunk_key", "text").collect():
        want = None if r.text is None else "\n".join(x for i, x in enumerate(r.text.split("\n"), 1) if (r.chunk_key, i) not in gone)
        assert clean[r.chunk_key] == want


def test_turns_follow_each_other_and_keep_their_words(spark):
    rows = queries.p3_turns(spark, SF).orderBy("chunk_key", "turn_no").collect()
    assert rows
    last = {}
    for r in rows:
        before = last.get(r.chunk_key)
        assert r.turn_no == (before.turn_no + 1 if before else 1) and r.n_words > 0
        assert before is None or r.speaker_no != before.speaker_no
        assert r.speaker_no <= 1 + max((x.speaker_no for x in rows if x.chunk_key == r.chunk_key and x.turn_no < r.turn_no), default=0)
        assert r.n_words <= len(r.text.split())
        last[r.chunk_key] = r


def test_links_are_a_partition(spark, chunks):
    links = queries.p4_links(spark, SF).collect()
    names = [r.name for r in links]
    assert len(names) == len(set(names)) and set(names) == {r.speaker for r in chunks.filter("speaker is not null").select("speaker").distinct().collect()}
    size = {}
    for r in links:
        size[r.entity] = size.get(r.entity, 0) + 1
    assert all(r.n_variants == size[r.entity] for r in links) and {r.entity for r in links} <= set(names)
    assert queries.p4_found(spark, SF).count() == sum(n * (n - 1) // 2 for n in size.values())


def test_pieces_join_to_their_text(spark, chunks):
    pieces = {}
    for r in queries.p5_pieces(spark, SF).orderBy("chunk_key", "piece_no").collect():
        pieces.setdefault(r.chunk_key, []).append(r)
    text = {r.chunk_key: r.text for r in chunks.filter(token_count("text") > 800).select("chunk_key", "text").collect()}
    assert pieces.keys() == text.keys()
    for key, rows in pieces.items():
        words = []
        for r in rows:
            own = r.text.split()
            assert len(own) == r.n_tokens == r.end_token - r.start_token <= 800 and r.overlap_with_prev == (120 if r.piece_no > 1 else 0)
            assert own[: r.overlap_with_prev] == (words[-r.overlap_with_prev :] if r.overlap_with_prev else [])
            words += own[r.overlap_with_prev :]
        assert words == text[key].split()


def test_every_chunk_is_packed_once(spark, chunks):
    packs = queries.p2_packs(spark, SF)
    assert packs.groupBy("chunk_id", "piece_no").count().filter("count > 1").count() == 0
    assert packs.select("chunk_id").distinct().count() == chunks.select("chunk_id").distinct().count()
    assert packs.groupBy("ticker", "chunk_type", "container_no").agg(F.sum("piece_size").alias("n")).filter("n > 600").count() == 0
    whole = packs.groupBy("chunk_id").agg(F.sum("piece_size").alias("n"), F.max("n_tokens").alias("t"), F.count(F.lit(1)).alias("k"))
    assert whole.filter("n <> t or (t <= 600 and k > 1)").count() == 0
