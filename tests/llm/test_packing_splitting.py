import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from finloom.llm.packing import pack_histogram, pack_items
from finloom.llm.splitting import RangeMax, cut, split_oversized


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), max_size=20), st.booleans())
def test_patterns_hold_every_item_once(counts, fullest):
    packs = pack_histogram(counts, 60, fullest)
    back = {}
    for p, n in packs:
        assert sum(p) <= 60 and n > 0
        for length in p:
            back[length] = back.get(length, 0) + n
    assert back == counts


def _spf(lengths, capacity):
    """Shortest pack first, one item after another."""
    packs = []
    for x in sorted(lengths, reverse=True):
        fits = [p for p in packs if sum(p) + x <= capacity]
        if fits:
            min(fits, key=sum).append(x)
        else:
            packs.append([x])
    return len(packs)


def test_as_many_packs_as_item_by_item():
    rng = random.Random(2)
    for _ in range(40):
        xs = [rng.randint(1, 40) for _ in range(rng.randint(1, 60))]
        counts = {x: xs.count(x) for x in xs}
        assert sum(n for _, n in pack_histogram(counts, 60)) <= _spf(xs, 60) * 1.05 + 1


def test_pack_items(spark):
    rng = random.Random(3)
    rows = [(f"i{k}", rng.choice(["a", "b", None]), rng.choice([None, -5, 0, 7, 30, 45, 50, 60, 61, 130, 600]), k, "x") for k in range(400)]
    t = spark.createDataFrame(rows, "item string, grp string, size int, container_no int, _g0 string")
    out = pack_items(t, ["grp"], "item", "size", 60).collect()
    used, pieces = {}, {}
    for r in out:
        used[r.grp, r.container_no] = used.get((r.grp, r.container_no), 0) + r.piece_size
        pieces.setdefault(r["item"], []).append(r)
    assert max(used.values()) <= 60 and min(r.container_no for r in out) == 1 and r._g0 == "x"
    for item, grp, size, *_ in rows:
        ps = pieces[item]
        n = max(size or 0, 0)
        assert sum(p.piece_size for p in ps) == n and len(ps) == max(1, math.ceil(n / 60))
        assert sorted(p.piece_no for p in ps) == list(range(1, len(ps) + 1))
    for g in ("a", "b", None):
        total = sum(max(s or 0, 0) for _, x, s, *_ in rows if x == g)
        n = len({c for x, c in used if x == g})
        assert n <= math.ceil(total / 60) * 1.1 + 1
    assert pack_items(t.limit(0), ["grp"], "item", "size", 60).count() == 0


def test_range_max_against_brute_force():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 40):
        a = rng.integers(0, 4, n)
        t = RangeMax(a)
        for lo in range(n):
            for hi in range(lo, n):
                best = max(range(lo, hi + 1), key=lambda i: (a[i], i))
                assert t.query(lo, hi) == (a[best], best)


def test_cut_prefers_natural_boundaries():
    text = ("one two three four five six seven. " * 30).strip()
    ps = cut(text, 50, 10)
    assert all(e - s <= 50 for s, e, _ in ps) and all(p.rstrip().endswith(".") for _, _, p in ps)
    assert [s for s, _, _ in ps][1:] == [e - 10 for _, e, _ in ps][:-1]
    # A blank line is stronger than a sentence's end, the later of two equals wins.
    text = " ".join(["w"] * 29) + " a.\n\n" + " ".join(["w"] * 10) + " b. " + " ".join(["w"] * 60)
    assert cut(text, 50, 10)[0][1] == 30


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.", "c,", "d\n", "e.\n\n", "f g"]), max_size=120), st.integers(5, 30), st.integers(0, 4))
def test_pieces_cover_the_text(words, limit, overlap):
    text = " ".join(words)
    tokens = text.split()
    ps = cut(text, limit, overlap)
    at = 0
    for k, (s, e, p) in enumerate(ps):
        assert p.split() == tokens[s:e] and e - s <= limit and s == (at - overlap if k else 0)
        at = e
    assert at == len(tokens)


def test_split_oversized(spark):
    long = "word " * 900
    rows = [(1, long, "x"), (2, "short text", "y"), (3, None, "z"), (4, "", "z"), (5, "x" * 10_000, "z"), (6, long, "x"), (7, " " * 5000, "b"), (8, "a b " * 400, "exactly the limit")]
    t = spark.createDataFrame(rows, "chunk_key bigint, text string, piece_no string")
    got = split_oversized(t).collect()
    assert sorted((r.chunk_key, r.piece_no, r.start_token, r.end_token, r.overlap_with_prev) for r in got) == [(k, *x) for k in (1, 6) for x in ((1, 0, 800, 0), (2, 680, 900, 120))]
    assert split_oversized(t.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_oversized(t, limit=10, overlap=10)


def test_runs_over_many_blocks_of_ranks(spark):
    """One length in great numbers, one run of containers: every container holds what its pattern says."""
    rows = [(i, "g", 300 if i < 30_000 else 250) for i in range(40_000)]
    t = spark.createDataFrame(rows, "id bigint, g string, n int")
    got = pack_items(t, ["g"], "id", "n")
    boxes = got.groupBy("container_no").agg({"piece_size": "sum", "*": "count"}).collect()
    assert got.count() == 40_000 and len(boxes) == 20_000 and max(r["sum(piece_size)"] for r in boxes) <= 600
    assert sorted(r.container_no for r in boxes) == list(range(1, 20_001))
