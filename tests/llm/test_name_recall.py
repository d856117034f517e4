"""Probes of the linker and its recall by kind of variant, on names that no list was made for."""

import itertools
import random

from pyspark.sql import functions as F

from finloom.llm import name_variants
from finloom.llm.name_variants import Automaton, _shards, link_names, most_edits, neighbours, same_name_pairs, shards, trie_neighbours
from finloom.llm.names import distance


def _pairs(spark, counts):
    t = spark.createDataFrame([(x,) for x, n in counts.items() for _ in range(n)], "speaker string")
    return {tuple(r) for r in same_name_pairs(link_names(t)).collect()}


def test_two_edits_short_parts_and_all_initials(spark):
    counts = {"Katherine Featherstonehaugh": 9, "Katherine Fetherstonhaugh": 1, "Maria Li": 9, "Maria Lii": 1, "Maria Lu": 4, "J. R. Smithson": 1, "John A. Smithson": 9, "James R. Smithson": 3}
    assert _pairs(spark, counts) == {("Katherine Featherstonehaugh", "Katherine Fetherstonhaugh"), ("Maria Li", "Maria Lii"), ("J. R. Smithson", "James R. Smithson")}


def test_two_edits_against_brute_force(spark):
    rng = random.Random(8)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(8, 13))) for _ in range(60)}
    for w in list(words):
        for _ in range(6):
            v = w
            for _ in range(rng.randint(1, 2)):
                k = rng.randrange(len(v) - 1)
                v = rng.choice([v[:k] + v[k + 1] + v[k] + v[k + 2 :], v[:k] + v[k + 1 :], v[:k] + rng.choice("abcd") + v[k:], v[:k] + rng.choice("abcd") + v[k + 1 :]])
            words.add(v)
    words = sorted(words)
    want = {(a, b) for a, b in itertools.permutations(words, 2) if distance(a, b, 2) <= most_edits(min(len(a), len(b)))}
    assert set(trie_neighbours(words, None, most_edits)) == want
    df = spark.createDataFrame([(w,) for w in words], "word string")
    assert {tuple(r) for r in neighbours(df, two=True).collect()} == want
    got = {r.word: set(r.k) for r in df.select("word", _shards(F.col("word"), True).alias("k")).collect()}
    assert all(got[w] == set(shards(w, True)) for w in words)
    for a, b in itertools.product(words[:40], words[:40]):
        m = Automaton(a, 2)
        state = m.start()
        for c in b:
            state = m.step(state, c)
        assert m.edits(state) == distance(a, b, 2)


def test_large_shards_are_split(spark, monkeypatch):
    monkeypatch.setattr(name_variants, "SHARD_WORDS", 7)
    words = ["molco" + a + b for a in "abcdef" for b in "abcdef"]
    got = {tuple(r) for r in neighbours(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(a, b) for a, b in itertools.permutations(words, 2) if distance(a, b, 1) == 1}


KINDS = {
    "case": lambda r, g, s: f"{g} {s}".upper(),
    "turned": lambda r, g, s: f"{s}, {g}",
    "initial": lambda r, g, s: f"{g[0]}. {s}",
    "middle": lambda r, g, s: f"{g} Q. {s}",
    "title": lambda r, g, s: f"Dr. {g} {s}, CFA",
    "swap": lambda r, g, s: (lambda k: f"{g} {s[:k]}{s[k + 1]}{s[k]}{s[k + 2:]}")(r.randrange(1, len(s) - 2)),
    "dropped": lambda r, g, s: (lambda k: f"{g} {s[:k]}{s[k + 1:]}")(r.randrange(1, len(s))),
    "added": lambda r, g, s: (lambda k: f"{g} {s[:k]}{s[k]}{s[k:]}")(r.randrange(1, len(s))),
    "given": lambda r, g, s: (lambda k: f"{g[:k]}{g[k + 1:]} {s}")(r.randrange(1, len(g))),
    # One letter dropped, one doubled: the shorter part keeps nine letters, from which two edits are allowed.
    "two edits": lambda r, g, s: f"{g} {s[:2]}{s[3:6]}{s[5:]}",
}


def test_recall_by_kind(spark):
    rng = random.Random(12)
    part = lambda n: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(n))
    people = {f"{part(3).title()} {part(5).title()}" for _ in range(120)}
    counts, of = {p: 8 for p in people}, {}
    for p in people:
        g, s = p.split()
        for kind, f in KINDS.items():
            v = f(rng, g, s)
            if v not in counts:
                counts[v] = 1
                of[v] = (p, kind)
    got = _pairs(spark, counts)
    found = {k: [] for k in KINDS}
    for v, (p, kind) in of.items():
        found[kind].append(tuple(sorted((v, p))) in got)
    assert {k: sum(x) / len(x) for k, x in found.items() if sum(x) < 0.9 * len(x)} == {}
    owner = {**{p: p for p in people}, **{v: p for v, (p, _) in of.items()}}
    assert sum(owner[a] != owner[b] for a, b in got) == 0
