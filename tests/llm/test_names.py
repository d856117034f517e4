import itertools
import random

import pytest

from finloom.llm.names import Name, assign, cost, distance, parse, soundex
from finloom.llm.name_variants import Automaton, link_names, neighbours, same_name_pairs, shards, trie_neighbours


@pytest.mark.parametrize(
    "text, want",
    [
        ("Javier Molcogiso", Name("javier", "j", "molcogiso")),
        ("Molcogiso, Javier", Name("javier", "j", "molcogiso")),
        ("DR. JAVIER R. MOLCOGISO, CFA", Name("javier", "jr", "molcogiso")),
        ("J. Molcogiso - Half Moon Equity", Name("", "j", "molcogiso")),
        ("JavierMolcogiso", Name("javier", "j", "molcogiso")),
        ("MOLCOGISO", Name("", "", "molcogiso")),
        ("Bofi Rsch Grp.", Name("", "", "", ("bofi", "research", "group"))),
        ("Bofi IR.", Name("", "", "", ("bofi", "investor", "relations"))),
        ("Bofi Investor Relations, Inc.", Name("", "", "", ("bofi", "investor", "relations"))),
        ("  ", None),
        ("123", None),
    ],
)
def test_parse(text, want):
    assert parse(text) == want


def _edits(a, b):
    """Optimal string alignment by definition, for short words."""
    d = {}
    for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
        if not i or not j:
            d[i, j] = i + j
            continue
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_trie_and_shards_against_brute_force():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(4, 8))) for _ in range(250)})
    want = {(a, b) for a in words for b in words if a != b and _edits(a, b) == 1}
    assert set(trie_neighbours(words)) == want
    for a, b in want:
        assert set(shards(a)) & set(shards(b)), (a, b)
    for a, b in itertools.product(words[:60], words[:60]):
        m, state = Automaton(a), None
        state = m.start()
        for c in b:
            state = m.step(state, c)
        assert min(m.edits(state), 2) == min(_edits(a, b), 2)
        assert distance(a, b, 3) == min(_edits(a, b), 4)


def test_assignment_is_optimal():
    rng = random.Random(1)
    for _ in range(50):
        n, m = rng.randint(1, 4), rng.randint(4, 5)
        c = [[rng.randint(0, 9) for _ in range(m)] for _ in range(n)]
        got = sum(c[i][j] for i, j in enumerate(assign(c)))
        assert got == min(sum(c[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))


def test_soundex_and_cost():
    assert soundex("robert") == soundex("rupert") == "r163"
    assert cost(parse("Liz Maskeneda"), parse("Elizabeth Maskeneda")) < 5 <= cost(parse("Umar Maskeneda"), parse("Elizabeth Maskeneda"))


VARIANTS = {
    "m": ["Javier Molcogiso", "javier molcogiso ", "Molcogiso, Javier", "J. Molcogiso", "Javi Molcogiso", "Javier  Molcogsio", "Molcogiso Javier", "JavierMolcogiso", "Javier Molcogiso (Half Moon Equity)"],
    "g": ["Wei Galhenshenko", "W. Galhenshenko", "GALHENSHENKO, Wei"],
    "a": ["Amara Galhenshenko", "Amara Galhenshenko, CFA"],
    "o": ["Bofichiso Research Group", "Research Group, Bofichiso", "The Bofichiso Rsch Grp.", "Bofichiso Research Group LLC"],
}


def test_links(spark):
    rows = [(x, 1) for xs in VARIANTS.values() for x in xs for _ in range(3)]
    rows += [("Javier Molcogiso", 0)] * 9 + [("Kofi Molcobis", 0)] * 5 + [(None, 2), ("", 3), ("   ", 3), ("?!", 3), ("x" * 5000, 1)]
    # Given names stand mostly in front elsewhere.
    rows += [("Javier Zibelpysh", 0)] * 4 + [("Wei Zibelpysh", 0)] * 4
    t = spark.createDataFrame(rows, "speaker string, n int")
    got = {(r[0], r[1]) for r in same_name_pairs(link_names(t)).collect()}
    want = {tuple(sorted(p)) for xs in VARIANTS.values() for p in itertools.combinations(xs, 2)}
    assert got == want


def test_links_of_nothing(spark):
    t = spark.createDataFrame([], "speaker string")
    assert link_names(t).count() == 0
    assert link_names(spark.createDataFrame([(None,)], "speaker string")).count() == 0


def test_neighbours_across_shards(spark):
    words = ["molcogiso", "molcogsio", "mlcogiso", "molcogisso", "xolcogiso", "abc", "other"]
    got = {(r.word, r.near) for r in neighbours(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and _edits(a, b) == 1}
