import random

import numpy as np

from finloom.llm.leak import GRAM, WINDOW, Prints, fold, leaked_items, plain, search, shingle_hashes, winnow

VOCAB = [f"w{i}" for i in range(900)]


def test_winnowing_guarantee():
    rng = random.Random(1)
    for _ in range(200):
        span = [rng.randint(2, 50) for _ in range(GRAM + WINDOW - 1)]
        sides = [np.array([rng.randint(2, 50) for _ in range(rng.randint(0, 20))] + span + [rng.randint(2, 50) for _ in range(rng.randint(0, 20))]) for _ in range(2)]
        prints = [set(h[winnow(h, WINDOW)].tolist()) for h in (shingle_hashes(s, GRAM) for s in sides)]
        assert prints[0] & prints[1]


def test_winnow_against_definition():
    rng = np.random.default_rng(2)
    for n in (0, 1, 3, 4, 30):
        h = rng.integers(0, 6, n).astype(np.uint64)
        want = {max(range(i, i + 3), key=lambda j: (-int(h[j]), j)) for i in range(n - 2)} if n >= 3 else set(range(n))
        assert set(winnow(h, 3).tolist()) == want


def _longest(doc, item):
    """Longest common run of words."""
    best, row = 0, {}
    for i, a in enumerate(doc):
        new = {}
        for j, b in enumerate(item):
            if a == b:
                new[j] = row.get(j - 1, 0) + 1
                best = max(best, new[j])
        row = new
    return best


def test_runs_against_brute_force():
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice(VOCAB) for _ in range(60)), " ".join(rng.choice(VOCAB) for _ in range(25))) for k in range(8)]
    docs = []
    for _ in range(150):
        words = [rng.choice(VOCAB) for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.7:
            src = rng.choice(items)[rng.choice((1, 2))].split()
            n, a = rng.randint(5, 25), rng.randint(0, len(src) - 5)
            at = rng.randint(0, len(words))
            words[at:at] = src[a : a + n]
        docs.append(" ".join(words))
    prints = Prints(items, GRAM, WINDOW)
    got = {(k, prints.item[o]) for k, o in search(docs, prints, GRAM, WINDOW, 15)}
    want = {(k, i) for k, d in enumerate(docs) for i, *ts in items if any(_longest(d.split(), t.split()) >= 15 for t in ts)}
    assert want <= got
    # What is found beyond exact runs holds an inserted or changed word at most.
    assert all(max(_longest(docs[k].split(), t.split()) for j, *ts in items if j == i for t in ts) >= 7 for k, i in got - want)


def test_typography():
    assert fold("Straße,") == fold("STRASSE") and fold("“ﬁscal”") == "fiscal" and fold("rеnеwal") == "renewal" and fold("27.5%") == "275" and fold("—") == ""
    assert plain("re&#97;d <b>the</b> retu-\n rning li­ne").split() == ["read", "the", "returning", "line"]


def test_leaked_items(spark):
    p = " ".join(f"alpha{i}" for i in range(40))
    q = " ".join(f"beta{i}" for i in range(20))
    items = spark.createDataFrame([(1, q, p, "x"), (2, None, None, "x"), (3, "", "too short to leak", "x"), (1, q, p, "x")], "item_id bigint, question string, passage string, doc_id string")
    w, v = p.split(), q.split()
    edited = w[:8] + ["new"] + w[8:16] + w[17:30]
    docs = [
        (1, "before " + p + " after"), (2, " ".join(w[:15])), (3, " ".join(w[:14])), (4, " ".join(edited)), (5, None), (6, ""), (7, "   "), (8, "too short to leak"),
        (9, " ".join(reversed(w))), (10, "\n".join(v).upper()), (11, "z " * 30000 + " ".join(v)), (12, " ".join(w[:15])), (13, " ".join(x for k in range(20) for x in (w[k], "pad"))),
    ]
    d = spark.createDataFrame([(*r, "y") for r in docs], "doc_id bigint, text string, item_id string")
    want = {(1, 1), (2, 1), (4, 1), (10, 1), (11, 1), (12, 1)}
    got = leaked_items(d, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted(want)
    assert {(r.doc_id, r.item_id) for r in leaked_items(d, items, items_per_block=1).collect()} == want
    assert leaked_items(d.limit(0), items).count() == 0 and leaked_items(d, items.limit(0)).count() == 0


def test_alignment_against_brute_force():
    from finloom.llm.leak import aligned

    rng = np.random.default_rng(5)
    most, width = 2, 7
    item = rng.integers(0, 4, (300, width))
    doc = rng.integers(0, 4, (300, width + most))
    got = aligned(doc, item, most)

    def brute(d, i, x, y, e):
        """Most words kept with at most e differences from x and y on."""
        best = 0
        if x < len(d) and y < len(i) and d[x] == i[y]:
            best = 1 + brute(d, i, x + 1, y + 1, e)
        if e:
            for a, b in ((1, 1), (1, 0), (0, 1)):
                if x + a <= len(d) and y + b <= len(i):
                    best = max(best, brute(d, i, x + a, y + b, e - 1))
        return best

    for k in range(300):
        assert [got[e][k] for e in range(most + 1)] == [brute(doc[k], item[k], 0, 0, e) for e in range(most + 1)]


def test_recall_by_span_and_changes():
    """Passages with words changed, added or dropped: whoever keeps 15 words with two differences is found."""
    rng = random.Random(9)
    items = [(k, " ".join(rng.choice(VOCAB) for _ in range(80)), None) for k in range(40)]
    prints = Prints(items, GRAM, WINDOW)
    for n, changes in ((15, 0), (16, 1), (20, 1), (20, 2), (30, 2)):
        docs, want = [], []
        for _ in range(100):
            k, passage, _q = rng.choice(items)
            a = rng.randint(0, 80 - n)
            span = passage.split()[a : a + n]
            for j in sorted(rng.sample(range(1, n - 1), changes), reverse=True):
                span[j : j + 1] = rng.choice([["new"], ["new", span[j]], []])
            docs.append(" ".join(rng.choices(VOCAB, k=30) + span + rng.choices(VOCAB, k=30)))
            want.append(k)
        got = search(docs, prints, GRAM, WINDOW, 15)
        assert sum((d, k) in {(x, prints.item[o]) for x, o in got} for d, k in enumerate(want)) >= 0.98 * len(want)


def test_a_phrase_of_very_many_items():
    items = [(k, f"w{k} and in the opinion of the board of the group as it stands {k}", None) for k in range(30_000)]
    prints = Prints(items, GRAM, WINDOW)
    doc = "w7 and in the opinion of the board of the group as it stands 7"
    # All items hold 13 words of it, one holds 15.
    assert {prints.item[o] for _, o in search([doc], prints, GRAM, WINDOW, 15)} >= {7}
