import random
import re

from finloom.llm.names import distance
from finloom.llm.lines import LEAST_ROWS, LEAST_SHARE, repeated_lines, without_lines


def _key(line):
    # What stands before a day and a year is a month, however it is spelled.
    line = re.sub(r"\S{3,9}\s+\d{1,2},\s+20\d\d", " ", line)
    line = re.sub(r"\b(january|february|march|april|may|june|july|august|september|october|november|december)\b", "", line.lower())
    return re.sub(r"[^a-z]", "", line)


def _brute(rows):
    """Lines alike another within one edit, in enough rows of the source."""
    lines = [(src, rid, i, _key(x)) for rid, src, text in rows if src is not None and text is not None for i, x in enumerate(text.split("\n"), 1)]
    lines = [x for x in lines if len(x[3]) >= 12]
    n = {s: sum(r[1] == s for r in rows) for s in {r[1] for r in rows}}
    out = set()
    for src in n:
        mine = [x for x in lines if x[0] == src]
        keys = {x[3] for x in mine}
        holders = {k: {x[1] for x in mine if x[3] == k} for k in keys}
        near = {k: {o for o in keys if abs(len(o) - len(k)) < 2 and distance(k, o, 1) <= 1} for k in keys}
        passed = {k for k in keys if len(holders[k]) >= 2 and len(set().union(*(holders[o] for o in near[k]))) >= max(LEAST_ROWS, LEAST_SHARE * n[src])}
        out |= {(rid, i) for _, rid, i, k in mine if near[k] & passed}
    return out


def _damage(rng, s):
    k = rng.randrange(len(s))
    return rng.choice([s.upper(), "  " + s, s.replace(" ", "  "), s + ".", "* " + s, s[:k] + rng.choice("xyz,1") + s[k + 1 :], s])


def test_against_brute_force(spark):
    rng = random.Random(7)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()
    rows, rid = [], 0
    boiler = {"A": ["Share this call with a colleague of yours today", "Date: March 3, 2024 - prepared for all"], "B": ["Subscribers of the desk read transcripts 46 hours earlier"], "C": ["Seldom repeated line of the third source"]}
    for src, n, rate in (("A", 120, 0.4), ("B", 60, 0.2), ("C", 200, 0.01)):
        for _ in range(n):
            lines = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(1, 4))]
            for b in boiler[src]:
                if rng.random() < rate:
                    lines.insert(rng.randint(0, len(lines)), _damage(rng, b.replace("3", str(rng.randint(1, 28))).replace("46", str(rng.randint(1, 99)))))
            rows.append((rid, src, "\n".join(lines)))
            rid += 1
    rows += [(rid, None, "Share this call with a colleague of yours today"), (rid + 1, "A", None), (rid + 2, "A", "")]
    t = spark.createDataFrame(rows, "chunk_key bigint, ticker string, text string")
    got = {(r.chunk_key, r.line_no) for r in repeated_lines(t).collect()}
    assert got == _brute(rows)
    text = {r[0]: r[2] for r in rows}
    hit = [text[k].split("\n")[i - 1].lower() for k, i in got]
    assert sum("colleague" in x for x in hit) > 30 and not any("third source" in x for x in hit)


def test_said_lines_labels_and_small_sources(spark):
    rows = [(i, "A", f"Operator: Our next question comes from the line\nJane Doe: Thank you very much indeed\nListen to the audio of this event in the app\nThank you.\n[{i}]") for i in range(8)]
    rows += [(20 + i, "B", "Listen to the audio of this event in the app") for i in range(4)]
    t = spark.createDataFrame([(*r, "x", 1) for r in rows], "chunk_key bigint, ticker string, text string, src string, rid int")
    got = {(r.chunk_key, r.line_no) for r in repeated_lines(t).collect()}
    assert got == {(i, 3) for i in range(8)}
    clean = {r.chunk_key: r.text for r in without_lines(t, repeated_lines(t)).collect()}
    assert clean[0] == "Operator: Our next question comes from the line\nJane Doe: Thank you very much indeed\nThank you.\n[0]" and clean[20] == rows[8][2]


def test_nothing(spark):
    t = spark.createDataFrame([], "chunk_key bigint, ticker string, text string")
    assert repeated_lines(t).count() == 0
    t = spark.createDataFrame([(1, None, None), (2, "A", ""), (3, "A", "x" * 100_000)], "chunk_key bigint, ticker string, text string")
    assert repeated_lines(t).count() == 0 and without_lines(t, repeated_lines(t)).count() == 3


def _found(spark, rows):
    t = spark.createDataFrame(rows, "chunk_key bigint, ticker string, text string")
    return {(r.chunk_key, r.line_no) for r in repeated_lines(t).collect()}


def test_short_lines_notices_and_courtesies(spark):
    text = "Share this\nRead more\nPage {i} of 10\nQ&A\nThank you.\nYes, thanks.\nOkay\nSafe Harbor Statement: this call holds forecasts\nMedia Contact: press desk\nJane Doe: Right\n12"
    rows = [(i, "A", text.replace("{i}", str(i))) for i in range(40)]
    assert _found(spark, rows) == {(i, k) for i in range(40) for k in (1, 2, 3, 4, 8, 9)}


def test_a_label_is_judged_on_the_whole_line(spark):
    long = "Replay of the event: " + "this replay is kept for ninety days on the site of the group " * 4 + "[note]"
    assert _found(spark, [(i, "A", f"{long} and more\n{'abcdefghij'[i] * 9}") for i in range(10)]) == {(i, 1) for i in range(10)}


def test_a_spelling_that_stands_once_is_enough(spark):
    clean = "the replay remains on our site for a week"
    wrong = ["xhe replay remains on our site for a week", "the replay remains on our site for a weex", "the replaz remains on our site for a week", "the replay remains on our sitee for a week", "the replay remain on our site for a week"]
    assert _found(spark, [(i, "A", f"{x}\nunlike {'abcdefg'[i] * 9}") for i, x in enumerate([clean, *wrong])]) == {(i, 1) for i in range(6)}


def test_many_lines_that_begin_alike(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = [(i, "A", "we now turn to the next part of the presentation about " + word(30)) for i in range(3000)]
    rows += [(3000 + i, "A", "we now turn to the next part of the presentation about the outlook of " + "xyzw"[i % 4] + "ll") for i in range(120)]
    assert _found(spark, rows) == {(3000 + i, 1) for i in range(120)}


def test_large_containers_and_two_families_in_one_row(spark):
    rows = [(i, "A", "Follow us for the news of the day\nFollow uz for the news of the day" if i % 2 else "Follow us for the news of the day") for i in range(40_000)]
    assert len(_found(spark, rows)) == 60_000


def test_mistakes_in_months_and_in_words_like_months(spark):
    texts = ["This transcript of Marheim may contain outlooks", "This transcript of Maoheim may contain outlooks", "This transcript of Marheim ma contain outlooks", "This transcript of Marheim 1ay contain outlooks", "This transcript of Marhei1 may contain outlooks"]
    texts += ["A replay is there until May 3 under the code", "A replay is there until Octobel 7 under the code", "A replay is there until luly 20 under the code", "A replay is there until oay 1 under the code", "A replay is there until June 9 under the code"]
    assert _found(spark, [(i, "A", x) for i, x in enumerate(texts[:5] * 2 + texts[5:] * 2)]) == {(i, 1) for i in range(20)}
