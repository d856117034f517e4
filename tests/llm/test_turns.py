import pytest

from finloom.llm.turns import clean_names, said, speaker_turns, turns


def numbers(text, speaker=None, gone=()):
    return [(p.no, n) for p, _, n in turns(text, speaker, set(gone))]


@pytest.mark.parametrize(
    "text, speaker, want",
    [
        ("Thanks all.\nJane Roe: Hello there.\nand more\nOperator: Next one.\nJ. Roe: Bye.", "Kim Poe", [(1, 2), (2, 4), (3, 2), (2, 1)]),
        # The label that names the speaker of the row goes on with the opening words.
        ("Hi.\nPoe, Kim: I am here.", "K. Poe", [(1, 4)]),
        # Labels of all shapes name one person; time marks, notes and hesitations are no words.
        ("[00:01] Jane Roe -- Half Moon: um, one\n<00:02:10> JANE ROE: two\nQ - Jane Roe: [music] three\n[Jane Roe]: four\n<Jane Roe> five\n>> Jane Roe (CEO): six uh-huh, 00:03:04 seven\nRoe: eight 7m10s", None, [(1, 8)]),
        # A label with nothing said neither ends a turn nor makes a speaker.
        ("Jane Roe: one\nKim Poe: [laughter] um,\ntwo", None, [(1, 2)]),
        # Cue numbers and time ranges of subtitles.
        ("3\n00:07:10,845 --> 00:07:19,401\nJane Roe: one two\n4\n00:07:20,000 --> 00:07:29,000\nthree", None, [(1, 3)]),
        ("operator: a\nConference Operator: b\n[Operator]: c\nOPERATOR -- d", None, [(1, 4)]),
        # Abbreviations, clock times and terms in brackets are words; noises in capitals are not.
        ("Jane Roe: ER visits at 3:06 p.m. (ex-currency) UM, fell Uh... ((pause)) *coughs* {noise} [ph] (laughter)", None, [(1, 7)]),
        ("", "x", []),
        (None, None, []),
        ("um uh [music]", "x", []),
        ("just words", None, [(1, 2)]),
        ("Wei Roe: a\nJane Roe: b\nW. Roe: c", None, [(1, 1), (2, 1), (1, 1)]),
        ("Jane Roe: it opens at 10:30 now\r\nnext line", None, [(1, 7)]),
    ],
)
def test_turns(text, speaker, want):
    assert numbers(text, speaker) == want


def test_repeated_lines_are_left_out():
    assert numbers("Jane Roe: a\nShare this call\nb", None, [2]) == [(1, 2)]


def test_notes():
    assert said("a [Indiscernible] b (non-GAAP) c [non-GAAP] (CROSSTALK)").split() == ["a", "b", "(non-GAAP)", "c", "[non-GAAP]"]


def test_roster_names():
    people = [p for p, _, _ in turns("J. Molcogiso: a\nPriya Stasfishano: b\nKofi Other: c", None)]
    got = clean_names(people, ["Javier Molcogiso", "Priya Stasfisshano", "Kim Unrelated"])
    assert got == {1: "Javier Molcogiso", 2: "Priya Stasfisshano", 3: "Kofi Other"}


def test_speaker_turns(spark):
    cols = "chunk_key bigint, doc_id string, ticker string, chunk_type string, speaker string, speaker_role string, phase string, text string, turn_no int"
    rows = [
        (1, "d", "T", "qa_exchange", "J. Molcogiso", "Analyst", "Q&A", "Hello.\nOperator: Next.\nPriya Roe: Yes.", 9),
        (2, "d", "T", "qa_exchange", "Javier Molcogiso", None, None, None, 9),
        (3, "e", None, "qa_exchange", None, "ceo", "qa", "Some words.", 9),
        (4, "d", "T", "prepared_packed", "Javier Molcogiso", None, None, "no turn here", 9),
        (5, None, "T", "qa_exchange", "", None, None, "", 9),
    ]
    t = spark.createDataFrame(rows, cols)
    got = sorted(tuple(r) for r in speaker_turns(t).collect())
    assert got == [
        (1, 1, 1, 1, "Javier Molcogiso", "analyst", "qa", "Hello."),
        (1, 2, 2, 1, "Operator", "operator", "qa", "Next."),
        (1, 3, 3, 1, "Priya Roe", None, "qa", "Yes."),
        (3, 1, 1, 2, None, None, "qa", "Some words."),
    ]
    assert speaker_turns(t.limit(0)).count() == 0
