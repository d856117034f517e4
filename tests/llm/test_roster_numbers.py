from finloom.llm.turns import turns


def numbers(text, speaker=None, roster=()):
    return [p.no for p, _, _ in turns(text, speaker, roster=list(roster))]


def test_labels_of_one_person_of_the_roster_are_one_speaker():
    text = "Mattehw Stasfishano: a\nMathew Stasfishano: b\nMatthew Stasfishano: c\nKim Poe: d"
    assert numbers(text, roster=["Matthew Stasfishano", "Priya Roe"]) == [1, 2]
    assert numbers("Hello.\n" + text, "Mattehw Stasfishano", ["Matthew Stasfishano"]) == [1, 2]


def test_different_people_stay_apart():
    assert numbers("Javier Roe: a\nJennifer Roe: b", roster=["Javier Roe"]) == [1, 2]
    assert numbers("Javier Roe: a\nJennifer Roe: b", roster=["Javier Roe", "Jennifer Roe"]) == [1, 2]
    assert numbers("Mattehw Roe: a\nMathew Roe: b") == [1, 2]


def test_initials_go_to_who_is_there():
    roster = ["John Molcogiso", "Jane Molcogiso"]
    assert numbers("John Molcogiso: a\nKim Poe: b\nJ. Molcogiso: c", roster=roster) == [1, 2, 1]
    assert numbers("J. Molcogiso: a\nKim Poe: b", roster=roster) == [1, 2]


def test_all_people_of_a_block_stay(spark):
    from finloom.llm.turns import roster, speaker_turns

    rows = [("d", "John Smith")] * 5 + [("d", "Jane Smyth")] * 2 + [("e", "Jhon Smith"), ("e", "J. Smith"), ("f", "Priya Roe"), ("f", "P. Roe")]
    t = spark.createDataFrame([(i, d, "T", "qa_exchange", s, None, None, "x") for i, (d, s) in enumerate(rows)], "chunk_key bigint, doc_id string, ticker string, chunk_type string, speaker string, speaker_role string, phase string, text string")
    assert {r.doc_id: r._roster for r in roster(t).collect()} == {"d": ["John Smith", "Jane Smyth"], "e": ["John Smith"], "f": ["Priya Roe"]}
    # The numbers change with the roster: only it tells that the two spellings are one person's.
    text = "Mattehw Roe: a\nMathew Roe: b"
    told = t.limit(0).unionByName(spark.createDataFrame([(90, "g", "T", "qa_exchange", None, None, None, text), (91, "h", "T", "qa_exchange", None, None, None, text), (92, "h", "T", "prepared_packed", "Matthew Roe", None, None, "")], t.schema))
    assert {(r.chunk_key, r.turn_no, r.speaker_no) for r in speaker_turns(told).collect()} == {(90, 1, 1), (90, 2, 2), (91, 1, 1)}


def test_lines_in_the_order_of_their_marks():
    late = "[00:10] Kim Poe: two\nand three\n[00:05] Jane Roe: one"
    assert [(t, p.no) for p, t, _ in turns(late, None)] == [("one", 1), ("two and three", 2)]
    hour = "[59:50] Kim Poe: one\n[00:05] Jane Roe: two"
    assert [t for _, t, _ in turns(hour, None)] == ["one", "two"]
