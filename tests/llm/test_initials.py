from finloom.llm.name_variants import link_names, same_name_pairs


def test_initials_meet_their_own_and_stay_alone_between_two_bearers(spark):
    counts = {"P.T. Smith": 9, "P.Q. Smith": 4, "P.Q. Smiht": 1, "Javier Molcogiso": 9, "Jennifer Molcogiso": 5, "J. Molcogiso": 2, "Kofi Zibelpysh": 5, "K. Zibelpysh": 1}
    t = spark.createDataFrame([(x,) for x, n in counts.items() for _ in range(n)], "speaker string")
    got = {tuple(r) for r in same_name_pairs(link_names(t)).collect()}
    assert got == {("P.Q. Smiht", "P.Q. Smith"), ("K. Zibelpysh", "Kofi Zibelpysh")}
