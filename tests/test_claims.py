"""Claims work on atoms: elements of an image that have the same candidates."""

from replistat.operators import sets


def test_rounds_hold_atoms_and_sizes_agree_with_elements(spark):
    rows = [("i", c, e, o) for c, o, es in ((1, 1, range(0, 40)), (2, 2, range(30, 60)), (3, 3, range(20, 45))) for e in es]
    df = spark.createDataFrame(rows + rows[:7], "img string, c long, e long, o int")
    atoms, _ = sets._claimed_atoms(df, "img", "c", "e", "o", 0.5)
    assert atoms.count() == 5       # of 60 elements, 0-19, 20-29, 30-39, 40-44 and 45-59
    want = {1: 40, 2: 20}
    assert {r["c"]: r["n_claimed"] for r in sets.claimed_sizes(df, "img", "c", "e", "o", 0.5).collect()} == want
