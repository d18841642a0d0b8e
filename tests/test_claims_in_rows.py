"""Claims of small images are settled in one row each; only large images go through rounds."""

import random

import pytest

from replistat.operators import sets


def by_hand(rows, limit=0.5):
    """Candidates of each image in order, one after another."""
    sets_of, order = {}, {}
    for i, c, es, o in rows:
        sets_of.setdefault((i, c), set()).update(es)
        order[i, c] = (o, c)
    have, out = {}, set()
    for i, c in sorted(sets_of, key=lambda k: (k[0], order[k])):
        fresh = sets_of[i, c] - have.get(i, set())
        if fresh and (len(sets_of[i, c]) - len(fresh)) / len(sets_of[i, c]) < limit:
            have.setdefault(i, set()).update(fresh)
            out.add((i, c, len(fresh)))
    return out


@pytest.mark.parametrize("one_row", [10**9, 2_000, 0])
def test_arrays_in_rows_and_in_rounds_agree_with_a_walk(spark, one_row):
    rnd = random.Random(5)
    rows = []
    for i in range(25):
        for c in range(rnd.randint(1, 7)):
            o = rnd.randint(0, 2)
            for _ in range(rnd.choice((1, 1, 2))):
                a = rnd.randint(0, 20)
                rows.append((i, c, list(range(a, a + rnd.randint(1, 15))), o))
    df = spark.createDataFrame(rows, "img int, c long, e array<long>, o int").repartition(5)
    got = sets.claimed_sizes(df, "img", "c", "e", "o", one_row=one_row)
    assert {tuple(r) for r in got.collect()} == by_hand(rows)


def test_small_images_shuffle_no_elements(spark, monkeypatch):
    monkeypatch.setattr(sets, "_claimed_atoms", lambda *a: pytest.fail("a small image went through rounds"))
    df = spark.createDataFrame([(1, 1, [1, 2, 3, None], 0), (1, 2, [3, 4], 1), (1, 3, None, 2), (None, 4, [9], 0)], "img int, c long, e array<long>, o int")
    assert {tuple(r) for r in sets.claimed_sizes(df, "img", "c", "e", "o").collect()} == {(1, 1, 3)}
