"""Sets travel packed: few bytes an element, nothing lost between buckets."""

import random

import pyarrow as pa

from replistat.operators import sets
from replistat.operators.parity import packed, unpacked


def written(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def near_pairs(m, seed=1):
    rnd = random.Random(seed)
    out = []
    for c in range(0, m, 2):
        base = rnd.sample(range(4000), 300)
        out += [(1, c, [f"word{x}" for x in base]), (1, c + 1, [f"word{x}" for x in base[5:]])]
    return out


def test_packs_hold_rows_empty_arrays_and_nulls():
    t = pa.table({"at": pa.array([3, 1, 2, 7], pa.int32()), "_e": pa.array([["b", "a", None], ["b"], [], ["c", "a"]])})
    got = unpacked([packed(t, "_e"), packed(t.slice(1, 2), "_e"), packed(t.slice(0, 0), "_e")], "_e")
    assert [(a, set(e)) for a, e in zip(got["at"].to_pylist(), got["_e"].to_pylist())] == [
        (3, {"a", "b", None}), (1, {"b"}), (2, set()), (7, {"a", "c"}), (1, {"b"}), (2, set())]
    numbers = pa.table({"_e": pa.array([[5, -3], [2**60]])})
    assert [set(e) for e in unpacked([packed(numbers, "_e")], "_e")["_e"].to_pylist()] == [{5, -3}, {2**60}]


def test_shuffles_take_few_bytes_an_element(spark):
    rows = near_pairs(2000)
    df = sets.cut_lineage(spark.createDataFrame(rows, "i long, c long, e array<string>"))
    before = written(spark)
    kept = {r["c"] for r in sets.suppress_overlaps(df, "i", "c", "e").collect()}
    assert kept == set(range(0, 2000, 2))
    assert written(spark) - before < 10 * sum(len(e) for _, _, e in rows)


def test_many_buckets_lose_no_pair(spark, monkeypatch):
    rnd = random.Random(3)
    rows = {}
    for c in range(120):
        base = range(c % 8 * 20, c % 8 * 20 + rnd.choice([1, 3, 15, 60]))
        rows["xy"[c % 2], c] = {x for x in base if rnd.random() < 0.9} | {999}
    df = spark.createDataFrame([(i, c, [f"e{x}" for x in s]) for (i, c), s in rows.items()], "i string, c long, e array<string>")
    monkeypatch.setattr(sets, "BUCKET", 20)
    got = {(r["image_id"], r["cand_id"]) for r in sets.suppress_overlaps(df.toDF("image_id", "cand_id", "e"), "image_id", "cand_id", "e").collect()}
    kept = {}
    for (i, c), s in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0][1])):
        if all(i != j or len(s & t) / len(s | t) <= 0.5 for (j, _), t in kept.items()):
            kept[i, c] = s
    assert got == set(kept) and 10 < len(kept) < 110
