"""Set overlap by meetings of tiles: what is written grows with the sets, and no pair is lost between tiles."""

import random

import pytest
from pyspark.sql import functions as F

from checks import views as v
from replistat.operators import sets


def written(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_shuffled_bytes_follow_the_sets_not_their_pairs(spark):
    def one(m):
        rnd = random.Random(m)
        rows = [(1, c, f"e{x}") for c in range(m) for x in rnd.sample(range(200), 60)]
        df = sets.cut_lineage(spark.createDataFrame(rows, "i long, c long, e string"))
        before = written(spark)
        assert sets.overlap_edges(df, "i", "c", "e")[0].count() == 0
        return written(spark) - before

    assert one(1200) < 3 * one(400) * 1.3


@pytest.mark.parametrize("limit", [0.3, 0.5])
def test_small_tiles_calls_and_array_rows_lose_no_pair(spark, monkeypatch, limit):
    monkeypatch.setattr(sets, "TILE", 7)
    monkeypatch.setattr(sets, "CALL", 5)
    rnd = random.Random(5)
    rows = {}
    for c in range(90):
        base = set(range(c % 6 * 15, c % 6 * 15 + rnd.choice([1, 4, 12, 40, 90])))
        rows["xyz"[c % 3], c] = {x for x in base if rnd.random() < 0.9} | {rnd.randrange(300), 500}
    df = spark.createDataFrame([(i, c, [f"e{x}" for x in s]) for (i, c), s in rows.items()], "i string, c long, e array<string>")
    edges, classes = sets.overlap_edges(df, "i", "c", "e", limit)
    rep = {r["c"] for r in classes.collect() if r["c"] == r["rep"]}
    want = {(i, *((a, b) if (-len(s), a) < (-len(t), b) else (b, a)), len(s & t)) for (i, a), s in rows.items() for (j, b), t in rows.items()
            if i == j and a < b and a in rep and b in rep and s != t and len(s & t) / len(s | t) > limit}
    got = [(r["i"], r["first"], r["second"], r["n_both"]) for r in edges.collect() if r["first"] != r["second"]]
    assert set(got) == want and len(got) == len(want) > 50
    plain = sets.overlap_edges(df.select("i", "c", F.explode("e").alias("e")), "i", "c", "e", limit)[0]
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, edges.collect()))


def test_set_rows_join_documents_that_repeat_a_key(spark, tmp_path):
    docs = [(1, "en", "a b  a\nc"), (2, "en", "b c"), (2, "en", "c d"), (2, "de", "c"), (3, "en", None), (4, "en", " "), (5, None, "a")]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["image_id"], r["cand_id"]): sorted(r["elem"]) for r in v.set_rows(spark, str(tmp_path)).filter(F.size("elem") > 0).collect()}
    assert got == {("en", 1): ["a", "a\nc", "b"], ("en", 2): ["b", "c", "d"], ("de", 2): ["c"]}
