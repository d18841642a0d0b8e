"""Bounded set-similarity join against brute force, and how few candidates it makes."""

import random

import pytest
from pyspark.sql import functions as F

from replistat.operators import sets


def near_and_far(seed, n=60, images=2):
    rnd = random.Random(seed)
    out = {}
    for i in range(images):
        base = [set(rnd.sample(range(400), rnd.randrange(1, 60))) for _ in range(8)]
        for c in range(n):
            s = set(rnd.choice(base))
            for _ in range(rnd.randrange(0, 20)):
                s ^= {rnd.randrange(400)}
            out[i, c] = s | {-1} if s else {-1}                        # one element that all share
    out[0, n], out[0, n + 1], out[0, n + 2] = {1, 2}, {1, 2, 3, 4}, {1, 2, 3}        # shares of exactly 1/2, 2/3, 3/4
    return out


@pytest.mark.parametrize("limit", [0.5, 0.2, 2 / 3, 0.9])
def test_edges_equal_brute_force(spark, limit):
    rows = near_and_far(int(limit * 100))
    df = spark.createDataFrame([(i, c, f"e{x}") for (i, c), s in rows.items() for x in s], "image long, cand long, elem string")
    edges, classes = sets.overlap_edges(df, "image", "cand", "elem", limit)
    rep = {(r["image"], r["cand"]): r["rep"] for r in classes.collect()}
    want = {(i, *((a, b) if (-len(s), a) < (-len(t), b) else (b, a)), len(s & t)) for (i, a), s in rows.items() for (j, b), t in rows.items()
            if i == j and a < b and s != t and rep[i, a] == a and rep[i, b] == b and len(s & t) / len(s | t) > limit}
    got = {(r["image"], r["first"], r["second"], r["n_both"]) for r in edges.collect() if r["first"] != r["second"]}
    assert got == want and want


def test_signatures_never_overstate_a_difference(spark):
    rows = near_and_far(4, 30, 1)
    df = spark.createDataFrame([(c, f"e{x}") for (_, c), s in rows.items() for x in s], "c long, e string")
    for bits in (64, 4096):
        sig = {r["c"]: r["_sig"] for r in sets.signatures(df, ["c"], "e", bits).collect()}
        assert all(len(s) == bits // 64 for s in sig.values())
        for (_, a), s in rows.items():
            for (_, b), t in rows.items():
                assert sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(sig[a], sig[b])) <= len(s ^ t)


def test_few_candidates_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text is not null")
    e = docs.select(F.lit(0).alias("i"), F.col("doc_id").alias("c"), F.explode(F.split("text", " ")).alias("e")).distinct()
    reps = sets.cut_lineage(sets.overlap_classes(e, "i", "c", "e").filter("c = rep"))
    pairs, _ = sets.overlap_candidates(e, reps, "i", "c", "e")
    edges, _ = sets.overlap_edges(e, "i", "c", "e")
    n = edges.filter("first <> second").count()
    assert 0 < n <= pairs.count() <= 5 * n
