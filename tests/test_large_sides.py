"""Joins whose sides grow in the plan are never broadcast; their results stay whole."""

import random

from pyspark.sql import functions as F

from replistat.operators import raster, scan
from replistat.operators.near import near_pairs


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_pairs_join_is_no_broadcast(spark):
    df = spark.range(200).selectExpr("id", "cast(id % 5 AS int) AS k", "cast(id % 17 AS double) AS x", "cast(id % 13 AS double) AS y", "3.0D AS reach")
    assert "BroadcastHashJoin" not in _plan(near_pairs(df, df, ["k"], "x", "y", "reach", lambda a, b: a("reach")))


def test_near_pairs_of_two_sides_of_any_size_and_reach(spark):
    rng = random.Random(3)
    point = lambda i: (i, rng.choice([rng.uniform(-90, 90), 64.0 * rng.randint(-2, 2)]), rng.uniform(-90, 90), rng.choice([0.5, 4.0, 31.0, 64.0]))
    many, few = [point(i) for i in range(150)], [point(i) for i in range(40)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, x double, y double, reach double").withColumn("k", F.lit(1))
    for a, b in ((many, few), (few, many)):
        want = {(p[0], q[0]) for p in a for q in b if ((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) ** 0.5 <= max(p[3], q[3])}
        got = near_pairs(frame(a), frame(b), ["k"], "x", "y", "reach", lambda s, t: F.greatest(s("reach"), t("reach"))).select("a_id", "b_id").collect()
        assert len(got) == len(set(map(tuple, got))) and {(r[0], r[1]) for r in got} == want


def test_only_offsets_are_broadcast_in_a_scan(spark):
    df = spark.range(5000).selectExpr("id % 700 AS g", "id AS o")
    got = scan.row_numbers(df, ["g"], ["o"], "n")
    assert _plan(got).count("BroadcastHashJoin") == 1
    assert got.filter("n <> o div 700 + 1").count() == 0 and got.count() == 5000
    one = scan.row_numbers(df.withColumn("g", F.lit(1)), ["g"], ["o"], "n")
    assert one.filter("n <> o + 1").count() == 0


def test_blank_reference_is_not_broadcast(spark):
    p = spark.range(400).selectExpr("id % 4 AS image_id", "(id div 4) % 10 AS y", "(id div 40) AS x", "cast(id % 7 AS double) AS value")
    out = raster.subtract_blank(p, raster.blank_reference(p))
    assert "SortMergeJoin" in _plan(out)
    assert out.count() == 400
