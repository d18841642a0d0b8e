"""Where equal optima pair different first ends with the same second ends, the later first end is taken, as the SQL does."""

import itertools
import random

from checks import joins_q
from replistat.operators import matching


def optima(edges):
    """All matchings with most pairs and least total, as sets of (a, b)."""
    best, found = (0, 0.0), [frozenset()]
    for k in range(1, min(len({a for a, *_ in edges}), len({b for _, b, _ in edges})) + 1):
        for part in itertools.combinations(edges, k):
            if len({a for a, *_ in part}) == len({b for _, b, _ in part}) == k:
                score = (-k, sum(d for *_, d in part))
                if score < best:
                    best, found = score, []
                if score == best:
                    found.append(frozenset((a, b) for a, b, _ in part))
    return found


def test_later_ends_in_stars_and_other_components(spark):
    rnd = random.Random(11)
    groups = [[(1, 10, 2.0), (2, 10, 2.0), (3, 10, 4.0)]]
    for g in range(1, 25):
        groups.append([(g * 100 + a, g * 100 + b, float(rnd.choice([1, 2, 3]))) for a, b in rnd.sample([(a, b) for a in range(4) for b in range(3)], 7)])
    rows = [e for es in groups for e in es]
    df = spark.createDataFrame(rows, "a long, b long, distance double").repartition(4)
    got = [(r["a"], r["b"]) for r in matching.optimal_matching(df, "a", "b", last=True).collect()]
    ties = 0
    for g, es in enumerate(groups):
        mine = frozenset(x for x in got if x in {(a, b) for a, b, _ in es})
        all_of = optima(es)
        assert mine in all_of
        same = [sorted((a for a, _ in o), reverse=True) for o in all_of if {b for _, b in o} == {b for _, b in mine}]
        ties += len({tuple(x) for x in same}) > 1
        assert sorted((a for a, _ in mine), reverse=True) == max(same)
    assert ties > 3


def test_the_queries_take_the_later_end(spark, monkeypatch):
    rows = [(1, 7, "t0", 0.0), (2, 7, "t0", 0.0), (3, 7, "t7", 5.0)]
    o = spark.createDataFrame([(i, k, t, x, 0.0, 40.0, "PASS") for i, k, t, x in rows],
                              "object_id long, pair_key long, timepoint string, centroid_x double, centroid_y double, equivalent_diameter_px double, qc_flag string")
    monkeypatch.setattr(joins_q.v, "gated", lambda spark, d: o)
    assert [tuple(r) for r in joins_q.optimal_matching_q(spark, "").collect()] == [(2, 3, 5.0)]


def test_pairs_take_the_later_end_too(spark, monkeypatch):
    from pyspark.sql import functions as F

    o = spark.createDataFrame([(1, 7, "t0", 0.0), (2, 7, "t0", 0.0), (3, 7, "t7", 5.0)], "object_id long, pair_key long, timepoint string, centroid_x double")
    o = o.withColumns({c: F.lit(40.0) for c in ("centroid_y", "equivalent_diameter_px", "equivalent_diameter_um", "volume_sphere_um3", "circularity")}).withColumns(
        {"qc_flag": F.lit("PASS"), "cond": F.lit("A"), "replicate": F.lit("r"), "fov": F.lit(1)})
    monkeypatch.setattr(joins_q.v, "gated", lambda spark, d: o)
    assert {tuple(r) for r in joins_q.matched_pair_ids(spark, "").collect()} == {(1, "UNPAIRED"), (2, "7_pair1"), (3, "7_pair1")}
