import itertools
import random

import pytest
from pyspark.sql import functions as F

from replistat.functions import naming
from replistat.operators import gates, graph, matching, ranktests, raster, resample, scan, sets
from replistat.operators.near import near_pairs


def slow_quantile(values, share):
    s = sorted(values)
    at = share * (len(s) - 1)
    low = int(at)
    return s[low] + (s[min(low + 1, len(s) - 1)] - s[low]) * (at - low)


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_quantiles_and_scans_with_ties_common_prefixes_and_a_hot_group(spark, parts):
    rnd = random.Random(1)
    rows = [(i, None if i % 11 == 0 else "hot|common|prefix" if i % 10 else f"k{i % 3}", 1.0 if i % 10 < 9 else rnd.choice([-1.0, 1.0]) * rnd.random() ** 4 * 1000 if i % 7 else None) for i in range(1, 900)]
    df = spark.createDataFrame(rows, "id long, k string, v double").repartition(5)
    spec = {"q1": (F.col("v"), 0.25), "med": (F.col("v"), 0.5), "q9": (F.col("v"), 0.9)}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r["k"]: tuple(r)[1:] for r in scan.group_summary(df, ["k"], spec, [F.count("v").alias("n")]).collect()}
        total = scan.group_summary(df, [], spec).first()
        scans = []
        for order in ([F.col("v").desc(), "id"], [F.col("v").asc(), F.col("id").desc()]):
            scans.append({r["id"]: (r["s"], r["m"], r["c"]) for r in scan.running(df, ["k"], order, {"s": ("sum", F.col("id")), "m": ("max", F.col("id")), "c": ("count", F.lit(1))}).collect()})
        everywhere = {r["id"]: r["c"] for r in scan.row_numbers(df, [], ["id"], "c").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    groups = {k: [r for r in rows if r[1] == k] for k in {r[1] for r in rows}}
    for k, g in groups.items():
        vs = [r[2] for r in g if r[2] is not None]
        assert got[k] == pytest.approx((len(vs), *(slow_quantile(vs, s) for s in (0.25, 0.5, 0.9))))
    vs = [r[2] for r in rows if r[2] is not None]
    assert tuple(total) == pytest.approx(tuple(slow_quantile(vs, s) for s in (0.25, 0.5, 0.9)))
    least = float("-inf")
    keys = (lambda r: (-r[2] if r[2] is not None else float("inf"), r[0]), lambda r: (r[2] if r[2] is not None else least, -r[0]))
    for found, key in zip(scans, keys):
        for g in groups.values():
            s = m = 0
            for i, r in enumerate(sorted(g, key=key), 1):
                s, m = s + r[0], max(m, r[0])
                assert found[r[0]] == (s, m, i)
    assert everywhere == {r[0]: r[0] for r in rows}


def test_a_hot_group_is_dealt_over_many_tasks(spark):
    df = spark.range(20_000).select(F.lit("same").alias("k"), F.lit(1.0).alias("v"), "id")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        sizes = [r[0] for r in df.repartitionByRange(20, "k", "v", "id").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1))).collect() if r]
        placed = scan.row_numbers(df, ["k"], ["v", "id"], "n")
        assert placed.filter("n <> id + 1").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(sizes) >= 15


def test_first_of_each_stratum_follows_the_order_of_the_column(spark):
    df = spark.range(1, 30).select(F.col("id"), (F.col("id") % 1).alias("s"))
    for parts in (1, 3, 13):
        got = gates.stratified_sample(df.repartition(parts), "s", "id", 5).collect()
        assert sorted(r["id"] for r in got) == [1, 2, 3, 4, 5]


def test_names(spark):
    stems = ["Day0 mat gel01_5_TRANS", "D7_S34 D30_gel2_0012_TRANS", "Day0 Mat gel1_0001_TRANS (1)", "Day0 Mat+drug gel1_1_TRANS", "nothing", "S50_gel3_7_TRANS"]
    df = spark.createDataFrame([(s,) for s in stems], "s string")
    got = [tuple(r) for r in df.select(naming.parse_stem("s", F.lit("day 7")).alias("m")).select("m.pair_key", "m.timepoint", "m.error").collect()]
    assert got == [("Mat_gel1_0005", "t0", None), ("S34D30_gel2_0012", "t7", None), (None, None, "copy_suffix"),
                   (None, None, "ambiguous_condition"), (None, None, "unmatched"), ("S50_gel3_0007", "t7", None)]


def brute_matching(edges):
    best = (0, 0.0)
    for n in range(len(edges), 0, -1):
        for pick in itertools.combinations(edges, n):
            if len({e[0] for e in pick}) == n and len({e[1] for e in pick}) == n:
                cost = sum(e[2] for e in pick)
                if n > best[0] or (n == best[0] and cost < best[1]):
                    best = (n, cost)
        if best[0]:
            return best
    return best


def test_matching_is_optimal(spark):
    rnd = random.Random(3)
    rows, want = [], []
    for g in range(8):
        pairs = rnd.sample([(a, b) for a in range(4) for b in range(4)], 9)
        edges = [(g * 100 + a, g * 100 + b, round(rnd.random(), 3)) for a, b in pairs]
        rows += edges
        want.append(brute_matching(edges))
    got = matching.optimal_matching(spark.createDataFrame(rows, "a long, b long, distance double"), "a", "b").collect()
    for g, (n, cost) in enumerate(want):
        mine = [r for r in got if r["a"] // 100 == g]
        assert len(mine) == n and sum(r["distance"] for r in mine) == pytest.approx(cost)


def test_greedy_rounds_equal_the_loop(spark):
    rnd = random.Random(5)
    edges = [(a, b, rnd.random(), rnd.choice([a, b])) for a, b in rnd.sample(list(itertools.combinations(range(25), 2)), 80)]
    df = spark.createDataFrame(edges, "a long, b long, d double, l long")
    got = {r["loser"] for r in graph.greedy_losers(df, "a", "b", ["d", "a", "b"], F.col("l")).collect()}
    lost = set()
    for a, b, _, loser in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if a not in lost and b not in lost:
            lost.add(loser)
    assert got == lost
    nodes = spark.range(25).withColumnRenamed("id", "n")
    kept = {r["n"] for r in graph.greedy_kept(nodes, df, "n", "a", "b").collect()}
    want = []
    for n in range(25):
        if not any((k, n) in {(a, b) for a, b, *_ in edges} for k in want):
            want.append(n)
    assert kept == set(want)


def test_near_pairs_equal_brute_force(spark):
    rnd = random.Random(7)
    pts = [(i, i % 2, rnd.random() * 300, rnd.random() * 300, rnd.choice([3.0, 20.0, 90.0])) for i in range(120)]
    df = spark.createDataFrame(pts, "id long, k int, x double, y double, reach double")
    got = {(r["a_id"], r["b_id"]) for r in near_pairs(df, df, ["k"], "x", "y", "reach", lambda a, b: (a("reach") + b("reach")) / 2).collect()}
    want = {(p[0], q[0]) for p in pts for q in pts if p[1] == q[1] and ((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2) ** 0.5 <= (p[4] + q[4]) / 2}
    assert got == want


def test_overlap_suppression_with_copies(spark):
    sets_ = {1: range(10), 2: range(10), 3: range(1, 10), 4: range(20, 30), 5: range(26, 36), 6: range(9)}
    df = spark.createDataFrame([("i", c, e) for c, es in sets_.items() for e in es], "img string, c long, e long")
    kept = {r["c"] for r in sets.suppress_overlaps(df, "img", "c", "e").collect()}
    assert kept == {1, 4, 5}
    rows = spark.createDataFrame([("i", c, e, -len(list(es))) for c, es in sets_.items() for e in es], "img string, c long, e long, o int")
    got = sets.claim_elements(rows, "img", "c", "e", "o").groupBy("c").count().collect()
    assert {r["c"]: r["count"] for r in got} == {1: 10, 4: 10, 5: 6}


def test_digital_disks(spark):
    rows = [(n, y, x, 1.0, 1) for n, r2 in enumerate((1933, 2106, 2909)) for y in range(-60, 61) for x in range(-60, 61) if x * x + y * y <= r2]
    px = spark.createDataFrame(rows, "image_id int, y int, x int, value double, label int")
    p = [r["perimeter_px"] for r in raster.perimeters(px).orderBy("image_id").collect()]
    s = [r["solidity"] for r in raster.solidity(px).orderBy("image_id").collect()]
    assert p == pytest.approx([287.76450198781714, 299.0782104868019, 353.7056274847714], rel=1e-13)
    assert s == pytest.approx([0.9882831570382424, 0.9904148569716938, 0.9904648390941597], rel=1e-13)


def test_permutation_edge_cases(spark):
    rows = [(g, f"u{i}", v) for g, vals in {"A": (0, 1, 2), "B": (10, 11, 12), "C": (5,), "D": (1, 1, 1)}.items() for i, v in enumerate(vals)]
    rows.append(("B", "u9", float("nan")))
    df = spark.createDataFrame([(g, u, float(v)) for g, u, v in rows], "g string, u string, v double")
    t = {r["g"]: r for r in resample.permutation_test(df, "g", "u", "v", "A").collect()}
    pool = [0, 1, 2, 10, 11, 12]
    diffs = [abs(sorted(a)[1] - sorted(set(pool) - set(a))[1]) for a in itertools.combinations(pool, 3)]
    assert t["B"]["p_raw"] == pytest.approx(sum(x >= 10 for x in diffs) / len(diffs)) and t["B"]["n_treat"] == 3
    assert t["C"]["p_raw"] is None and t["C"]["method"] == "untested"
    assert t["D"]["p_raw"] == pytest.approx(1.0)
    mc = resample.permutation_test(df.filter("g in ('A', 'B')"), "g", "u", "v", "A", n_perm=300, exact_limit=3).first()
    assert mc["method"] == "monte_carlo" and 0.1 < mc["p_raw"] < 0.3


def test_bootstrap_is_wider_over_units_and_repeatable(spark):
    rnd = random.Random(11)
    rows = [("g", f"u{u}", mu + rnd.gauss(0, 0.1)) for u, mu in enumerate((0.0, 0.5, 1.0, 1.5)) for _ in range(30)]
    df = spark.createDataFrame(rows, "g string, u string, v double")
    a = resample.bootstrap_interval(df, ["g"], "u", "v", n_boot=200).first()
    b = resample.bootstrap_interval(df.repartition(7), ["g"], "u", "v", n_boot=200).first()
    n = resample.bootstrap_interval(df, ["g"], None, "v", n_boot=200).first()
    assert (a["ci_low"], a["ci_high"]) == pytest.approx((b["ci_low"], b["ci_high"]))
    assert a["ci_high"] - a["ci_low"] > 2 * (n["ci_high"] - n["ci_low"])


def test_rank_tests_hand_values(spark):
    df = spark.createDataFrame([("k", 0.0, float(v)) for v in (1, 2, 3, 4, 5)], "k string, a double, b double")
    assert ranktests.signed_rank_test(df, ["k"], "a", "b").first()["p_value"] == pytest.approx(0.0625)
    two = spark.createDataFrame([("c", float(v)) for v in (1, 2, 3)] + [("t", float(v)) for v in (4, 5, 6)], "g string, v double")
    r = ranktests.rank_sum_test(two, "g", "v", "c").first()
    assert r["u_group"] == 9.0 and r["p_value"] == pytest.approx(0.1)


def test_adjustments(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, None), (4, 0.03)], "i int, p double")
    holm = {r["i"]: r["p_adj"] for r in resample.adjust_pvalues(df, [], "p").collect()}
    assert holm[3] is None and [holm[i] for i in (1, 4, 2)] == pytest.approx([0.03, 0.06, 0.06])
    bh = {r["i"]: r["p_adj"] for r in resample.adjust_pvalues(df, [], "p", "bh").collect()}
    assert [bh[i] for i in (1, 4, 2)] == pytest.approx([0.03, 0.04, 0.04])


def test_components(spark):
    nodes = spark.range(12)
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 6)] + [(8, 9)], "a long, b long")
    got = {r["id"]: r["component"] for r in graph.connected_components(nodes, edges, "id", "a", "b").collect()}
    assert got == {**{i: 0 for i in range(7)}, 7: 7, 8: 8, 9: 8, 10: 10, 11: 11}


def test_exact_rank_tests_by_enumeration(spark):
    rnd = random.Random(9)
    a, b = [round(rnd.random(), 6) for _ in range(4)], [round(rnd.random() + 0.3, 6) for _ in range(6)]
    rows = [("t", x) for x in a] + [("c", x) for x in b] + [("big", rnd.random()) for _ in range(5)] + [("tied", 1.0)] * 3
    rows += [("c", x) for x in []]
    got = {r["g"]: r for r in ranktests.rank_sum_test(spark.createDataFrame(rows, "g string, v double"), "g", "v", "c").collect()}
    both = sorted(a + b)
    ranks = lambda some: sum(both.index(x) + 1 for x in some) - len(some) * (len(some) + 1) / 2
    u = max(ranks(a), 24 - ranks(a))
    sets_ = [ranks(c) for c in itertools.combinations(both, 4)]
    assert got["t"]["p_value"] == pytest.approx(min(1.0, 2 * sum(x >= u for x in sets_) / len(sets_)))
    assert got["t"]["p_method"] == "exact" and got["tied"]["p_method"] == "normal"
    diffs = [0.5, -1.0, 2.0, 3.5, 4.0, -0.2, 6.0]
    w = min(sum(sorted(map(abs, diffs)).index(abs(x)) + 1 for x in diffs if x > 0), sum(sorted(map(abs, diffs)).index(abs(x)) + 1 for x in diffs if x < 0))
    sums = [sum(i + 1 for i in range(7) if m >> i & 1) for m in range(128)]
    df = spark.createDataFrame([("k", 0.0, x) for x in diffs], "k string, a double, b double")
    s = ranktests.signed_rank_test(df, ["k"], "a", "b").first()
    assert s["p_value"] == pytest.approx(min(1.0, 2 * sum(x <= w for x in sums) / 128)) and s["p_method"] == "exact"


def test_exact_rank_test_against_a_long_control(spark):
    rows = [("t", 0.5 + i * 1e-7) for i in range(8)] + [("c", i + 0.25) for i in range(200_000)]
    r = ranktests.rank_sum_test(spark.createDataFrame(rows, "g string, v double"), "g", "v", "c").first()
    assert r["p_method"] == "exact" and 0 < r["p_value"] < 1e-6


def test_overlap_edges_name_every_pair(spark):
    rnd = random.Random(2)
    rows = {}
    for i in range(2):
        for c in range(24):
            base = set(range(c % 5 * 10, c % 5 * 10 + 8))
            rows[i, c] = base if c % 3 else base ^ {rnd.randrange(60) for _ in range(3)}
    rows[0, 90], rows[0, 91], rows[0, 92] = {1000}, {1000}, {1001}
    df = spark.createDataFrame([(i, c, f"e{x}") for (i, c), s in rows.items() for x in s], "image long, cand long, elem string")
    edges, classes = sets.overlap_edges(df, "image", "cand", "elem")
    members = {}
    for r in classes.collect():
        members.setdefault((r["image"], r["rep"]), []).append(r["cand"])
    got, n = set(), 0
    for r in edges.collect():
        a, b = members[r["image"], r["first"]], members[r["image"], r["second"]]
        pairs = {(r["image"], min(x, y), max(x, y)) for x in a for y in b if x != y}
        assert len(pairs) == r["n_pairs"]
        got |= pairs
        n += len(pairs)
    want = {(i, a, b) for (i, a), s in rows.items() for (j, b), t in rows.items() if i == j and a < b and len(s & t) / len(s | t) > 0.5}
    assert got == want and n == len(want)


def test_field_extent_methods_and_empty_fields(spark):
    disk = [(1, y, x) for y in range(30) for x in range(30) if (y - 15) ** 2 + (x - 15) ** 2 <= 144]
    nuclei = [(1, 5, 5), (1, 5, 9), (1, 9, 5), (2, 2, 2), (2, 2, 8), (2, 8, 2), (2, 8, 8)]
    p = "image_id long, y long, x long"
    fields = spark.createDataFrame([(1, 30, 30), (2, 30, 40), (3, 20, 40)], "image_id long, image_h long, image_w long")
    fg, nu = spark.createDataFrame(disk + [(2, 1, 1)], p), spark.createDataFrame(nuclei, p)
    got = {r["image_id"]: r for r in raster.field_extent(fg, nu, 2.0, fields=fields).collect()}
    assert got[1]["method"] == "actin_threshold" and got[1]["area_px"] == len(disk) and not got[1]["hull_fallback"]
    assert got[2]["method"] == "nuclei_convex_hull_fallback" and got[2]["area_px"] == 49 and got[2]["hull_fallback"]
    assert (got[3]["method"], got[3]["area_px"], got[3]["centroid_y_um"], got[3]["centroid_x_um"], got[3]["hull_fallback"]) == ("none", None, 20.0, 40.0, False)
    d = 2 * (got[1]["area_um2"] / 3.141592653589793) ** 0.5
    assert got[1]["volume_um3"] == pytest.approx(3.141592653589793 * d**3 / 6)
    assert {r["method"] for r in raster.field_extent(fg, nu, 2.0, method="nuclei_convex_hull").collect()} == {"nuclei_convex_hull"}


def test_field_flags(spark):
    rows = [("ok", 5, 2.0, 0.0, 0, 0, 0, 0.1), ("empty", 0, 2.0, 0.0, 0, 0, 0, None), ("dark", 0, 1.0, None, 0, None, None, None), ("bad", 4, None, 0.1, 2, 1, 0, 0.3)]
    df = spark.createDataFrame(rows, "k string, n_objects long, snr double, saturation_frac double, n_duplicates_removed long, debris_count long, merged_count long, edge_touching_frac double")
    got = {r["k"]: [n for n in gates.OWN_FLAGS if r["flag_" + n]] for r in gates.field_flags(df).collect()}
    assert got == {"ok": [], "empty": ["empty_seg"], "dark": ["low_snr"], "bad": ["dup_masks", "debris_or_merged", "edge_heavy", "saturated"]}


def test_type_one_error_of_the_unit_test(spark):
    """252 comparisons of 4 against 4 units drawn alike, with strong unit effects: few fall below 0.05."""
    rnd, hits, n = random.Random(12), 0, 0
    for _ in range(4):
        rows = []
        for g in ["c", *(f"t{i}" for i in range(63))]:
            for u in range(4):
                unit = rnd.gauss(0, 0.5)
                rows += [(g, f"u{u}", unit + rnd.gauss(0, 0.1)) for _ in range(3)]
        p = [r["p_raw"] for r in resample.permutation_test(spark.createDataFrame(rows, "g string, u string, v double"), "g", "u", "v", "c").collect()]
        assert len(p) == 63 and min(p) >= 2 / 70 - 1e-12
        hits, n = hits + sum(x <= 0.05 for x in p), n + len(p)
    assert hits / n <= 0.08
