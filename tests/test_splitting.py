"""Counts split down a tree: samplers, exact distributions of medians, agreement with drawn observations."""

import random
import statistics
from collections import Counter
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from replistat.operators import resample, splitting


def exact_cdf(n, left, right, replace):
    """Distribution function by whole-number counting."""
    from math import comb
    if replace:
        weights = [comb(n, k) * left**k * right ** (n - k) for k in range(n + 1)]
    else:
        weights = [comb(left, k) * comb(right, n - k) if n - k <= right else 0 for k in range(min(n, left) + 1)]
    total, out, run = sum(weights), [], 0
    for w in weights:
        run += w
        out.append(run / total)
    return out


@pytest.mark.parametrize("n,left,right,replace", [(1, 1, 1, True), (40, 3, 5, True), (300, 1, 999, True), (7, 4, 5, False), (60, 50, 40, False), (5, 5, 200, False), (90, 50, 40, False)])
def test_quantiles_of_both_laws(n, left, right, replace):
    u = np.linspace(0.0005, 0.9995, 1500)
    got = splitting.went_left(np.full(u.size, n), np.full(u.size, left), np.full(u.size, right), u, replace)
    cdf = np.array(exact_cdf(n, left, right, replace))
    clear = np.abs(cdf[None, :] - u[:, None]).min(1) > 1e-9
    assert (got == np.searchsorted(cdf, u))[clear].all() and clear.mean() > 0.99


def test_large_counts_and_chunks(monkeypatch):
    rng = np.random.default_rng(3)
    n, left, right, u = rng.integers(1, 10**6, 500), rng.integers(1, 10**6, 500), rng.integers(1, 10**6, 500), rng.random(500)
    whole = splitting.went_left(n, left, right, u, True)
    monkeypatch.setattr(splitting, "CELLS", 5000)
    assert (splitting.went_left(n, left, right, u, True) == whole).all()
    mean, sd = n * left / (left + right), np.sqrt(n * left * right) / (left + right)
    z = (whole - mean) / np.maximum(sd, 1e-9)
    assert np.abs(z).max() < 6 and abs(z.mean()) < 0.2 and 0.85 < z.std() < 1.15
    assert splitting.went_left([5, 5, 0], [3, 0, 3], [0, 3, 3], np.array([0.5] * 3), True).tolist() == [5, 0, 0]


def test_log_factorial():
    import math
    x = np.array([0, 1, 5, 63, 64, 65, 1000, 10**6, 10**9])
    assert np.allclose(splitting.log_factorial(x), [math.lgamma(v + 1) for v in x], rtol=3e-15, atol=1e-14)


@pytest.mark.parametrize("size,chosen", [(7, 3), (6, 2), (5, 5 - 1), (2, 1)])
def test_relabelled_medians_have_the_exact_joint_law(size, chosen):
    trials = 20000
    got = Counter(map(tuple, splitting.split_medians([f"k{i}" for i in range(trials)], np.full(trials, size), np.full(trials, chosen)).tolist()))
    want = Counter()
    for s in combinations(range(size), chosen):
        rest = [i for i in range(size) if i not in s]
        want[s[(len(s) - 1) // 2], s[len(s) // 2], rest[(len(rest) - 1) // 2], rest[len(rest) // 2]] += 1
    total = sum(want.values())
    assert set(got) <= set(want)
    assert sum((got[k] - trials * n / total) ** 2 / (trials * n / total) for k, n in want.items()) < len(want) + 5 * (2 * len(want)) ** 0.5 + 5


def test_bootstrap_medians_have_the_exact_law(spark):
    """Two clusters: all 4 x 27 x 8 draws enumerated."""
    clusters = {"a": [1.0, 2.0, 9.0], "b": [2.0, 5.0]}
    want, total = Counter(), 0.0
    for pair in product("ab", repeat=2):
        each = [list(product(clusters[c], repeat=len(clusters[c]))) for c in pair]
        for draw in product(*each):
            p = 0.25 / (len(each[0]) * len(each[1]))
            want[statistics.median(x for part in draw for x in part)] += p
            total += p
    assert total == pytest.approx(1)
    df = spark.createDataFrame([("g", c, x) for c, xs in clusters.items() for x in xs], "g string, u string, v double")
    n_boot, rows = 4000, df.select("g", F.col("u").alias("_c"), F.col("v").alias("_x"))
    placed = resample.row_numbers(rows, ["g"], ["_x", "_c"], "_pos").withColumn("_pos", F.col("_pos") - 1)
    rnd = random.Random(5)
    times = [(i, Counter(rnd.choice("ab") for _ in range(2))) for i in range(n_boot)]
    draws = spark.createDataFrame([("g", i, c, k * len(clusters[c])) for i, t in times for c, k in t.items()], "g string, _rep int, _c string, _n long")
    m = {i: sum(k * len(clusters[c]) for c, k in t.items()) for i, t in times}
    wanted = spark.createDataFrame([("g", i, t, (n - 1 + t) // 2) for i, n in m.items() for t in (0, 1)], "g string, _rep int, _t int, _k long")
    got = splitting.order_statistics(placed, draws, wanted, ["g"], 1).groupBy("_rep").agg(F.avg("_x").alias("x")).groupBy("x").count().collect()
    got = {r["x"]: r["count"] for r in got}
    assert sum(got.values()) == n_boot and set(got) <= set(want)
    assert sum((got.get(k, 0) - n_boot * p) ** 2 / (n_boot * p) for k, p in want.items()) < len(want) + 5 * (2 * len(want)) ** 0.5 + 5


def test_interval_agrees_with_drawn_observations(spark):
    rng = np.random.default_rng(8)
    data = {f"u{i}": rng.normal(i, 2, size) for i, size in enumerate((40, 70, 15, 90))}
    df = spark.createDataFrame([("g", u, float(x)) for u, xs in data.items() for x in xs] + [("h", "u0", None), ("g", None, 5.0), ("g", "u9", float("nan"))], "g string, u string, v double")
    row = resample.bootstrap_interval(df, ["g"], "u", "v", n_boot=1500).collect()
    assert [r["g"] for r in row] == ["g"] and row[0]["n_boot"] == 1500
    names, est = list(data), []
    for _ in range(4000):
        est.append(np.median(np.concatenate([rng.choice(data[c], len(data[c])) for c in rng.choice(names, len(names))])))
    low, high = np.percentile(est, [2.5, 97.5])
    assert abs(row[0]["ci_low"] - low) < 0.25 and abs(row[0]["ci_high"] - high) < 0.25
    drawn = resample.bootstrap_interval(df, ["g"], "u", "v", n_boot=200, stat=lambda c: F.percentile(c, 0.5)).first()
    assert abs(drawn["ci_low"] - low) < 0.6 and abs(drawn["ci_high"] - high) < 0.6
    mean = resample.bootstrap_interval(df, ["g"], "u", "v", n_boot=200, stat=F.avg).first()          # a caller's statistic
    means = [np.mean(np.concatenate([rng.choice(data[c], len(data[c])) for c in rng.choice(names, len(names))])) for _ in range(2000)]
    assert abs(mean["ci_low"] - np.percentile(means, 2.5)) < 0.6


def test_observation_p_values(spark):
    rng = np.random.default_rng(2)
    x = {"ctl": rng.normal(0, 1, 41), "same": rng.normal(0.1, 1, 30), "far": rng.normal(3, 1, 25)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in x.items() for v in vs], "g string, v double")
    got = {r["g"]: r for r in resample.observation_test(df, "g", "v", "ctl", n_perm=3000).collect()}
    again = {r["g"]: r for r in resample.observation_test(df.repartition(5), "g", "v", "ctl", n_perm=3000).collect()}
    assert got == again and got["far"]["p_raw"] == pytest.approx(1 / 3001)
    obs = abs(np.median(x["same"]) - np.median(x["ctl"]))
    pool = np.concatenate([x["same"], x["ctl"]])
    ref = []
    for _ in range(4000):
        rng.shuffle(pool)
        ref.append(abs(np.median(pool[:30]) - np.median(pool[30:])) >= obs - 1e-12)
    assert got["same"]["obs_diff"] == pytest.approx(obs) and abs(got["same"]["p_raw"] - np.mean(ref)) < 0.04
