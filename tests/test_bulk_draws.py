"""The mean's bootstrap keeps sums instead of drawn values, with the same keyed draws; its query draws all replicates."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import catalogue, resample_q
from replistat.operators import draws, resample


@pytest.mark.parametrize("prefix", ["", "42|AFRICA|0|0|", "x" * 51 + "|", "y" * 62 + "|", "z" * 130 + "|"])
def test_positions_are_the_keyed_draws(prefix):
    for n in (1, 10, 11, 1234):
        want = [int(hashlib.md5(f"{prefix}{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)]
        assert np.concatenate(list(draws.positions(prefix, n))).tolist() == want


def test_sums_agree_with_a_row_per_draw(spark):
    rows = [(g, f"u{i % k}", float(i * 37 % 101)) for g, k in (("a", 3), ("b", 1), ("ü|", 5)) for i in range(40)] + [("a", "u0", None), ("b", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, u string, v double").repartition(3)
    one = resample.bootstrap_interval(df, ["g"], "u", "v", n_boot=30, stat=F.avg).orderBy("g").collect()
    two = resample.bootstrap_interval(df, ["g"], "u", "v", n_boot=30, stat=lambda c: F.sum(c) / F.count(c)).orderBy("g").collect()
    assert [(r["g"], r["n_boot"]) for r in one] == [("a", 30), ("b", 30), ("ü|", 30)]
    for a, b in zip(one, two, strict=True):
        assert tuple(a)[1:] == pytest.approx(tuple(b)[1:], rel=1e-12)


def test_the_query_draws_all_replicates(spark, monkeypatch):
    rows = spark.range(200).selectExpr("'A' AS cond", "concat('u', id % 3) AS unit", "cast(id AS double) AS value")
    monkeypatch.setattr(resample_q.v, "unit_values", lambda spark, d: rows)
    assert catalogue.QUERIES["bootstrap_mean_u1"](spark, "").first()["n_boot"] == 2000
    assert "range(2000) t(rep)" in catalogue.ORACLE["bootstrap_mean_u1"]
