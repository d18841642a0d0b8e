"""The SQL of the resampling queries walks the whole tree of positions, also of groups above 65,536 rows."""

import duckdb
import pytest

from checks import catalogue, views
from replistat.operators import resample as rs

N = 70_000


@pytest.mark.parametrize("query, cluster", [("cluster_bootstrap_r1", "unit"), ("median_bootstrap_r2", None)])
def test_bootstrap_sql_of_a_large_group(spark, query, cluster):
    sql = catalogue.ORACLE[query].replace(views.SQL["v_unit_value"], f"SELECT 'A' AS cond, 'u' || (i % 3) AS unit, (i * 7919 % {N})::DOUBLE AS value FROM range({N}) t(i)").replace("range(2000)", "range(20)")
    want = duckdb.sql(sql).fetchall()
    df = spark.range(N).selectExpr("'A' AS cond", "concat('u', id % 3) AS unit", f"cast(id * 7919 % {N} AS double) AS value")
    got = rs.bootstrap_interval(df, ["cond"], cluster, "value", n_boot=20).first()
    assert [("A", round(got["ci_low"], 6), round(got["ci_high"], 6), 20)] == want
    assert 25_000 < got["ci_low"] < got["ci_high"] < 45_000


def test_relabelling_sql_of_a_large_group(spark):
    head = catalogue.ORACLE["observation_permutation_r5"]
    source = head[head.index("SELECT r_name"):head.index("),")]
    rows = f"SELECT CASE WHEN i % 2 = 0 THEN 'AFRICA' ELSE 'ASIA' END AS cond, (i * 7919 % {2 * N} + CASE WHEN i % 2 = 0 THEN 0 ELSE 300 END)::DOUBLE AS x FROM range({2 * N}) t(i)"
    want = duckdb.sql(head.replace(source, rows).replace("range(10000)", "range(99)").replace("10001.0", "100.0")).fetchall()
    df = spark.range(2 * N).selectExpr("if(id % 2 = 0, 'AFRICA', 'ASIA') AS cond", f"cast(id * 7919 % {2 * N} + if(id % 2 = 0, 0, 300) AS double) AS value")
    got = rs.observation_test(df, "cond", "value", "AFRICA", n_perm=99).first()
    assert [("ASIA", round(got["obs_diff"], 4), round(got["p_raw"], 6))] == [(c, float(o), float(p)) for c, o, p in want]
    assert got["p_raw"] < 1
