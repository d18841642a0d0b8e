"""The object view is dealt to parts that follow its rows, and inputs of several passes are read once."""

from checks import rollup_q, views
from replistat.operators import matching
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def test_parts_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(views, "PART_ROWS", 100)
    rows = views.table(spark, SMALL, "lineitem").count()
    plan = views.objects(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert f", {rows // 100 + 1}), REPARTITION_BY_NUM" in plan      # AQE merges no parts of a given number


def test_fields_count_objects_once(spark, monkeypatch):
    seen = []
    real = matching.cut_lineage
    monkeypatch.setattr(matching, "cut_lineage", lambda df: seen.append(df) or real(df))
    rows = spark.createDataFrame([("w", 0, 1)] * 3 + [("w", 1, None), ("w", 2, 3), ("x", 0, 0)], "well string, f long, o long")
    got = {r["well"]: r["n_fields"] for r in matching.effective_fields(rows, ["well"], "f", F.col("o")).collect()}
    assert got == {"w": 2, "x": 1} and len(seen) == 1


def test_summaries_read_stored_objects(spark, monkeypatch):
    seen = []
    real = rollup_q.cut_lineage
    monkeypatch.setattr(rollup_q, "cut_lineage", lambda df: seen.append(df.columns) or real(df))
    rollup_q.distribution_feed(spark, SMALL)
    rollup_q.population_summary(spark, SMALL)
    assert [len(c) for c in seen] == [3, 5]
