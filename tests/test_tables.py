import tempfile

from pyspark.sql import functions as F

from replistat.schema import OBJECTS, PAIRS
from replistat.sources import tables
from replistat.streaming.incremental import process_new, work_key


def test_fixed_order_writers(spark):
    out = tempfile.mkdtemp(prefix="spark-") + "/objects"
    df = spark.createDataFrame([("a", 3.5, "extra")], "object_id string, area_px double, other string")
    tables.write_table(df, out, OBJECTS)
    back = spark.read.parquet(out)
    assert back.columns == [f.name for f in OBJECTS.fields] and len(back.columns) == 37 and len(PAIRS.fields) == 30
    row = back.first()
    assert row["object_id"] == "a" and row["area_px"] == 3.5 and row["qc_flag"] is None


def test_decision_log_appends(spark):
    out = tempfile.mkdtemp(prefix="spark-") + "/log"
    df = spark.createDataFrame([("i1", 2), ("i2", 0)], "image_id string, n int")
    rows = tables.decisions(df, "segment", F.lit("a"), F.lit("b"), F.lit("0 objects"), "fallback", F.struct("n"))
    tables.append_decisions(rows, out)
    tables.append_decisions(rows, out)
    back = tables.read_decisions(spark, out)
    assert back.count() == 4
    assert back.select(F.try_variant_get("details", "$.n", "int").alias("n")).agg(F.sum("n")).first()[0] == 4


def test_only_new_work_is_done(spark):
    store = tempfile.mkdtemp(prefix="spark-") + "/done"
    df = spark.createDataFrame([("x",), ("y",)], "text string")
    keyed = lambda d, p: d.withColumn("work_key", work_key(F.sha2("text", 256), p))
    process_new(keyed(df, {"b": 1.0, "a": 2}), store, lambda d: d)
    process_new(keyed(df, {"a": 2, "b": 1.0}), store, lambda d: d)
    assert spark.read.parquet(store).count() == 2
    process_new(keyed(df.limit(1), {"a": 3}), store, lambda d: d)
    assert spark.read.parquet(store).count() == 3


def test_image_listing_of_a_real_folder(spark):
    import os

    from replistat.sources.files import image_manifest, list_images

    folder = tempfile.mkdtemp(prefix="spark-")
    for name in ("Day0 Mat gel1_1_TRANS.tif", "Day7 Mat gel1_1_TRANS.TIFF", "Day0 Mat gel2_3_TRANS.Tif", "notes.txt", "x.tifx"):
        with open(os.path.join(folder, name), "wb") as f:
            f.write(b"II*\0" + name.encode())
    found = list_images(spark, folder)
    assert found.columns == ["path", "length"] and found.count() == 3
    assert {bytes(r["content"])[:4] for r in list_images(spark, folder, content=True).collect()} == {b"II*\0"}
    got = {(r["pair_key"], r["timepoint"]): r["is_matched_pair"] for r in image_manifest(found).collect()}
    assert got == {("Mat_gel1_0001", "t0"): True, ("Mat_gel1_0001", "t7"): True, ("Mat_gel2_0003", "t0"): False}


def test_runs_are_read_from_folders_and_pruned(spark, capsys):
    root = tempfile.mkdtemp(prefix="spark-") + "/runs"
    rows = [("a", 1, 5), ("a", 2, 6), ("b", 1, 7), ("b_subset", 1, 8)]
    df = spark.createDataFrame(rows, "run string, image_id long, n long")
    df.write.partitionBy("run").parquet(root)
    assert {tuple(r) for r in tables.read_runs(spark, root).select("run", "image_id", "n").collect()} == set(rows[:3])
    one = tables.read_runs(spark, root, names=["b"])
    assert [r["n"] for r in one.collect()] == [7]
    capsys.readouterr()
    one.explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [" in plan and "run" in plan.split("PartitionFilters: [")[1].split("]")[0]
    csv = tempfile.mkdtemp(prefix="spark-") + "/csv"
    for run in ("a", "b_subset"):
        df.filter(F.col("run") == run).drop("run").write.option("header", True).csv(f"{csv}/{run}")
    got = tables.read_run_folders(spark, f"{csv}/*", r"/csv/([^/]+)/", df.drop("run").schema, scope="any")
    assert {(r["run"], r["image_id"], r["n"]) for r in got.collect()} == {rows[0], rows[1], rows[3]}


def test_objective_and_timepoint_order(spark):
    from replistat.functions import calibration, labels

    docs = [('x{"MicronsPerPixel": 1, "ObjectiveSettings": {"Magnification": "10", "NumericalAperture": 0.3}, "Software": "M5"}', None), (None, '<!-- {"PixelSize": 2, "Magnification": 4, "Objective NA": "0.1"} -->'),
            ('{"ObjectiveSettings": "{\\"Magnification\\": 20}"}', None), ("none", None)]
    df = spark.createDataFrame(docs, "a string, b string")
    got = [r["o"] and tuple(r["o"]) for r in df.select(calibration.objective("a", "b").alias("o")).collect()]
    assert got == [(10.0, 0.3, "M5"), (4.0, 0.1, "EVOS"), (20.0, None, "EVOS"), None]
    days = spark.createDataFrame([(x,) for x in ("t10", "odd", "t7", "Day0", None)], "t string")
    assert [r["t"] for r in days.orderBy(labels.timepoint_order("t")).collect()] == ["Day0", "t7", "t10", None, "odd"]
