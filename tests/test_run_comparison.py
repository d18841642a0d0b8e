"""Whole comparisons of runs against the same numbers worked out with pandas, and every result table written and read back."""

import itertools
import random
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import types as T

from replistat import schema
from replistat.plans import compare
from replistat.sources import tables

RUNS = ["001_base", "401_PP00_none", "402_PP10_bg", "403_PP01_post", "404_PP11_full", "501_copy", "600_part_subset"]
TABLES = {n: s for n, s in vars(schema).items() if isinstance(s, T.StructType)}


@pytest.fixture(scope="module")
def fields():
    rng, rows = random.Random(3), []
    for i, run in enumerate(RUNS[:5]):
        for k in range(12):
            if rng.random() < 0.1:
                continue
            n = rng.randrange(20, 200)
            rows.append({"run": run, "image_id": f"im{k:02d}", "material": f"M{k % 3}", "replicate": f"g{k % 4}", "n_nuclei": n, "n_nuclei_raw": n + rng.randrange(5),
                         "nuclei_per_mm2": n * 1.25, "median_nuclear_volume_um3": 300.0 + n, "flag_any": rng.random() < 0.3})
    rows += [{**r, "run": "501_copy"} for r in rows if r["run"] == "001_base"] + [{**rows[0], "run": "600_part_subset"}]
    f = pd.DataFrame(rows)
    f["flag_summary"] = np.where(f.flag_any, "blurry", "clean")
    f["flags_list"] = np.where(f.flag_any, "blurry", "")
    return f


def test_compare(spark, fields):
    summary = pd.DataFrame([{"run": r, "material": m, "mean_nuclei_per_mm2_all": 1.0 + i, "mean_nuclei_per_mm2_clean": 2.0 + i, "median_nuclear_volume_um3": 3.0, "flagged_image_rate": 0.5}
                            for i, (r, m) in enumerate(itertools.product(RUNS, ("M0", "M1")))])
    out = {k: v.toPandas() for k, v in compare.compare(spark.createDataFrame(fields), RUNS[:6], spark.createDataFrame(summary)).items()}
    full = fields[fields.run != "600_part_subset"]
    wide = full.pivot(index="image_id", columns="run", values="n_nuclei")
    spread = (wide.max(axis=1) - wide.min(axis=1)).astype(int)
    got = out["deltas"].set_index("image_id")
    assert got.count_spread.astype(int).to_dict() == spread.to_dict()
    order = sorted(spread.index, key=lambda i: (-spread[i], i))
    assert got["rank"].astype(int).to_dict() == {i: k + 1 for k, i in enumerate(order)}
    assert out["top"].image_id.tolist() == order[:10]
    assert got.missing_in_runs.to_dict() == {i: ";".join(r for r in RUNS[:6] if pd.isna(wide.loc[i, r])) for i in wide.index}
    totals = out["totals"].set_index("run")
    means = full.groupby("run").n_nuclei.mean()
    assert np.allclose(totals.mean_count.reindex(means.index), means) and "600_part_subset" not in totals.index
    assert set(totals.index[totals.is_highest]) == {max(means.index, key=lambda r: (means[r], r))}
    same = {(r.run_a, r.run_b) for r in out["identical"].itertuples() if r.identical}
    assert same == {("001_base", "501_copy")}
    by_material = spread.groupby(full.drop_duplicates("image_id").set_index("image_id").material).agg(["size", "mean", "max"])
    got = out["spread"].set_index("material").loc[by_material.index]
    assert got.n_images.tolist() == by_material["size"].tolist() and np.allclose(got.mean_spread, by_material["mean"]) and got.max_spread.tolist() == by_material["max"].tolist()
    metrics = out["metrics"].set_index("material")
    first = summary.set_index(["run", "material"])
    assert all(metrics.loc[m, f"{r}_density_clean"] == first.loc[(r, m), "mean_nuclei_per_mm2_clean"] for r in RUNS[:6] for m in ("M0", "M1"))


def test_compare_families(spark, fields):
    keys = ["run", "image_id", "material", "replicate"]
    qc = spark.createDataFrame(fields[[*keys, "n_nuclei_raw", "flag_any", "flags_list"]])
    features = spark.createDataFrame(fields[[*keys, "n_nuclei", "nuclei_per_mm2", "median_nuclear_volume_um3"]])
    original, processed = ["001_base", "401_PP00_none"], ["402_PP10_bg", "404_PP11_full"]
    out = {k: v.toPandas() for k, v in compare.compare_families(qc, features, original, processed).items()}
    armed = fields[fields.run.str.contains("PP")]
    assert len(out["rows"]) == len(armed) and set(out["rows"].arm) == {"PP00", "PP01", "PP10", "PP11"}
    g = armed.groupby(["run", "material"])
    got = out["summary"].set_index(["run", "material"]).loc[list(g.groups)]
    assert np.allclose(got.mean_final, g.n_nuclei.mean()) and np.allclose(got.sd_density, g.nuclei_per_mm2.std()) and got.n_images.tolist() == g.size().tolist()
    assert got.flags_list.tolist() == [";".join(sorted(set(x) - {""})) for x in g.flags_list.agg(list)]
    mean = armed.assign(arm=armed.run.str.extract("(PP..)")[0].values).groupby("arm").n_nuclei.mean()
    effects = out["effects"].set_index("effect").value
    assert effects["interaction_count"] == pytest.approx((mean["PP11"] - mean["PP01"]) - (mean["PP10"] - mean["PP00"]))
    assert effects["effect_pre_count"] == pytest.approx(mean["PP10"] - mean["PP00"])
    wide = fields[fields.run.isin(original + processed)].pivot(index="image_id", columns="run", values="n_nuclei").dropna()
    a = wide[original].std(axis=1) / wide[original].mean(axis=1)
    b = wide[processed].std(axis=1) / wide[processed].mean(axis=1)
    whole = out["robustness"].set_index("material").loc["ALL_COHORT"]
    assert whole.n_images == len(wide) and whole.orig_mean_count_spread == pytest.approx(a.mean(), abs=6e-4) and whole.pp_max_count_spread == pytest.approx(b.max(), abs=6e-4)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_every_result_table_is_read_back(spark, fmt):
    assert len(TABLES) == 12
    values = {T.StringType(): "a, \"b\"", T.DoubleType(): 0.1 + 0.2, T.LongType(): 2**40 + 1, T.BooleanType(): True}
    for name, kind in TABLES.items():
        path = tempfile.mkdtemp(prefix="spark-") + "/" + name
        whole = [values[f.dataType] for f in kind.fields]
        rows = spark.createDataFrame([whole, [None] * len(whole)], kind)
        shuffled = rows.select(*reversed(kind.names), rows[kind.names[0]].alias("not_in_the_schema"))
        tables.write_table(shuffled, path, kind, fmt)
        reader = spark.read.schema(kind).option("header", True).option("escape", "\\") if fmt == "csv" else spark.read
        back = reader.format(fmt).load(path)
        assert back.columns == kind.names and [f.dataType for f in back.schema.fields] == [f.dataType for f in kind.fields]
        assert sorted(map(tuple, back.collect()), key=str) == sorted([tuple(whole), (None,) * len(whole)], key=str), name
