"""Recorded results of small complete analyses, recomputed from their region rows (values retyped)."""

import math

import pytest

from replistat.params import FieldQC
from replistat.plans import density, growth

PX = 1.518817
# Fixed values of the recorded run: id, image, timepoint, condition, area, perimeter, centroid y and x, axis in um, solidity, contrast.
REGIONS = [
    ("Mat_gel1_0001_t0_obj1", "Day0 Mat gel1_0001_TRANS", "t0", "Mat", 6073.0, 287.76450198781714, 256.0, 256.0, 133.557095339407, 0.9882831570382424, 0.7747346606497386),
    ("S34D30_gel1_0001_t0_obj1", "Day0 S34D30 gel1_0001_TRANS", "t0", "S34D30", 6613.0, 299.0782104868019, 256.0, 256.0, 139.36682959857296, 0.9904148569716938, 0.7748871679943532),
    ("Mat_gel1_0001_t7_obj1", "Day7 Mat gel1_0001_TRANS", "t7", "Mat", 9141.0, 353.7056274847714, 255.0, 258.0, 163.85423117423971, 0.9904648390941597, 0.7750036651689454),
    ("S34D30_gel1_0001_t7_obj1", "Day7 S34D30 gel1_0001_TRANS", "t7", "S34D30", 8493.0, 340.048773235279, 256.0, 257.0, 157.94045960262542, 0.9906683774641316, 0.7752810201177746),
]
OBJECTS = {
    "Mat_gel1_0001_t0_obj1": (14009.227247736697, 133.5556143447355, 1247340.6343776556, 1247382.1300196077, 0.9215920222024857),
    "S34D30_gel1_0001_t0_obj1": (15254.901990660757, 139.36694179599561, 1417352.69189069, 1417349.2687720736, 0.9290494699825422),
    "Mat_gel1_0001_t7_obj1": (21086.50523160895, 163.85411902405568, 2303407.15868095, 2303411.888395072, 0.9181626749686331),
    "S34D30_gel1_0001_t7_obj1": (19591.695540100078, 157.9396134922045, 2062869.8808402354, 2062903.0344933649, 0.9229720789342055),
}
PAIRS = {
    "Mat_gel1_0001_pair1": (2.23606797749979, 1056066.5243032943, 1.8466544704768677, 0.8849139473363519, 30.29850467932019, 1.2268605840943032),
    "S34D30_gel1_0001_pair1": (1.0, 645517.1889495454, 1.4554386446244738, 0.5414540225855583, 18.572671696208886, 1.133264542199652),
}


@pytest.fixture(scope="module")
def analysis(spark):
    rows = []
    for _, image, t, cond, area, per, cy, cx, axis, sol, contrast in REGIONS:
        half = math.sqrt(area / math.pi)
        rows.append((image, t, cond, "gel1", "0001", f"{cond}_gel1_0001", 1, PX, area, per, cy, cx, axis / PX, axis / PX, sol, 0.0, contrast,
                     int(cy - half), int(cx - half), int(cy + half) + 1, int(cx + half) + 1, 512, 512, 512.0 * 512.0, True, "classical"))
    df = spark.createDataFrame(rows, """image_id string, timepoint string, condition string, replicate string, fov string, pair_key string, label long, pixel_size_um double, area_px double,
        perimeter_px double, centroid_y double, centroid_x double, major_axis_px double, minor_axis_px double, solidity double, eccentricity double, contrast_ratio double,
        min_row int, min_col int, max_row int, max_col int, image_h int, image_w int, image_area_px double, is_calibrated boolean, seg_backend string""")
    return growth.growth(df)


def test_objects(analysis):
    got = {r["object_id"]: r for r in analysis["objects"].collect()}
    assert set(got) == set(OBJECTS)
    for k, want in OBJECTS.items():
        r = got[k]
        assert (r["area_um2"], r["equivalent_diameter_um"], r["volume_sphere_um3"], r["volume_ellipsoid_um3"], r["circularity"]) == pytest.approx(want, rel=1e-6)
        assert (r["qc_flag"], r["qc_reasons"]) == ("PASS", "None") and r["pair_id"] == k[:-8] + "_pair1"


def test_pairs(analysis):
    got = {r["pair_id"]: r for r in analysis["pairs"].collect()}
    assert set(got) == set(PAIRS)
    for k, want in PAIRS.items():
        r = got[k]
        assert (r["centroid_distance_px"], r["delta_volume_um3"], r["fold_change_volume"], r["log2_fold_change"], r["delta_diameter_um"], r["fold_change_diameter"]) == pytest.approx(want, rel=1e-6)
        assert (r["denominator_gate_pass"], r["combined_qc_flag"], r["qc_reasons"]) == (True, "PASS", "None")


def test_condition_summary(analysis):
    got = {r["condition"]: r for r in analysis["condition_summary"].collect()}
    for cond, v0, v7, dv, fc, lfc, note in (("Mat", 1247340.6343776556, 2303407.15868095, 1056066.5243032943, 1.8466544704768677, 0.8849139473363519, "control"),
                                            ("S34D30", 1417352.69189069, 2062869.8808402354, 645517.1889495454, 1.4554386446244738, 0.5414540225855583, "untested")):
        r = got[cond]
        assert [r[c] for c in ("n_images_t0", "n_images_t7", "n_objects_total", "n_matched_pairs", "n_pass_pairs", "n_denominator_excluded", "n_review_pairs", "n_gels", "n_spheroids")] == [1, 1, 2, 1, 1, 0, 0, 1, 1]
        assert [r[c] for c in ("v0_median_um3", "v7_median_um3", "delta_v_median_um3", "fold_change_median", "fold_change_mean", "log2fc_median", "log2fc_ci_95_low", "log2fc_ci_95_high", "bootstrap_ci_95_low")] == \
            pytest.approx([v0, v7, dv, fc, fc, lfc, lfc, lfc, fc], rel=1e-6)
        assert [r[c] for c in ("v0_iqr_um3", "v7_iqr_um3", "fold_change_iqr", "fold_change_std")] == [0.0] * 4
        assert (r["ci_method"], r["p_raw"], r["p_adj"], r["p_adj_method"], r["significance"], r["backend_counts"], r["low_gel_n"], r["analysis_population"]) == \
            ("hierarchical_bootstrap_log2_low_gel_n1", None, None, "holm", note, "classical:2", True, "PASS")


def test_two_channel_fields(spark):
    px = 0.5050492474122553
    centres = {"Mat": [(40, 40), (40, 60), (60, 50)], "S34D30": [(45, 45), (60, 60)]}
    rows = [(f"SKOV3 Spheroid D7 Mor_{m}-Gel1-1", m, i, 109.0, float(y), float(x), y - 6, x - 6, y + 7, x + 7, 100, 100) for m, c in centres.items() for i, (y, x) in enumerate(c, 1)]
    regions = spark.createDataFrame(rows, "image_id string, material string, label long, area_px double, centroid_y double, centroid_x double, min_row int, min_col int, max_row int, max_col int, image_h int, image_w int")
    fields = spark.createDataFrame([(f"SKOV3 Spheroid D7 Mor_{m}-Gel1-1", m, "Gel1", 25.25, 25.25, 17.67, a, 10.0, 1.0, 0.0) for m, a in (("Mat", 980.8), ("S34D30", 716.5))],
                                   "image_id string, material string, replicate string, field_cy_um double, field_cx_um double, max_radius_um double, density_area_um2 double, laplacian_var double, snr double, saturation_frac double")
    out = density.density(regions.drop("material"), fields, px, count_qc=FieldQC(min_volume_um3=50.0))
    nuclei = out["nuclei"].collect()
    assert {r["flags"] for r in nuclei} == {"debris"} and not any(r["edge_touching"] or r["excluded_border"] for r in nuclei)
    assert [r["volume_um3"] for r in nuclei] == pytest.approx([110.28] * 5, rel=5e-3)
    per = {r["material"]: r for r in out["per_image"].collect()}
    for m, n, d in (("Mat", 3, 3058.85), ("S34D30", 2, 2791.33)):
        r = per[m]
        assert (r["n_nuclei"], r["n_nuclei_total"], r["n_border_excluded"], r["flag_summary"], r["debris_count"], r["merged_count"]) == (n, n, 0, "low_snr", 0, 0)
        assert (r["nuclei_per_mm2"], r["median_nuclear_volume_um3"]) == pytest.approx((d, 110.28), rel=5e-3)
    for r in out["summary"].collect():
        n, d = {"Mat": (3, 3058.85), "S34D30": (2, 2791.33)}[r["material"]]
        assert (r["n_images_total"], r["n_images_clean"], r["n_gels"], r["flagged_image_rate"], r["p_raw"], r["p_adj"], r["min_achievable_p"]) == (1, 0, 1, 1.0, None, None, None)
        assert (r["mean_nuclei_per_mm2_all"], r["gel_mean_nuclei_per_mm2"], r["median_nuclear_volume_um3"]) == pytest.approx((d, d, 110.28), rel=5e-3)
        assert (r["mean_nuclei_per_mm2_clean"], r["sd_nuclei_per_mm2_all"]) == (None, None)
        assert (r["significance"], r["statistical_note"]) == (("control", "control") if r["material"] == "Mat" else ("untested", "insufficient replicates for statistical test (n_gels=1)"))
