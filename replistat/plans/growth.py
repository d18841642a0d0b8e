"""From objects of two timepoints to pairs and per-condition statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.geometry import finite, num, object_measures
from ..functions.labels import stars
from ..functions.naming import is_baseline
from ..operators.gates import REJECTED, analysed, image_limits, morphology_gate, object_ids, reason_text
from ..operators.matching import (admissible_edges, assign_pair_ids, drop_duplicates_across_fields, duplicate_edges,
                                  optimal_matching, pair_table, resolve_duplicates)
from ..operators.resample import adjust_pvalues, bootstrap_interval, permutation_test
from ..operators.rollup import backend_mix
from ..operators.scan import group_summary
from ..params import DUPLICATE_DISTANCE_UM, Inference, ObjectGate, PairGate
from ..session import cut_lineage, unless_large


def measure(regions: DataFrame, gate: ObjectGate = ObjectGate(), image_area: str = "image_area_px") -> DataFrame:
    """Objects with all derived measures, flags, reasons and ids from region statistics."""
    out = regions.withColumns(object_measures(
        "area_px", "perimeter_px", "pixel_size_um", "major_axis_px", "minor_axis_px", "solidity", "eccentricity"))
    out = morphology_gate(out, gate, calibrated="is_calibrated" if "is_calibrated" in out.columns else None)
    out = image_limits(out, ["image_id"], "label", num("area_px") / num(image_area), gate)
    return out.withColumn("object_id", object_ids("pair_key", "timepoint", "clean_label", "label")).withColumn(
        "label_idx", F.coalesce("clean_label", "label")).withColumn("qc_reasons", reason_text("qc_codes"))


def remove_duplicates(objects: DataFrame, max_um: float = DUPLICATE_DISTANCE_UM) -> DataFrame:
    edges = duplicate_edges(objects, ["condition", "replicate", "timepoint"], "fov", "object_id", "object_id", max_um=max_um)
    losers = resolve_duplicates(edges, "object_id", "object_id")
    out = drop_duplicates_across_fields(objects, losers)
    return out.withColumn("qc_reasons", reason_text("qc_codes"))


def pair(objects: DataFrame, gate: PairGate = PairGate(), order: str = "label_idx", last: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pairs, and the objects with their pair id. Any day other than 0 is the later timepoint. ``last``: see ``optimal_matching``."""
    t0 = objects.filter(is_baseline("timepoint"))
    t7 = objects.filter(~is_baseline("timepoint"))
    ends = cut_lineage(objects.select("object_id", "pair_key", "timepoint", "centroid_x", "centroid_y", "equivalent_diameter_px", "qc_flag"))
    edges = admissible_edges(ends.filter(is_baseline("timepoint")), ends.filter(~is_baseline("timepoint")), "pair_key", gate, stored=True)
    m = unless_large(cut_lineage(optimal_matching(edges, "a_object_id", "b_object_id", last=last).select(
        F.col("a_object_id").alias("t0_object_id"), F.col("b_object_id").alias("t7_object_id"),
        F.col("distance").alias("centroid_distance_px"))))
    pairs = pair_table(t0, t7, m, order, gate).withColumn("qc_reasons", reason_text("qc_codes"))
    return pairs, assign_pair_ids(objects, pairs)


def pair_population(pairs: DataFrame, params: Inference = Inference(), condition: str = "condition",
                    cluster: str = "replicate") -> DataFrame:
    """Deterministic part of the condition summary: counts, medians, quartile ranges, mean, deviation."""
    ok = analysed(pairs, params.include_review, None)
    v0, v7 = num("t0_volume_sphere_um3"), num("t7_volume_sphere_um3")
    fc, dv = num("fold_change_volume"), num("delta_volume_um3")
    quart = {}
    for name, v in (("v0", v0), ("v7", v7), ("fc", fc)):
        quart |= {f"{name}_q1": (v, 0.25), f"{name}_med": (v, 0.5), f"{name}_q3": (v, 0.75)}
    quart |= {"dv_med": (dv, 0.5), "log2fc_median": (F.when(fc > 0, F.log2(fc)), 0.5)}
    s = group_summary(ok, [condition], quart, [
        F.count(F.lit(1)).alias("n_spheroids"), F.count_distinct(cluster).alias("n_gels"),
        F.avg(fc).alias("fold_change_mean"), F.coalesce(F.stddev_samp(fc), F.when(F.count(fc) > 0, 0.0)).alias("fold_change_std")])
    counts = pairs.groupBy(condition).agg(
        F.count(F.lit(1)).alias("n_matched_pairs"), F.count_if(F.col("combined_qc_flag") == "PASS").alias("n_pass_pairs"),
        F.count_if(~F.col("denominator_gate_pass")).alias("n_denominator_excluded"),
        F.count_if(F.col("combined_qc_flag") == "REVIEW").alias("n_review_pairs"))
    j = counts.join(s, condition, "left")
    iqr = lambda n: F.col(n + "_q3") - F.col(n + "_q1")
    zero = F.lit(0).cast("bigint")
    return j.select(
        condition, "n_matched_pairs", "n_pass_pairs", "n_denominator_excluded", "n_review_pairs",
        F.coalesce("n_gels", zero).alias("n_gels"), F.coalesce("n_spheroids", zero).alias("n_spheroids"),
        F.lit("PASS+REVIEW" if params.include_review else "PASS").alias("analysis_population"),
        F.col("v0_med").alias("v0_median_um3"), iqr("v0").alias("v0_iqr_um3"), F.col("v7_med").alias("v7_median_um3"),
        iqr("v7").alias("v7_iqr_um3"), F.col("dv_med").alias("delta_v_median_um3"), F.col("fc_med").alias("fold_change_median"),
        iqr("fc").alias("fold_change_iqr"), "fold_change_mean", "fold_change_std", "log2fc_median")


def condition_summary(pairs: DataFrame, objects: DataFrame | None = None, params: Inference = Inference(),
                      condition: str = "condition", cluster: str = "replicate") -> DataFrame:
    """Full per-condition summary: population, interval, test against the control, adjusted p, stars."""
    base = pair_population(pairs, params, condition, cluster)
    ok = analysed(pairs, params.include_review, "log2_fold_change")
    boot = bootstrap_interval(ok, [condition], cluster, "log2_fold_change", params.n_boot, params.level, params.seed)
    perm = permutation_test(ok, condition, cluster, "log2_fold_change", params.control, params.n_perm, params.seed,
                            params.exact_limit).select(condition, "p_raw", "min_p")
    j = base.join(boot.select(condition, F.col("ci_low").alias("_lo"), F.col("ci_high").alias("_hi")), condition, "left")
    j = j.join(perm, condition, "left")
    j = adjust_pvalues(j, [], "p_raw", "holm")
    if objects is not None:
        t0 = is_baseline("timepoint")
        imgs = objects.groupBy(condition).agg(
            F.count_distinct(F.when(t0, F.col("image_id"))).alias("_i0"), F.count_distinct(F.when(~t0, F.col("image_id"))).alias("_i7"),
            F.count(F.lit(1)).alias("n_objects_total"))
        j = j.join(imgs, condition, "left").join(backend_mix(objects, [condition], "seg_backend"), condition, "left")
    else:
        j = j.withColumns({"_i0": F.lit(None).cast("bigint"), "_i7": F.lit(None).cast("bigint"),
                           "n_objects_total": F.col("n_matched_pairs") * 2, "backend_counts": F.lit("unrecorded")})
    fov = pairs.groupBy(condition).agg(F.count_distinct("fov").alias("_nf"))
    j = j.join(fov, condition, "left")
    low = F.col("n_gels") < params.low_unit_limit
    any_row = F.col("n_spheroids") > 0
    method = F.when(~any_row, "none").when(
        low, F.concat(F.lit("hierarchical_bootstrap_log2_low_gel_n"), F.col("n_gels").cast("string"))).otherwise("hierarchical_bootstrap_log2")
    used = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, F.col(c)).otherwise(F.col("_nf"))
    j = j.withColumns({
        "n_images_t0": used("_i0"), "n_images_t7": used("_i7"), "ci_method": method,
        "log2fc_ci_95_low": F.col("_lo"), "log2fc_ci_95_high": F.col("_hi"),
        "bootstrap_ci_95_low": F.pow(F.lit(2.0), "_lo"), "bootstrap_ci_95_high": F.pow(F.lit(2.0), "_hi"),
        "p_adj_method": F.lit("holm"), "min_achievable_p": F.col("min_p"), "permutation_p_vs_control": F.col("p_raw"),
        "significance": F.when(F.col(condition) == params.control, "control").otherwise(stars("p_adj")), "low_gel_n": low,
    }).drop("_i0", "_i7", "_nf", "_lo", "_hi", "min_p")
    return j.orderBy(F.col(condition) != params.control, condition)


def region_test(observations: DataFrame, condition: str, unit: str, value: str, control: str,
                params: Inference = Inference()) -> DataFrame:
    """Unit medians, exact or Monte Carlo test against the control, Holm adjustment and stars."""
    t = permutation_test(observations.filter(finite(value).isNotNull()), condition, unit, value, control,
                         params.n_perm, params.seed, params.exact_limit)
    return adjust_pvalues(t, [], "p_raw").withColumn("significance", stars("p_adj"))


def growth(regions: DataFrame, object_gate: ObjectGate = ObjectGate(), gate: PairGate = PairGate(),
           params: Inference = Inference()) -> dict[str, DataFrame]:
    """Regions to objects, pairs and condition summary."""
    objects = remove_duplicates(measure(regions, object_gate))
    pairs, objects = pair(cut_lineage(objects), gate)
    pairs = cut_lineage(pairs)
    return {"objects": objects, "pairs": pairs, "condition_summary": condition_summary(pairs, objects, params),
            "rejected": objects.filter(F.col("qc_flag").isin(*REJECTED))}
