"""Fixed column orders of the result tables (fixed values; writers pad missing columns with NULL)."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I, B = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()


def _schema(text: str) -> T.StructType:
    kinds = {"s": S, "d": D, "i": I, "b": B}
    fields = []
    for part in text.split():
        name, kind = part.rsplit(":", 1)
        fields.append(T.StructField(name, kinds[kind], True))
    return T.StructType(fields)


OBJECTS = _schema(
    "object_id:s image_id:s timepoint:s condition:s replicate:s fov:s pair_key:s label_idx:i pixel_size_um:d area_px:d "
    "perimeter_px:d equivalent_diameter_px:d centroid_y:d centroid_x:d area_um2:d equivalent_diameter_um:d major_axis_um:d "
    "minor_axis_um:d aspect_ratio:d volume_sphere_um3:d volume_ellipsoid_um3:d volume_discrepancy_ratio:d circularity:d "
    "solidity:d eccentricity:d mean_interior_intensity:d mean_background_ring_intensity:d contrast_ratio:d qc_flag:s "
    "qc_reasons:s pair_id:s mask_source:s seg_backend:s model_id:s diameter_used:d scale_source:s is_calibrated:b")

PAIRS = _schema(
    "pair_id:s pair_key:s condition:s replicate:s fov:s t0_object_id:s t0_centroid_x:d t0_centroid_y:d t0_eq_diameter_um:d "
    "t0_volume_sphere_um3:d t0_volume_ellipsoid_um3:d t0_circularity:d t0_qc_flag:s t7_object_id:s t7_centroid_x:d "
    "t7_centroid_y:d t7_eq_diameter_um:d t7_volume_sphere_um3:d t7_volume_ellipsoid_um3:d t7_circularity:d t7_qc_flag:s "
    "centroid_distance_px:d delta_volume_um3:d fold_change_volume:d log2_fold_change:d delta_diameter_um:d "
    "fold_change_diameter:d denominator_gate_pass:b combined_qc_flag:s qc_reasons:s")

CONDITION_SUMMARY = _schema(
    "condition:s n_images_t0:i n_images_t7:i n_objects_total:i n_matched_pairs:i n_pass_pairs:i n_denominator_excluded:i "
    "n_review_pairs:i n_gels:i n_spheroids:i analysis_population:s v0_median_um3:d v0_iqr_um3:d v7_median_um3:d v7_iqr_um3:d "
    "delta_v_median_um3:d fold_change_median:d fold_change_iqr:d fold_change_mean:d fold_change_std:d log2fc_median:d "
    "ci_method:s log2fc_ci_95_low:d log2fc_ci_95_high:d bootstrap_ci_95_low:d bootstrap_ci_95_high:d p_raw:d p_adj:d "
    "p_adj_method:s min_achievable_p:d permutation_p_vs_control:d significance:s backend_counts:s low_gel_n:b")

IMAGE_STATUS = _schema(
    "image_id:s pair_key:s timepoint:s condition:s replicate:s fov:s file_path:s status:s reason:s n_objects:i n_pass:i "
    "seg_backend:s mask_source:s cached:b pixel_size_um:d scale_source:s is_calibrated:b")

VALIDATION = _schema(
    "image_id:s pair_key:s timepoint:s manual_mask_path:s n_auto_objects:i n_manual_objects:i dice_coefficient:d "
    "iou_jaccard:d pixel_size_um:d notes:s")

SESSION_QUALITY = _schema(
    "filename:s timepoint:s condition:s laplacian_var:d brenner_gradient:d mean_intensity:d std_intensity:d")

MANIFEST = _schema(
    "image_id:s timepoint:s condition:s replicate:s fov:s pair_key:s file_path:s file_size_bytes:i sha256:s dimensions:s "
    "bit_depth:s pixel_size_um:d scale_source:s is_calibrated:b is_matched_pair:b")

FIELD_OBJECTS = _schema(
    "image_id:s material:s replicate:s object_id:s volume_um3:d equivalent_diameter_um:d sphericity:d solidity:d "
    "centroid_z_um:d centroid_y_um:d centroid_x_um:d mean_actin_intensity:d integrated_actin_intensity:d "
    "normalized_radial_distance:d edge_touching:b excluded_border:b flags:s")

FIELDS = _schema(
    "image_id:s material:s replicate:s n_nuclei:i n_nuclei_total:i n_border_excluded:i spheroid_area_um2:d "
    "spheroid_volume_um3:d nuclei_per_mm2:d median_nuclear_volume_um3:d median_actin_intensity:d flag_summary:s "
    "density_area_um2:d spheroid_extent_method:s spheroid_extent_hull_fallback:b scale_source:s")

FIELD_QC = _schema(
    "image_id:s material:s replicate:s n_nuclei_raw:i n_nuclei_dedup:i n_duplicates_removed:i nuclear_snr:d "
    "nuclear_laplacian_var:d nuclear_saturation_frac:d actin_saturation_frac:d edge_touching_frac:d debris_count:i "
    "merged_count:i flag_empty_seg:b flag_count_outlier:b flag_dup_masks:b flag_debris_or_merged:b flag_edge_heavy:b "
    "flag_saturated:b flag_blurry:b flag_low_snr:b flag_any:b flags_list:s flag_density_outlier:b nuclei_per_mm2:d "
    "n_nuclei_valid:i n_border_excluded:i debris_count_pre:i merged_count_pre:i")

MATERIAL_SUMMARY = _schema(
    "material:s n_images_total:i n_images_clean:i n_gels:i flagged_image_rate:d mean_nuclei_per_mm2_all:d "
    "sd_nuclei_per_mm2_all:d mean_nuclei_per_mm2_clean:d sd_nuclei_per_mm2_clean:d gel_mean_nuclei_per_mm2:d "
    "gel_sd_nuclei_per_mm2:d median_nuclear_volume_um3:d mean_spheroid_area_um2:d statistical_note:s p_raw:d p_adj:d "
    "p_adj_method:s min_achievable_p:d significance:s")

DECISIONS = _schema(
    "timestamp:s image_id:s step:s from_backend:s to_backend:s reason:s outcome:s details:s")
