"""From labelled fields to per-field densities, cohort flags and the material summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.geometry import disk_diameter, num, sphere_volume
from ..functions.labels import stars
from ..operators.gates import OWN_FLAGS, border_touch, cohort_flags, field_flags, nucleus_flags
from ..operators.matching import radial_distance
from ..operators.resample import adjust_pvalues, permutation_test
from ..operators.runs import field_counts, image_rollup, material_summary
from ..params import FieldQC, Inference


def describe_nuclei(regions: DataFrame, fields: DataFrame, px_um: float, clearance: int = 0, qc: FieldQC = FieldQC()) -> DataFrame:
    """Nuclei rows: size, position, radial distance, border and size flags."""
    box, shape = ("min_row", "min_col", "max_row", "max_col"), ("image_h", "image_w")
    area = num("area_px") * px_um * px_um
    d = disk_diameter(area)
    edge = border_touch(box, shape, qc.border_margin_px)
    out = border_touch(box, shape, clearance) if clearance > 0 else F.lit(False)
    r = regions.withColumns({
        "equivalent_diameter_um": d, "volume_um3": sphere_volume(d), "centroid_y_um": num("centroid_y") * px_um,
        "centroid_x_um": num("centroid_x") * px_um, "edge_touching": edge, "excluded_border": out})
    r = r.withColumn("flags", nucleus_flags(F.col("edge_touching"), F.col("excluded_border"), F.col("volume_um3"), qc))
    return radial_distance(r, fields, "image_id", "centroid_x_um", "centroid_y_um", "field_cx_um", "field_cy_um", "max_radius_um")


def summarise_materials(per_image: DataFrame, control: str = "Mat", params: Inference = Inference(),
                        volume: str | None = None, area: str | None = None) -> DataFrame:
    """Descriptive summary plus the gel-level test against the control, Holm over tested materials."""
    base = material_summary(per_image, volume=volume, area=area)
    t = permutation_test(per_image, "material", "replicate", "nuclei_per_mm2", control, params.n_perm, params.seed,
                         params.exact_limit).select("material", "p_raw", F.col("min_p").alias("min_achievable_p"))
    j = base.join(t, "material", "left")
    few = F.col("n_gels") < 2
    note = F.when(F.col("material") == control, "control").when(
        few, F.concat(F.lit("insufficient replicates for statistical test (n_gels="), F.col("n_gels").cast("string"), F.lit(")"))).otherwise("")
    j = adjust_pvalues(j, [], "p_raw", "holm")
    return j.withColumns({
        "statistical_note": note, "p_adj_method": F.lit("holm"),
        "significance": F.when(F.col("material") == control, "control").otherwise(stars("p_adj", levels=3))})


def density(regions: DataFrame, fields: DataFrame, px_um: float, clearance: int = 0, control: str = "Mat",
            blur_threshold: float = 0.0, qc: FieldQC = FieldQC(), params: Inference = Inference(),
            count_qc: FieldQC | None = None) -> dict[str, DataFrame]:
    """Labelled regions and field rows to nuclei, per-field rows with flags, and the material summary.

    ``fields`` carries image_id, material, replicate, field centre, radius, density area, the focus
    measure ``laplacian_var``, the exposure measures ``snr`` and ``saturation_frac`` and, where
    duplicates were removed, ``n_duplicates_removed``. ``qc`` flags single nuclei; the counts per field
    follow ``count_qc`` where it is given.
    """
    per_field = count_qc or qc
    nuclei = describe_nuclei(regions, fields, px_um, clearance, qc)
    per = image_rollup(nuclei, fields)
    counts = field_counts(nuclei, ["image_id"], F.col("volume_um3"), F.col("edge_touching"), per_field.min_volume_um3, per_field.max_volume_um3)
    per = per.join(counts, "image_id", "left")
    per = field_flags(per, per_field, duplicates="n_duplicates_removed" if "n_duplicates_removed" in per.columns else None)
    per = cohort_flags(per, own_flags=OWN_FLAGS, blur_threshold=blur_threshold, qc=per_field)
    per = per.withColumn("flag_summary", F.when(F.col("flags_list") == "", "clean").otherwise(F.col("flags_list")))
    return {"nuclei": nuclei, "per_image": per,
            "summary": summarise_materials(per, control, params, volume="median_nuclear_volume_um3")}
