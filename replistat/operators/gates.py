"""Quality gates: a flag plus an ordered list of reasons, nothing is dropped silently."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import finite, num, sphere_volume, disk_diameter
from ..params import FieldQC, ObjectGate, PairGate, SizeGate
from ..session import cut_lineage
from .scan import group_summary, row_numbers, running

REJECTED = ("FAIL", "SEG_FAIL")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reasons(*rules: tuple[Column, str | Column]) -> Column:
    """Array of the texts whose condition holds, in the order given."""
    return F.array_compact(F.array(*[
        F.when(cond, F.lit(text) if isinstance(text, str) else text) for cond, text in rules]))


def reason_text(codes, empty: str = "None", sep: str = "; ") -> Column:
    codes = _col(codes)
    return F.when(F.size(codes) == 0, F.lit(empty)).otherwise(F.concat_ws(sep, codes))


def fixed(value: Column, digits: int) -> Column:
    """Number as text with ``digits`` decimals, ties to even."""
    return F.bround(value, digits).cast(f"decimal(30,{digits})").cast("string")


def morphology_gate(
    df: DataFrame,
    gate: ObjectGate = ObjectGate(),
    diameter: str = "equivalent_diameter_um",
    contrast: str = "contrast_ratio",
    circularity: str | None = "circularity",
    solidity: str | None = "solidity",
    eccentricity: str | None = "eccentricity",
    box: Sequence[str] | None = ("min_row", "min_col", "max_row", "max_col"),
    image_shape: Sequence[str] | None = ("image_h", "image_w"),
    calibrated: str | None = None,
    segment_flag: str | None = None,
    flag: str = "qc_flag",
    codes: str = "qc_codes",
) -> DataFrame:
    """Add the object flag and its reason codes.

    Size, border and contrast reject an object; shape and the narrower diameter range only ask for
    a review. Uncalibrated scale demotes PASS to REVIEW; a failed segmentation overrides the flag.
    """
    d = num(diameter)
    fail = [(d < gate.min_d_um, "debris_undersized"), (d > gate.max_d_um, "oversized_artifact")]
    if box and image_shape:
        m = max(0, gate.border_margin_px)
        r0, c0, r1, c1 = (F.col(c) for c in box)
        h, w = (F.col(c) for c in image_shape)
        fail.append(((r0 < m) | (c0 < m) | (r1 > h - m) | (c1 > w - m), "touches_image_border"))
    fail.append((num(contrast) < gate.min_contrast - 1e-7, "insufficient_dark_contrast"))
    review = []
    if circularity:
        review.append((num(circularity) < gate.min_circularity, "low_circularity"))
    if solidity:
        review.append((num(solidity) < gate.min_solidity, "low_solidity"))
    if eccentricity:
        review.append((num(eccentricity) > gate.max_eccentricity, "high_eccentricity"))
    review.append(((d < gate.min_pass_d_um) | (d > gate.max_pass_d_um), "outside_pass_diameter"))

    out = df.withColumn("_fail", reasons(*fail)).withColumn("_review", reasons(*review))
    failed = F.size("_fail") > 0
    verdict = F.when(failed, F.lit("FAIL")).when(F.size("_review") > 0, F.lit("REVIEW")).otherwise(F.lit("PASS"))
    listed = F.when(failed, F.col("_fail")).otherwise(F.col("_review"))
    if calibrated:
        loose = ~F.coalesce(F.col(calibrated), F.lit(False))
        verdict = F.when(loose & ~failed, F.lit("REVIEW")).otherwise(verdict)
        listed = F.when(loose, F.concat(listed, F.array(F.lit("uncalibrated_optical_scale")))).otherwise(listed)
    if segment_flag:
        seg = F.col(segment_flag).isin(*REJECTED)
        verdict = F.when(seg, F.col(segment_flag)).otherwise(verdict)
        listed = F.when(seg, F.concat(listed, F.array(F.lit("segmentation_failure_implausible_mask")))).otherwise(listed)
    return out.withColumn(flag, verdict).withColumn(codes, listed).drop("_fail", "_review")


def image_limits(
    df: DataFrame,
    image: Sequence[str],
    label: str,
    area_share: Column,
    gate: ObjectGate = ObjectGate(),
    flag: str = "qc_flag",
    codes: str = "qc_codes",
) -> DataFrame:
    """Reject oversized objects, demote objects beyond the per-image limit, renumber the clean ones.

    Adds ``clean_label`` (1, 2, ... over clean objects in label order; NULL for rejected ones).
    """
    big = area_share > gate.max_area_share
    out = df.withColumn(flag, F.when(big, F.lit("FAIL")).otherwise(F.col(flag))).withColumn(
        codes, F.when(big, F.concat(F.array(F.lit("exceeds_max_area_limit")), F.col(codes))).otherwise(F.col(codes)))
    clean = ~F.col(flag).isin(*REJECTED)
    out = running(out, image, [label], {"_k": ("sum", F.when(clean, 1).otherwise(0).cast("bigint"))})
    out = out.withColumn("clean_label", F.when(clean, F.col("_k"))).drop("_k")
    limit = gate.max_objects_per_image
    if limit > 0:
        over = F.col("clean_label") > limit
        out = out.withColumn(
            codes, F.when(over, F.concat(F.col(codes), F.array(F.lit("exceeds_max_objects_per_fov"))))
            .otherwise(F.col(codes)))
        out = out.withColumn(flag, F.when(over & (F.col(flag) == "PASS"), F.lit("REVIEW")).otherwise(F.col(flag)))
    return out


def object_ids(pair_key, timepoint, clean_label, raw_label) -> Column:
    """``..._obj<k>`` for clean objects, ``..._fail<label>`` for rejected ones."""
    stem = F.concat_ws("_", _col(pair_key), _col(timepoint))
    k = _col(clean_label)
    return F.when(k.isNotNull(), F.concat(stem, F.lit("_obj"), k.cast("string"))).otherwise(
        F.concat(stem, F.lit("_fail"), _col(raw_label).cast("string")))


def pair_gate(df: DataFrame, gate: PairGate = PairGate(), d0="t0_eq_diameter_um", v7="t7_volume_sphere_um3",
              ratio="fold_change_volume", flag0="t0_qc_flag", flag7="t7_qc_flag") -> DataFrame:
    """Combined flag and reason codes of a matched pair.

    A small starting diameter is recorded and excluded later, but does not change the flag.
    """
    rejected = F.col(flag0).isin(*REJECTED) | F.col(flag7).isin(*REJECTED)
    vanished = num(v7) <= 0
    low, high = num(ratio) < gate.min_fold_change, num(ratio) > gate.max_fold_change
    gate_ok = F.coalesce(num(d0) >= gate.min_d0_um, F.lit(False))
    dead = rejected | vanished
    review = (F.col(flag0) == "REVIEW") | (F.col(flag7) == "REVIEW") | low | high
    codes = reasons(
        (vanished | (num(ratio) <= 0), "VANISHED_SPHEROID"),
        (F.col(flag0).isin(*REJECTED), F.concat(F.lit("t0_"), F.col(flag0))),
        (F.col(flag7).isin(*REJECTED), F.concat(F.lit("t7_"), F.col(flag7))),
        (~dead & (F.col(flag0) == "REVIEW"), "t0_REVIEW"),
        (~dead & (F.col(flag7) == "REVIEW"), "t7_REVIEW"),
        (~dead & low, "extreme_shrinkage"),
        (~dead & high, "extreme_expansion"),
        (~dead & ~gate_ok, "sub_denominator_baseline"),
    )
    return (
        df.withColumn("denominator_gate_pass", gate_ok)
        .withColumn("combined_qc_flag",
                    F.when(dead, F.lit("FAIL")).when(review, F.lit("REVIEW")).otherwise(F.lit("PASS")))
        .withColumn("qc_codes", codes)
    )


def size_gate(df: DataFrame, image: Sequence[str], label: str, volume: str, gate: SizeGate) -> tuple[DataFrame, DataFrame]:
    """Objects inside the volume bounds with compact new labels, and the removal counts per image."""
    b = gate.bounds()
    v = num(volume)
    small, large = v < b["min"], v > b["max"]
    kept = row_numbers(df.filter(~(small | large)), image, [label], "new_label")
    return kept, size_gate_counts(df, image, volume, gate)


def size_gate_counts(df: DataFrame, image: Sequence[str], volume: str, gate: SizeGate) -> DataFrame:
    """The removal counts of ``size_gate`` alone, without numbering the objects."""
    b = gate.bounds()
    v = num(volume)
    small, large = v < b["min"], v > b["max"]
    return df.groupBy(*image).agg(
        F.count_if(small).alias("n_removed_small"), F.count_if(large).alias("n_removed_large"),
        F.count_if(~(small | large)).alias("n_kept"))


def border_touch(box: Sequence[str], shape: Sequence[str], margin) -> Column:
    """Inclusive border test of two-channel objects (box maxima are exclusive indices)."""
    r0, c0, r1, c1 = (F.col(c) for c in box)
    h, w = (_col(c) for c in shape)
    m = F.lit(margin) if isinstance(margin, (int, float)) else _col(margin)
    return (r0 <= m) | (c0 <= m) | (r1 >= h - m) | (c1 >= w - m)


def nucleus_flags(edge: Column, excluded: Column, volume: Column, qc: FieldQC = FieldQC()) -> Column:
    codes = reasons(
        (edge, "edge_touching"), (excluded, "excluded_border"),
        (volume < qc.min_volume_um3, "debris"), (volume > qc.max_volume_um3, "merged"))
    return reason_text(codes, empty="none", sep=";")


def image_plausibility(df: DataFrame, image: Sequence[str], label: str, area: str, image_area: str,
                       flag: str = "qc_flag", gate: ObjectGate = ObjectGate()) -> DataFrame:
    """PASS, or the first reason why an image's segmentation is not believable."""
    clean = ~F.col(flag).isin(*REJECTED)
    over = num(area) > gate.max_area_share * num(image_area)
    per = df.groupBy(*image).agg(
        F.count_if(clean).alias("n_clean"),
        F.min(F.when(clean & over, F.col(label))).alias("_clean_label"),
        F.min(F.when(over, F.col(label))).alias("_raw_label"))
    status = (
        F.when(F.col("n_clean") == 0, F.lit("SEG_FAIL: 0 objects"))
        .when(F.col("_clean_label").isNotNull(), F.lit("SEG_FAIL: single mask over limit"))
        .when(F.col("_raw_label").isNotNull(), F.lit("SEG_FAIL: raw mask over limit"))
        .otherwise(F.lit("PASS")))
    return per.select(*image, "n_clean", status.alias("status"),
                      F.when(F.col("n_clean") > 0, F.coalesce("_clean_label", "_raw_label")).alias("first_label"))


def analysed(df: DataFrame, include_review: bool = False, value: str | None = "log2_fold_change",
             gate_ok: str = "denominator_gate_pass", flag: str = "combined_qc_flag") -> DataFrame:
    """Rows that enter the statistics: size gate passed, accepted flag, finite value."""
    allowed = ["PASS", "REVIEW"] if include_review else ["PASS"]
    keep = F.coalesce(F.col(gate_ok), F.lit(False)) & F.col(flag).isin(*allowed)
    if value:
        keep = keep & finite(value).isNotNull()
    return df.filter(keep)


def balanced_images(manifest: DataFrame, n: int, condition: str = "condition", unit: str = "pair_key",
                    image: str = "image_id", matched: str = "is_matched_pair") -> DataFrame:
    """``n`` images taken one unit per condition and round, matched pairs before single images.

    The last unit is cut to fit, so exactly ``n`` images come back when there are that many.
    """
    pair = F.col(matched)
    own = F.when(pair, F.col(unit)).otherwise(F.col(image)).cast("string")
    rows = manifest.withColumn("_single", F.when(pair, 0).otherwise(1)).withColumn("_own", own)
    units = rows.groupBy(condition, "_single", "_own").agg(F.count(F.lit(1)).alias("_size"))
    # the ordering value joins "pairs first" and the unit name, so its prefix stays order preserving
    units = units.withColumn("_o", F.concat(F.col("_single").cast("string"), F.lit("|"), F.col("_own")))
    units = cut_lineage(units)   # one row per unit, scanned twice below
    units = row_numbers(units, [condition], ["_o"], "_round")
    units = running(units, [], ["_round", condition], {"_upto": ("sum", F.col("_size"))})
    first = units.filter(F.col("_upto") - F.col("_size") < n).select(
        F.col(condition).alias("_c"), F.col("_single").alias("_s"), F.col("_own").alias("_u"),
        (F.lit(n) - (F.col("_upto") - F.col("_size"))).alias("_room"))
    picked = rows.join(first, (F.col(condition) == F.col("_c")) & (F.col("_single") == F.col("_s"))
                       & (F.col("_own") == F.col("_u")))
    picked = row_numbers(picked, ["_c", "_s", "_u"], [image], "_i")
    return picked.filter(F.col("_i") <= F.col("_room")).select(*manifest.columns)


def stratified_sample(df: DataFrame, stratum: str, order: str, n: int) -> DataFrame:
    """First ``n`` rows taken round-robin over the sorted strata."""
    placed = row_numbers(df, [stratum], [order], "_round")
    return placed.orderBy("_round", stratum).limit(n).drop("_round")


def split_decisions(parents: DataFrame, children: DataFrame, keys: Sequence[str], volume: str, child_volume: str,
                    child: str, gate: SizeGate) -> DataFrame:
    """Accept a split when there are several children and every one is inside the size gate."""
    b = gate.bounds()
    cand = parents.filter(num(volume) > gate.split_factor * gate.reference_um3)
    v = num(child_volume)
    per = children.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_and((v >= b["min"]) & (v <= b["max"])).alias("_inside"),
        F.min_by(F.when(v < b["min"], "child_below_min").when(v > b["max"], "child_above_max"),
                 F.when((v < b["min"]) | (v > b["max"]), F.col(child))).alias("_why"))
    j = cand.join(per, list(keys), "left")
    n = F.coalesce(F.col("_n"), F.lit(0))
    accepted = (n > 1) & F.col("_inside")
    why = F.when(n <= 1, F.lit("single_seed")).when(~accepted, F.col("_why")).otherwise(F.lit(""))
    return j.select(*parents.columns, F.greatest(n, F.lit(1)).cast("bigint").alias("n_children"),
                    accepted.alias("accepted"), why.alias("reason"))


def keyed_sample(df: DataFrame, ids: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows chosen by the hash of seed and id: the same rows for any partitioning."""
    key = F.md5(F.concat_ws("/", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))
    return df.withColumn("_key", key).orderBy("_key", *ids).limit(n).drop("_key")


def volumes_from_area(area_px: str, px_um: str) -> Column:
    s = num(px_um)
    return sphere_volume(disk_diameter(num(area_px) * s * s))


def field_flags(df: DataFrame, qc: FieldQC = FieldQC(), count: str = "n_objects", snr: str = "snr", saturation: Sequence[str] = ("saturation_frac",),
                duplicates: str | None = "n_duplicates_removed", debris: str = "debris_count", merged: str = "merged_count",
                edge_share: str = "edge_touching_frac") -> DataFrame:
    """The flags a field earns by itself, as columns ``flag_<name>``; a missing measurement raises none.

    A field without objects counts as empty only when its signal is good enough to expect some.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    n = F.coalesce(num(count), F.lit(0))
    full = [num(c) > qc.saturation_max for c in saturation]
    return df.withColumns({
        "flag_empty_seg": yes((n == 0) & (num(snr) >= qc.snr_min)),
        "flag_dup_masks": yes(num(duplicates) > 0) if duplicates else F.lit(False),
        "flag_debris_or_merged": yes(num(debris) > 0) | yes(num(merged) > 0),
        "flag_edge_heavy": yes(num(edge_share) > qc.edge_share_max),
        "flag_saturated": yes(full[0]) | yes(full[-1]),
        "flag_low_snr": yes(num(snr) < qc.snr_min),
    })


OWN_FLAGS = ("empty_seg", "dup_masks", "debris_or_merged", "edge_heavy", "saturated", "low_snr")


def cohort_flags(df: DataFrame, image: str = "image_id", material: str = "material", laplacian: str = "laplacian_var",
                 density: str = "nuclei_per_mm2", count: str = "n_nuclei", own_flags: Sequence[str] = (),
                 blur_threshold: float | None = None, blur_percentile: float | None = None,
                 qc: FieldQC = FieldQC()) -> DataFrame:
    """Cohort-relative flags: blur, and outliers of density and count inside a material.

    ``own_flags`` are boolean columns ``flag_<name>`` already present. ``flag_any`` leaves the two
    outlier flags out; ``flags_list`` has all of them in the fixed order.
    """
    if (blur_threshold is None) == (blur_percentile is None):
        raise ValueError("give either blur_threshold or blur_percentile")
    d = F.when(num(density) > 0, num(density))
    fences = group_summary(
        df, [material],
        {"_d25": (d, 0.25), "_d75": (d, 0.75), "_c25": (num(count), 0.25), "_c75": (num(count), 0.75)},
        [F.count(F.lit(1)).alias("_n"), F.count(d).alias("_nd")])
    fences = fences.withColumnRenamed(material, "_m")
    out = df.join(fences, F.col(material).eqNullSafe(F.col("_m")), "left")
    k = qc.iqr_factor
    enough = F.col("_n") >= qc.min_group

    def outside(v, lo, hi):
        spread = F.col(hi) - F.col(lo)
        return F.coalesce((v < F.col(lo) - k * spread) | (v > F.col(hi) + k * spread), F.lit(False))

    out = out.withColumn("flag_density_outlier", enough & (F.col("_nd") >= 3) & outside(d, "_d25", "_d75"))
    out = out.withColumn("flag_count_outlier", enough & outside(num(count), "_c25", "_c75"))
    if blur_threshold is not None:
        cut = F.lit(float(blur_threshold))
    else:
        cut = group_summary(df, [], {"_b": (num(laplacian), blur_percentile / 100.0)}).select("_b").scalar()
    out = out.withColumn("flag_blurry", F.coalesce(num(laplacian) < cut, F.lit(False)))
    # Fixed order of the field flags.
    order = ["empty_seg", "density_outlier", "count_outlier", "dup_masks", "debris_or_merged",
             "edge_heavy", "saturated", "blurry", "low_snr"]
    have = set(own_flags) | {"density_outlier", "count_outlier", "blurry"}
    names = [n for n in order if n in have]
    artifacts = [n for n in names if n not in ("density_outlier", "count_outlier")]
    any_flag = F.lit(False)
    for n in artifacts:
        any_flag = any_flag | F.col("flag_" + n)
    return (
        out.withColumn("flag_any", any_flag)
        .withColumn("flags_list", F.concat_ws(";", reasons(*[(F.col("flag_" + n), n) for n in names])))
        .drop("_m", "_n", "_nd", "_d25", "_d75", "_c25", "_c75")
    )
