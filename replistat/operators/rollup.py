"""Aggregates of the growth analysis: exclusion audit, wells, populations, yields, histograms."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import finite, num
from .scan import group_summary, row_numbers


def backend_mix(df: DataFrame, keys: Sequence[str], backend: str, name: str = "backend_counts") -> DataFrame:
    """``name:count;...`` per key, sorted by name (counted first, so rows of a key never gather)."""
    counts = df.filter(F.col(backend).isNotNull()).groupBy(*keys, backend).agg(F.count(F.lit(1)).alias("_n"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(backend).alias("k"), F.col("_n").alias("n"))))
    return counts.groupBy(*keys).agg(
        F.concat_ws(";", F.transform(parts, lambda s: F.concat_ws(":", s["k"], s["n"].cast("string")))).alias(name))


def exclusion_audit(objects: DataFrame, pairs: DataFrame, reasons: str = "qc_reasons", flag: str = "qc_flag",
                    baseline: Column | None = None, image: str = "image_id", pair_id: str = "pair_id",
                    plausibility_fallbacks: int = 0, pair_reasons: str = "qc_reasons") -> DataFrame:
    """Counts of the exclusion steps E1 to E10 as rows ``stage, metric, n``."""
    t0 = baseline if baseline is not None else F.col("timepoint") == "t0"
    has = lambda word: F.col(reasons).contains(word)
    loose = (F.col(pair_id) == "UNPAIRED") & (F.col(flag) != "FAIL")
    o = objects.agg(
        F.count_distinct(F.when(t0, F.col(image))).alias("E1_images_t0"),
        F.count_distinct(F.when(~t0, F.col(image))).alias("E1_images_t7"),
        F.count_if(has("debris")).alias("E3_debris_undersized"),
        F.count_if(has("oversized")).alias("E4_oversized_artifact"),
        F.count_if(has("border")).alias("E5_border_touching"),
        F.count_if(has("contrast")).alias("E6_insufficient_contrast"),
        F.count_if(loose & t0).alias("E7_unpaired_t0"),
        F.count_if(loose & ~t0).alias("E7_unpaired_t7"))
    r = F.col(pair_reasons)
    p = pairs.agg(
        F.count_if(~F.col("denominator_gate_pass")).alias("E8_denominator_excluded"),
        F.count_if(r.contains("extreme_shrinkage") | r.contains("extreme_expansion")).alias("E9_extreme_trajectory_review"),
        F.count_if(F.col("combined_qc_flag") == "PASS").alias("E10_final_pass_pairs"))
    def rows(df: DataFrame, names: list[str]) -> DataFrame:
        pairs_text = ", ".join(f"'{n}', `{n}`" for n in names)
        return df.select(F.expr(f"stack({len(names)}, {pairs_text}) as (metric, n)"))
    o = o.withColumn("E1_images_total", F.col("E1_images_t0") + F.col("E1_images_t7")).withColumn(
        "E2_plausibility_fallbacks", F.lit(plausibility_fallbacks).cast("bigint")).withColumn(
        "E7_unpaired_total", F.col("E7_unpaired_t0") + F.col("E7_unpaired_t7"))
    long = rows(o, o.columns).unionByName(rows(p, p.columns))
    return long.select(F.split_part(F.col("metric"), F.lit("_"), F.lit(1)).alias("stage"), "metric", "n")


def well_growth(objects: DataFrame, fields: DataFrame, well: Sequence[str] = ("condition", "replicate"),
                timepoint: str = "timepoint", volume: str = "volume_sphere_um3", flag: str = "qc_flag") -> DataFrame:
    """Growth of accepted objects per well; ``fields`` holds ``n_fields`` per well and timepoint.

    Only the literal labels t0 and t7 count here. A well without a field count is taken as one field.
    """
    well = list(well)
    v = num(volume)
    at = lambda tp, x: F.when(F.col(timepoint) == tp, x)
    per = objects.filter(F.col(flag) == "PASS").groupBy(*well).agg(
        F.coalesce(F.sum(at("t0", v)), F.lit(0.0)).alias("total_volume_um3_t0"),
        F.coalesce(F.sum(at("t7", v)), F.lit(0.0)).alias("total_volume_um3_t7"),
        F.count(at("t0", F.lit(1))).alias("count_t0"), F.count(at("t7", F.lit(1))).alias("count_t7"),
        F.avg(at("t0", v)).alias("mean_volume_um3_t0"), F.avg(at("t7", v)).alias("mean_volume_um3_t7"))
    nf = fields.groupBy(*well).agg(F.max(at("t0", F.col("n_fields"))).alias("_f0"), F.max(at("t7", F.col("n_fields"))).alias("_f7"))
    j = per.join(nf, well, "left")
    f0, f7 = F.coalesce("_f0", F.lit(1)).cast("bigint"), F.coalesce("_f7", F.lit(1)).cast("bigint")
    ratio = lambda a, b: F.when(b > 0, a / b)
    c = F.col
    j = j.withColumns({"effective_fovs_t0": f0, "effective_fovs_t7": f7})
    j = j.withColumns({
        "fc_total_volume": ratio(c("total_volume_um3_t7"), c("total_volume_um3_t0")),
        "fc_count": ratio(c("count_t7"), c("count_t0")),
        "fc_mean_volume": ratio(c("mean_volume_um3_t7"), c("mean_volume_um3_t0")),
        "count_density_t0": ratio(c("count_t0"), c("effective_fovs_t0")),
        "count_density_t7": ratio(c("count_t7"), c("effective_fovs_t7")),
        "pooled_volume_density_t0": ratio(c("total_volume_um3_t0"), c("effective_fovs_t0")),
        "pooled_volume_density_t7": ratio(c("total_volume_um3_t7"), c("effective_fovs_t7")),
    })
    return j.withColumns({
        "fc_count_density": ratio(c("count_density_t7"), c("count_density_t0")),
        "fc_pooled_vol_density": ratio(c("pooled_volume_density_t7"), c("pooled_volume_density_t0")),
    }).drop("_f0", "_f7")


def population_summary(objects: DataFrame, p_table: DataFrame | None = None, condition: str = "condition",
                       timepoint: str = "timepoint", volume: str = "volume_sphere_um3",
                       diameter: str = "equivalent_diameter_um", flag: str = "qc_flag") -> DataFrame:
    """Medians of all accepted objects per timepoint and their change, with the p-value's source."""
    at = lambda tp, x: F.when(F.col(timepoint) == tp, num(x))
    s = group_summary(
        objects.filter(F.col(flag) == "PASS"), [condition],
        {"median_v0_um3": (at("t0", volume), 0.5), "median_v7_um3": (at("t7", volume), 0.5),
         "median_d0_um": (at("t0", diameter), 0.5), "median_d7_um": (at("t7", diameter), 0.5)},
        [F.count(at("t0", volume)).alias("n_t0"), F.count(at("t7", volume)).alias("n_t7")])
    v0, v7 = F.col("median_v0_um3"), F.col("median_v7_um3")
    s = s.withColumn("delta_median_v_um3", v7 - v0).withColumn("pop_fold_change", F.when(v0 > 0, v7 / v0))
    if p_table is None:
        return s
    p = p_table.select(F.col(condition).alias("_c"), "p_adj", "p_raw", "significance")
    j = s.join(p, F.col(condition) == F.col("_c"), "left").drop("_c")
    kind = F.when(F.col("p_adj").isNotNull(), "Holm-adjusted").when(F.col("p_raw").isNotNull(), "unadjusted").otherwise("—")
    return j.withColumn("p_value", F.coalesce("p_adj", "p_raw")).withColumn("p_type", kind).withColumn(
        "significance", F.coalesce("significance", F.lit("ns"))).drop("p_adj", "p_raw")


def call_rate(manifest: DataFrame, objects: DataFrame, key: str = "pair_key", timepoint: str = "timepoint",
              flag: str = "qc_flag") -> DataFrame:
    """Share of matched keys that have an accepted object at every timepoint."""
    matched = manifest.groupBy(key).agg(F.count_distinct(timepoint).alias("_nt")).filter("_nt >= 2").select(key)
    mine = objects.join(matched, key, "left_semi")
    n_tp = mine.agg(F.greatest(F.lit(1), F.count_distinct(timepoint)).alias("n")).scalar()
    per = mine.filter(F.col(flag) == "PASS").groupBy(key).agg(F.count_distinct(timepoint).alias("_k"))
    called = per.withColumn("_n", n_tp).agg(F.count_if(F.col("_k") >= F.col("_n")).alias("n")).scalar()
    return matched.agg(F.count(F.lit(1)).alias("n_matched")).withColumn("n_called", called).withColumn(
        "call_rate", F.when(F.col("n_matched") > 0, 100.0 * F.col("n_called") / F.col("n_matched")))


def effective_scales(objects: DataFrame, image: str = "image_id", px: str = "pixel_size_um", source: str = "scale_source") -> DataFrame:
    """Pixel sizes in use, counted per image."""
    per = objects.filter(F.col(px).isNotNull() & F.col(source).isNotNull()).groupBy(image).agg(
        F.min(F.struct(F.bround(F.col(px).cast("double"), 6).alias("px"), F.col(source).alias("src"))).alias("_s"))
    return per.groupBy(F.col("_s.px").alias(px), F.col("_s.src").alias(source)).agg(F.count(F.lit(1)).alias("n_images"))


def qc_yield(objects: DataFrame, condition: str = "condition", flag: str = "qc_flag") -> DataFrame:
    """Accepted, review and rejected objects per condition with percentages."""
    f = F.col(flag)
    s = objects.groupBy(condition).agg(
        F.count_if(f == "PASS").alias("n_pass"), F.count_if(f == "REVIEW").alias("n_review"),
        F.count_if(f.isin("FAIL", "SEG_FAIL")).alias("n_fail"), F.count(F.lit(1)).alias("n_total"))
    pct = lambda c: 100.0 * F.col(c) / F.col("n_total")
    return s.withColumns({"pct_pass": pct("n_pass"), "pct_review": pct("n_review"), "pct_fail": pct("n_fail")})


# Chart label -> word looked for in the reasons.
REJECTION_WORDS = {
    "Border Clipped": "touches_image_border",
    "Low Contrast": "insufficient_dark_contrast",
    "Undersized": "debris_undersized",
    "Multi-Focal Duplicate": "duplicate_focal_plane",
    "Oversized": "oversized",
}


def rejection_counts(objects: DataFrame, reasons: str = "qc_reasons", flag: str = "qc_flag") -> DataFrame:
    words = ", ".join(f"'{k}', `{k}`" for k in REJECTION_WORDS)
    one = objects.filter(F.col(flag) == "FAIL").agg(
        *[F.count_if(F.col(reasons).contains(w)).alias(k) for k, w in REJECTION_WORDS.items()])
    return one.select(F.expr(f"stack({len(REJECTION_WORDS)}, {words}) as (reason, n)"))


def histogram(df: DataFrame, keys: Sequence[str], value: str, low: float, high: float, bins: int, log: bool = False) -> DataFrame:
    """Counts and densities in equal (or equal-ratio) bins; the last edge is inside the last bin.

    The density is normalised per key over the values inside the range.
    """
    v = finite(value)
    if log:
        step = math.log(high / low) / bins
        place = F.floor(F.log(v / low) / step)
        edge = lambda i: F.lit(low) * F.exp(i * step)
    else:
        step = (high - low) / bins
        place = F.floor((v - low) / step)
        edge = lambda i: F.lit(low) + i * step
    i = F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)).cast("bigint")
    inside = df.filter((v >= low) & (v <= high)).groupBy(*keys, i.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = inside.groupBy(*keys).agg(F.sum("n").alias("_t"))
    j = inside.join(total, list(keys))
    width = edge(F.col("bin") + 1) - edge(F.col("bin"))
    return j.select(*keys, "bin", edge(F.col("bin")).alias("low"), "n", (F.col("n") / (F.col("_t") * width)).alias("density"))


def image_status(manifest: DataFrame, objects: DataFrame, image: str = "image_id", flag: str = "qc_flag",
                 read_ok: Column | None = None, process_ok: Column | None = None,
                 plausible: Column | None = None) -> DataFrame:
    """One row per image: OK, READ_FAIL, SEG_FAIL or PROCESS_FAIL with object counts."""
    per = objects.groupBy(image).agg(
        F.count(F.lit(1)).alias("n_objects"), F.count_if(F.col(flag) == "PASS").alias("n_pass"),
        F.bool_or(F.col(flag) == "SEG_FAIL").alias("_seg")).withColumnRenamed(image, "_img")
    j = manifest.join(per, F.col(image) == F.col("_img"), "left")
    seg = F.coalesce(F.col("_seg"), F.lit(False)) | (~plausible if plausible is not None else F.lit(False))
    status = F.when(~read_ok, "READ_FAIL") if read_ok is not None else F.when(F.lit(False), "")
    status = status.when(~process_ok, "PROCESS_FAIL") if process_ok is not None else status
    status = status.when(seg, "SEG_FAIL").otherwise("OK")
    zero = F.lit(0).cast("bigint")
    return j.withColumn("status", status).withColumn("n_objects", F.coalesce("n_objects", zero)).withColumn(
        "n_pass", F.coalesce("n_pass", zero)).drop("_img", "_seg")


def run_status(statuses: DataFrame, status: str = "status", failed_steps: int = 0) -> DataFrame:
    """FAILED when no image worked, COMPLETED_WITH_ERRORS when a step failed, else SUCCESS."""
    s = statuses.agg(F.count(F.lit(1)).alias("n_images"), F.count_if(F.col(status) == "OK").alias("n_ok"))
    verdict = F.when((F.col("n_images") > 0) & (F.col("n_ok") == 0), "FAILED").when(
        F.lit(failed_steps > 0), "COMPLETED_WITH_ERRORS").otherwise("SUCCESS")
    return s.withColumn("n_failed", F.col("n_images") - F.col("n_ok")).withColumn("run_status", verdict)


def ordered_items(rows: DataFrame, keys: Sequence[str], items: str, order: Sequence[str], name: str, place: str = "place") -> DataFrame:
    """Distinct items of all lists per key, one row each, numbered by first appearance."""
    first = rows.select(*keys, F.struct(*order).alias("_o"), F.posexplode(items).alias("_p", name)).groupBy(*keys, name).agg(
        F.min(F.struct("_o", "_p")).alias("_at"))
    return row_numbers(first, keys, ["_at", name], place).drop("_at")


def distribution_feed(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Box-plot numbers of the finite positive values per key."""
    v = F.when(finite(value) > 0, finite(value))
    kept = df.filter(v.isNotNull())
    return group_summary(kept, keys, {"q1": (v, 0.25), "med": (v, 0.5), "q3": (v, 0.75)},
                         [F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")])


def trajectory_feed(pairs: DataFrame, condition: str = "condition", first: str = "t0_volume_sphere_um3", last: str = "t7_volume_sphere_um3",
                    flag: str | None = "combined_qc_flag") -> DataFrame:
    """Both ends of every accepted pair with positive volumes, whether it grew, and the number of lines of its condition."""
    v0, v7 = num(first), num(last)
    kept = pairs.filter((F.col(flag) == "PASS") if flag else F.lit(True)).filter((v0 > 0) & (v7 > 0))
    lines = kept.select(F.col(condition), "pair_id", v0.alias("first_value"), v7.alias("last_value"), (v7 >= v0).alias("grew"))
    n = kept.groupBy(F.col(condition).alias("_c")).agg(F.count(F.lit(1)).alias("n_lines"))
    return lines.join(n, F.col(condition).eqNullSafe(F.col("_c"))).drop("_c")


def preflight_rules(rules: Sequence[tuple[str, str, DataFrame]]) -> DataFrame:
    """Union of rule results ``(rule, severity, n, sample)``; ``n > 0`` of a fatal rule fails the audit.

    Each rule is a frame with columns ``n`` and ``sample``.
    """
    parts = [df.select(F.lit(name).alias("rule"), F.lit(level).alias("severity"), F.col("n").cast("bigint").alias("n"),
                       F.col("sample").cast("string").alias("sample")) for name, level, df in rules]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _rules_of(df: DataFrame, rules: Sequence[tuple[str, str, Column, Column]]) -> DataFrame:
    """Rule rows from one pass: each rule is (name, severity, condition of a hit, sample of a hit)."""
    one = df.agg(*[x for i, (_, _, hit, show) in enumerate(rules) for x in (F.count_if(hit).alias(f"_n{i}"), F.min(F.when(hit, show.cast("string"))).alias(f"_s{i}"))])
    rows = [F.struct(F.lit(name).alias("rule"), F.lit(level).alias("severity"), F.col(f"_n{i}").alias("n"), F.col(f"_s{i}").alias("sample")) for i, (name, level, _, _) in enumerate(rules)]
    return one.select(F.inline(F.array(*rows)))


def _absent(df: DataFrame, name: str, severity: str, wanted: Column) -> DataFrame:
    """A rule that is hit once when no row is as wanted."""
    return df.agg((F.count_if(wanted) == 0).cast("bigint").alias("n")).select(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), "n", F.lit(None).cast("string").alias("sample"))


def acquisition_rules(inventory: DataFrame, rejected: DataFrame, control: str = "Mat", images: DataFrame | None = None,
                      first: str = "t0", second: str = "t7") -> DataFrame:
    """Audit of a two-timepoint image set before a run.

    ``inventory``: one row per readable file (pair_key, timepoint, condition, file_path and, where known,
    is_calibrated); ``rejected``: files whose name cannot be read (file_path); ``images``: spot check per
    image (image_id, is_blank, is_saturated).
    """
    calibrated = F.coalesce(F.col("is_calibrated"), F.lit(False)) if "is_calibrated" in inventory.columns else F.lit(None).cast("boolean")
    files = inventory.groupBy("pair_key", "timepoint").agg(F.count(F.lit(1)).alias("_k"), F.min("file_path").alias("_f"), F.count_if(~calibrated).alias("_u"))
    keys = files.groupBy("pair_key").agg(
        F.bool_or(F.col("timepoint") == first).alias("_a"), F.bool_or(F.col("timepoint") == second).alias("_b"),
        F.sum(F.col("_k") - 1).alias("_dup"), F.sum("_u").alias("_u"), F.min("_f").alias("_f"))
    parts = [
        _absent(inventory, "no_first_timepoint", "fatal", F.col("timepoint") == first), _absent(inventory, "no_second_timepoint", "fatal", F.col("timepoint") == second),
        _absent(keys, "no_matched_pairs", "fatal", F.col("_a") & F.col("_b")), _absent(inventory, "control_missing", "warning", F.col("condition") == control),
        _rules_of(keys, [("single_first", "warning", F.col("_a") & ~F.col("_b"), F.col("pair_key")), ("single_second", "warning", F.col("_b") & ~F.col("_a"), F.col("pair_key")),
                         ("duplicate_keys", "warning", F.col("_dup") > 0, F.col("_f")), ("uncalibrated", "warning", F.col("_u") > 0, F.col("_f"))]),
        _rules_of(rejected, [("unreadable_names", "warning", F.lit(True), F.col("file_path"))]),
    ]
    if images is not None:
        parts.append(_rules_of(images, [("blank_image", "warning", F.col("is_blank"), F.col("image_id")), ("saturated_image", "warning", F.col("is_saturated"), F.col("image_id"))]))
    return reduce(lambda x, y: x.unionByName(y), parts)


def channel_rules(fields: DataFrame, allow_unpaired: bool = True, allow_uncalibrated: bool = True) -> DataFrame:
    """Audit of a two-channel set: ``fields`` has base, state (see ``field_state``), material, kind
    (2D, RGB or 3D) and is_calibrated; NULL stands for unknown."""
    unpaired = F.col("state").isin("missing_first", "missing_second")
    paired = ~unpaired & (F.col("state") != "collision")
    base = F.col("base")
    return _absent(fields, "no_paired_fields", "fatal", paired).unionByName(_rules_of(fields, [
        ("ambiguous_channel_files", "fatal", F.col("state") == "collision", base),
        ("unpaired_fields", "warning" if allow_unpaired else "fatal", unpaired, base),
        ("unrecognised_name", "warning", paired & F.col("material").isNull(), base),
        ("shape_mismatch", "fatal", F.col("state") == "shape_mismatch", base),
        ("pixel_size_mismatch", "warning", F.col("state") == "pixel_size_mismatch", base),
        ("multi_plane", "fatal", paired & (F.col("kind") == "3D"), base),
        ("rgb_image", "warning", paired & (F.col("kind") == "RGB"), base),
        ("uncalibrated", "warning" if allow_uncalibrated else "fatal", paired & ~F.coalesce("is_calibrated", F.lit(True)), base),
    ]))


def merge_tables(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", suffix: str = "_right",
                 prefer: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Join two tables on named keys; columns of the right side that clash get ``suffix``.

    ``prefer`` names columns to add as the first known value of a chain of candidates; candidates
    that neither table has are skipped, and a chain without any gives NULL.
    """
    clash = [c for c in right.columns if c in left.columns and c not in on]
    j = left.join(right.withColumnsRenamed({c: c + suffix for c in clash}), list(on), how)
    for name, chain in (prefer or {}).items():
        known = [F.col(c) for c in chain if c in j.columns]
        j = j.withColumn(name, F.coalesce(*known) if known else F.lit(None).cast("string"))
    return j


def cohort_changes(before: DataFrame, after: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Per key each metric before and after with its difference and relative change; keys of one side only stay with NULL."""
    a = before.select(*keys, *[F.col(m).alias(m + "_pre") for m in metrics])
    b = after.select(*keys, *[F.col(m).alias(m + "_post") for m in metrics])
    j = a.join(b, list(keys), "full_outer")
    change = lambda m: F.col(m + "_post") - F.col(m + "_pre")
    return j.withColumns({k: v for m in metrics for k, v in (
        (m + "_delta", change(m)), (m + "_rel", F.when(F.col(m + "_pre") != 0, change(m) / F.col(m + "_pre"))))})


def edge_histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts and density in equal bins of ``low .. high``; the last edge belongs to the last bin, values outside are left out."""
    v = num(value)
    width = (high - low) / bins
    at = F.least(F.floor((v - low) / width), F.lit(bins - 1)).cast("bigint")
    cells = df.filter((v >= low) & (v <= high)).groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("_t")) if by else cells.agg(F.sum("n").alias("_t"))
    j = cells.join(total, list(by)) if by else cells.withColumn("_t", total.scalar())
    return j.withColumn("density", F.col("n") / (F.col("_t") * width)).drop("_t")


def audit_passed(rule_rows: DataFrame) -> DataFrame:
    return rule_rows.agg(F.count_if((F.col("severity") == "fatal") & (F.col("n") > 0)).alias("n_fatal"),
                         F.count_if((F.col("severity") == "warning") & (F.col("n") > 0)).alias("n_warnings")).withColumn(
        "passed", F.col("n_fatal") == 0)
