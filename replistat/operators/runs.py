"""Comparison of analysis runs: deltas per image, factorial effects, spread within run families."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import areal_density, finite, num
from ..functions.labels import ARMS, ablation_arm, run_scope
from .scan import first_per_key, group_summary, row_numbers


def select_runs(rows: DataFrame, run: str = "run", names: Sequence[str] | None = None, scope: str = "full") -> DataFrame:
    """Rows of the named runs, or of all runs of a scope (``full`` leaves ``*_subset`` runs out).

    With ``run`` as the partition column of the table this is a partition filter.
    """
    if names is not None:
        return rows.filter(F.col(run).isin(*names))
    if scope == "any":
        return rows
    return rows.filter(run_scope(run) == scope)


def image_deltas(per_image: DataFrame, runs: Sequence[str], run: str = "run", image: str = "image_id",
                 material: str = "material", count: str = "n_nuclei", density: str = "nuclei_per_mm2",
                 flags: str = "flag_summary", order: Sequence[str] = ()) -> DataFrame:
    """One row per image: count and density per run, spreads over the runs that have it, and a rank.

    Repeated rows of an image in a run keep the first by ``order``. Images in fewer than two runs
    have no spread and no rank; ranks go by count spread, largest first.
    """
    per_image = first_per_key(per_image, [run, image], list(order) or [count, density])
    names = list(runs)
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(run))
    n, d = num(count), finite(density)
    at = lambda r, x: F.max(F.when(F.col(run) == r, x))
    cols: list[Column] = [F.min_by(F.col(material), place).alias(material)]
    for r in names:
        cols += [at(r, n).alias(f"{r}_count"), at(r, F.bround(d, 2)).alias(f"{r}_density")]
    flagged = F.when(F.col(flags) != "clean", F.struct(place.alias("p"), F.concat_ws(":", F.col(run), F.col(flags)).alias("t")))
    g = per_image.filter(F.col(run).isin(*names)).groupBy(image).agg(
        *cols, F.count(F.lit(1)).alias("n_runs_present"), (F.max(n) - F.min(n)).alias("_cs"), F.avg(n).alias("_cm"),
        F.stddev_samp(n).alias("_sd"), (F.max(d) - F.min(d)).alias("_ds"), F.count(d).alias("_nd"),
        F.array_sort(F.collect_list(flagged)).alias("_fl"), F.collect_set(run).alias("_have"))
    two = F.col("n_runs_present") >= 2
    g = g.withColumns({
        "count_spread": F.when(two, F.col("_cs")),
        "relative_spread": F.when(two & (F.col("_cm") > 0), F.bround(F.col("_sd") / F.col("_cm"), 3)),
        "density_spread": F.when(F.col("_nd") >= 2, F.bround("_ds", 2)),
        "active_flags": F.when(F.size("_fl") == 0, "clean").otherwise(F.concat_ws("; ", F.transform("_fl", lambda s: s["t"]))),
        "missing_in_runs": F.concat_ws(";", F.array_except(F.array(*[F.lit(r) for r in names]), F.col("_have"))),
    }).drop("_cs", "_cm", "_sd", "_ds", "_nd", "_fl", "_have")
    return disagreement_rank(g, image)


def disagreement_rank(deltas: DataFrame, image: str, spread: str = "count_spread", present: str = "n_runs_present",
                      name: str = "rank") -> DataFrame:
    """Rank by spread (falling), then image; images in fewer than two runs get NULL."""
    ranked = deltas.filter(F.col(present) >= 2)
    ranked = row_numbers(ranked, [], [F.col(spread).desc(), F.col(image)], name)
    rest = deltas.filter(F.col(present) < 2).withColumn(name, F.lit(None).cast("bigint"))
    return ranked.unionByName(rest)


def ablation_rows(qc: DataFrame, features: DataFrame, keys: Sequence[str] = ("run", "image_id", "material", "replicate"),
                  post: DataFrame | None = None, post_columns: Sequence[str] = ()) -> DataFrame:
    """Per-image rows of factorial runs: quality flags joined with features (and post-process counts)."""
    j = qc.filter(ablation_arm("run").isNotNull()).join(features, list(keys))
    if post is not None:
        j = j.join(post, ["run", "image_id"], "left").na.fill(0, list(post_columns))
    return j.withColumn("arm", ablation_arm("run")).withColumn("scope", run_scope("run"))


def ablation_summary(rows: DataFrame, count_final: str, count_raw: str, density: str, volume: str, flag: str,
                     flags_list: str, sums: Sequence[str] = ()) -> DataFrame:
    """One summary row per scope, run and material: means, spread, flag rate, distinct flags, sums."""
    flags = F.filter(F.split(F.col(flags_list), ";"), lambda f: f != "")
    keys = ["scope", "run", "material"]
    g = rows.groupBy(*keys).agg(
        F.min("arm").alias("arm"), F.avg(num(count_raw)).alias("mean_raw"), F.avg(num(count_final)).alias("mean_final"),
        F.avg(finite(density)).alias("mean_density"), F.stddev_samp(finite(density)).alias("sd_density"),
        F.avg(num(volume)).alias("mean_volume"), F.bool_or(flag).alias("flag_any"),
        F.avg(F.col(flag).cast("double")).alias("flag_rate"), F.count(F.lit(1)).alias("n_images"),
        *[F.sum(F.col(s).cast("bigint")).alias(s) for s in sums])
    words = rows.select(*keys, F.explode(flags).alias("_f")).distinct().groupBy(*keys).agg(
        F.concat_ws(";", F.array_sort(F.collect_list("_f"))).alias("flags_list"))
    return g.join(words, keys, "left").withColumn("flags_list", F.coalesce("flags_list", F.lit(""))).withColumn(
        "image_id", F.concat(F.lit("SUMMARY_"), F.col("material")))


def ablation_pivot(rows: DataFrame, runs: Sequence[str], density: str, count: str) -> DataFrame:
    """Material table: mean, standard deviation and mean count per run as columns."""
    wide = rows.groupBy("scope", "material").pivot("run", list(runs)).agg(
        F.avg(finite(density)).alias("density_mean"), F.stddev_samp(finite(density)).alias("density_sd"),
        F.avg(num(count)).alias("mean_count"))
    n = rows.groupBy("scope", "material").agg(F.count_distinct("image_id").alias("n_images"))
    return wide.join(n, ["scope", "material"])


def arm_conflicts(runs: DataFrame, run: str = "run") -> DataFrame:
    """Scope and arm pairs claimed by more than one run: an ambiguous design."""
    r = runs.select(run).distinct().withColumn("scope", run_scope(run)).withColumn("arm", ablation_arm(run))
    return r.filter(F.col("arm").isNotNull()).groupBy("scope", "arm").agg(
        F.count(F.lit(1)).alias("n_runs")).filter("n_runs > 1")


def factorial_effects(rows: DataFrame, arm: str, count: str, flag: str) -> DataFrame:
    """Arm means, main effects, interaction and flag-rate change as rows; NULL when an arm is missing."""
    at = lambda a, x: F.avg(F.when(F.col(arm) == a, x))
    n, f = num(count), F.col(flag).cast("double") * 100.0
    one = rows.agg(*[at(a, n).alias("c" + a) for a in ARMS], *[at(a, f).alias("f" + a) for a in ARMS])
    c = lambda a: F.col("cPP" + a)
    g = lambda a: F.col("fPP" + a)
    out = {f"mean_count_{a}": F.col("c" + a) for a in ARMS}
    out |= {f"flag_pct_{a}": F.col("f" + a) for a in ARMS}
    out |= {
        "effect_pre_count": c("10") - c("00"), "effect_post_count": c("01") - c("00"),
        "effect_both_count": c("11") - c("00"), "interaction_count": (c("11") - c("01")) - (c("10") - c("00")),
        "effect_pre_flag_pct": g("10") - g("00"), "effect_post_flag_pct": g("01") - g("00"),
        "effect_both_flag_pct": g("11") - g("00"),
    }
    one = one.select(*[e.alias(k) for k, e in out.items()])
    text = ", ".join(f"'{k}', `{k}`" for k in out)
    return one.select(F.expr(f"stack({len(out)}, {text}) as (effect, value)"))


def cv(value: Column) -> Column:
    """Sample deviation over mean; NULL for fewer than two values or a mean that is not positive."""
    return F.when((F.count(value) >= 2) & (F.avg(value) > 1e-9), F.stddev_samp(value) / F.avg(value))


def family_spread(per_image: DataFrame, family_a: Sequence[str], family_b: Sequence[str], run: str = "run",
                  image: str = "image_id", material: str = "material", count: str = "n_nuclei",
                  density: str = "nuclei_per_mm2") -> DataFrame:
    """Spread over the runs of two families per image, on images that every present run has."""
    rows = per_image.filter(F.col(run).isin(*family_a, *family_b))
    n_runs = rows.agg(F.count_distinct(run).alias("n")).scalar()
    in_a = F.col(run).isin(*family_a)
    n, d = num(count), finite(density)
    g = rows.groupBy(image).agg(
        F.min_by(F.col(material), F.col(run)).alias(material), F.count_distinct(run).alias("_n"),
        cv(F.when(in_a, n)).alias("a_count"), cv(F.when(~in_a, n)).alias("b_count"),
        cv(F.when(in_a, d)).alias("a_density"), cv(F.when(~in_a, d)).alias("b_density"))
    return g.withColumn("_all", n_runs).filter(F.col("_n") == F.col("_all")).drop("_n", "_all")


def robustness(spread: DataFrame, material: str = "material") -> DataFrame:
    """Spreads and their reduction per material plus the whole cohort (``ALL_COHORT``)."""
    both_c = F.col("a_count").isNotNull() & F.col("b_count").isNotNull()
    both_d = F.col("a_density").isNotNull() & F.col("b_density").isNotNull()
    g = spread.rollup(material).agg(
        F.grouping(material).alias("_all"), F.count_if(both_c).alias("n_images"),
        *[f(F.when(ok, F.col(c))).alias(n) for n, f, ok, c in (
            ("_am", F.avg, both_c, "a_count"), ("_ax", F.max, both_c, "a_count"), ("_bm", F.avg, both_c, "b_count"),
            ("_bx", F.max, both_c, "b_count"), ("_ad", F.avg, both_d, "a_density"), ("_bd", F.avg, both_d, "b_density"))])
    cut = lambda a, b: F.when(F.col(a) > 1e-12, F.bround(100.0 * (F.col(a) - F.col(b)) / F.col(a), 1))
    r3 = lambda c: F.bround(c, 3)
    return g.select(
        F.when(F.col("_all") == 1, "ALL_COHORT").otherwise(F.col(material)).alias(material), "n_images",
        r3("_am").alias("orig_mean_count_spread"), r3("_ax").alias("orig_max_count_spread"),
        r3("_bm").alias("pp_mean_count_spread"), r3("_bx").alias("pp_max_count_spread"),
        cut("_am", "_bm").alias("spread_reduction_mean_pct"), cut("_ax", "_bx").alias("spread_reduction_max_pct"),
        r3("_ad").alias("orig_mean_density_spread"), r3("_bd").alias("pp_mean_density_spread"),
        cut("_ad", "_bd").alias("density_spread_reduction_pct"))


def metrics_by_run(summary: DataFrame, runs: Sequence[str], metrics: dict[str, Column], material: str = "material",
                   run: str = "run") -> DataFrame:
    """Material x run table of summary metrics."""
    return summary.groupBy(material).pivot(run, list(runs)).agg(*[F.max(e).alias(n) for n, e in metrics.items()])


def run_totals(per_image: DataFrame, run: str = "run", count: str = "n_nuclei", density: str = "nuclei_per_mm2",
               flag: str = "flag_any") -> DataFrame:
    """Fields, mean count, mean density and share flagged per run, with the extreme runs marked."""
    t = per_image.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_fields"), F.avg(num(count)).alias("mean_count"), F.avg(finite(density)).alias("mean_density"),
        (100.0 * F.avg(F.col(flag).cast("double"))).alias("pct_flagged"))
    hi = t.agg(F.max_by(run, F.struct("mean_count", F.col(run))).alias("r")).scalar()
    lo = t.agg(F.min_by(run, F.struct("mean_count", F.col(run))).alias("r")).scalar()
    return t.withColumn("_hi", hi).withColumn("_lo", lo).withColumn("is_highest", F.col(run) == F.col("_hi")).withColumn(
        "is_lowest", F.col(run) == F.col("_lo")).drop("_hi", "_lo")


def spread_by_material(deltas: DataFrame, material: str = "material") -> DataFrame:
    return deltas.filter(F.col("n_runs_present") >= 2).groupBy(material).agg(
        F.count(F.lit(1)).alias("n_images"), F.avg("count_spread").alias("mean_spread"), F.max("count_spread").alias("max_spread"))


def identical_runs(per_image: DataFrame, run: str = "run", image: str = "image_id", count: str = "n_nuclei",
                   density: str = "nuclei_per_mm2", same_images: bool = True) -> DataFrame:
    """Every pair of runs that share images, with ``identical``: equal counts, densities within tolerance.

    The join is per image over the runs that have it (a run list is short); with ``same_images`` both
    runs must hold exactly the same images.
    """
    rows = per_image.select(F.col(run).alias("_r"), F.col(image).alias("_i"), F.col(count).alias("_n"), finite(density).alias("_d"))
    a = rows.select(*[F.col(c).alias(c + "a") for c in rows.columns])
    b = rows.select(*[F.col(c).alias(c + "b") for c in rows.columns])
    near = F.abs(F.col("_da") - F.col("_db")) <= 1e-8 + 1e-5 * F.abs(F.col("_db"))
    same = (F.col("_na") == F.col("_nb")) & F.coalesce(near, F.col("_da").isNull() & F.col("_db").isNull())
    j = a.join(b, (F.col("_ia") == F.col("_ib")) & (F.col("_ra") < F.col("_rb"))).groupBy(
        F.col("_ra").alias("run_a"), F.col("_rb").alias("run_b")).agg(
        F.count(F.lit(1)).alias("n_common"), F.bool_and(same).alias("_same"))
    size = rows.groupBy("_r").agg(F.count(F.lit(1)).alias("_s"))
    j = j.join(size.select(F.col("_r").alias("run_a"), F.col("_s").alias("_sa")), "run_a").join(
        size.select(F.col("_r").alias("run_b"), F.col("_s").alias("_sb")), "run_b")
    full = (F.col("n_common") == F.col("_sa")) & (F.col("n_common") == F.col("_sb"))
    return j.select("run_a", "run_b", "n_common", (F.col("_same") & (full if same_images else F.lit(True))).alias("identical"))


def material_summary(per_image: DataFrame, material: str = "material", replicate: str = "replicate",
                     density: str = "nuclei_per_mm2", flags: str = "flag_summary", volume: str | None = None,
                     area: str | None = None) -> DataFrame:
    """Descriptive part of the material summary: fields, clean fields, gels, means and deviations.

    ``clean`` means that no flag at all is listed, including the two outlier flags.
    """
    d = finite(density)
    clean = F.col(flags) == "clean"
    aggs = [
        F.count(F.lit(1)).alias("n_images_total"), F.count_if(clean).alias("n_images_clean"),
        F.count_distinct(replicate).alias("n_gels"),
        F.avg(d).alias("mean_nuclei_per_mm2_all"), F.stddev_samp(d).alias("sd_nuclei_per_mm2_all"),
        F.avg(F.when(clean, d)).alias("mean_nuclei_per_mm2_clean"), F.stddev_samp(F.when(clean, d)).alias("sd_nuclei_per_mm2_clean"),
    ]
    if area:
        aggs.append(F.avg(finite(area)).alias("mean_spheroid_area_um2"))
    if volume:
        s = group_summary(per_image, [material], {"median_nuclear_volume_um3": (finite(volume), 0.5)}, aggs)
    else:
        s = per_image.groupBy(material).agg(*aggs)
    gel = per_image.filter(d.isNotNull() & F.col(replicate).isNotNull()).groupBy(material, replicate).agg(F.avg(d).alias("_g"))
    gel = gel.groupBy(F.col(material).alias("_m")).agg(
        F.avg("_g").alias("gel_mean_nuclei_per_mm2"), F.stddev_samp("_g").alias("gel_sd_nuclei_per_mm2"))
    j = s.join(gel, F.col(material).eqNullSafe(F.col("_m")), "left").drop("_m")
    return j.withColumn("flagged_image_rate",
                        F.bround((F.col("n_images_total") - F.col("n_images_clean")) / F.col("n_images_total"), 3))


def image_rollup(objects: DataFrame, fields: DataFrame, image: str = "image_id", volume: str = "volume_um3",
                 excluded: str = "excluded_border", area: str = "density_area_um2") -> DataFrame:
    """Counted, total and border-excluded objects per field, density and median object volume.

    The median is over all objects of the field, excluded ones too; a field without objects gets 0.
    """
    s = group_summary(objects, [image], {"_mv": (num(volume), 0.5)},
                      [F.count_if(~F.col(excluded)).alias("_nv"), F.count(F.lit(1)).alias("_nt")])
    j = fields.join(s.withColumnRenamed(image, "_img"), F.col(image) == F.col("_img"), "left")
    zero = F.lit(0).cast("bigint")
    j = j.withColumn("n_nuclei", F.coalesce("_nv", zero)).withColumn("n_nuclei_total", F.coalesce("_nt", zero))
    return j.withColumn("n_border_excluded", F.col("n_nuclei_total") - F.col("n_nuclei")).withColumn(
        "nuclei_per_mm2", areal_density("n_nuclei", area)).withColumn(
        "median_nuclear_volume_um3", F.coalesce("_mv", F.lit(0.0))).drop("_img", "_nv", "_nt", "_mv")


def field_counts(objects: DataFrame, image: Sequence[str], volume: Column, edge: Column, min_volume: float,
                 max_volume: float) -> DataFrame:
    """Debris, merged and edge-touching objects per field."""
    return objects.groupBy(*image).agg(
        F.count(F.lit(1)).alias("n_objects"), F.count_if(volume < min_volume).alias("debris_count"),
        F.count_if(volume > max_volume).alias("merged_count"),
        (F.count_if(edge) / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("edge_touching_frac"))
