"""Comparison of runs, material summaries, field rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from replistat.functions.labels import flag_severity
from replistat.operators import runs as rn
from replistat.plans.density import summarise_materials

from . import views as v
from .registry import query
from .views import RUNS, big, r

ARM_OF = {"click": "401_PP00_none", "error": "402_PP10_bg", "purchase": "403_PP01_post", "signup": "404_PP11_full", "view": "001_base"}


def armed(spark, d):
    run = F.create_map(*[F.lit(x) for kv in ARM_OF.items() for x in kv])[F.col("run")]
    return v.fields(spark, d).withColumn("run", run)


_ARM = "WITH a AS (SELECT * REPLACE (CASE run WHEN 'click' THEN '401_PP00_none' WHEN 'error' THEN '402_PP10_bg' WHEN 'purchase' THEN '403_PP01_post' WHEN 'signup' THEN '404_PP11_full' ELSE '001_base' END AS run) FROM v_field)"


@query("material_summary_a9", """WITH g AS (SELECT material, avg(gm) AS gmean, stddev_samp(gm) AS gsd FROM (SELECT material, replicate, avg(nuclei_per_mm2) AS gm FROM v_field GROUP BY 1, 2) GROUP BY 1)
  SELECT material, count(*) AS n_images_total, count(*) FILTER (WHERE flag_summary = 'clean') AS n_images_clean, count(DISTINCT replicate) AS n_gels, round(avg(nuclei_per_mm2), 6) AS mean_all, round(stddev_samp(nuclei_per_mm2), 6) AS sd_all,
    round(avg(nuclei_per_mm2) FILTER (WHERE flag_summary = 'clean'), 6) AS mean_clean, round(any_value(gmean), 6) AS gel_mean, round(any_value(gsd), 6) AS gel_sd, round(median(peak), 6) AS med_volume
  FROM v_field JOIN g USING (material) GROUP BY material""", "v_field")
def material_summary(spark, d):
    s = rn.material_summary(v.fields(spark, d), volume="peak")
    return s.select("material", "n_images_total", "n_images_clean", "n_gels", r("mean_nuclei_per_mm2_all").alias("mean_all"), r("sd_nuclei_per_mm2_all").alias("sd_all"),
                    r("mean_nuclei_per_mm2_clean").alias("mean_clean"), r("gel_mean_nuclei_per_mm2").alias("gel_mean"), r("gel_sd_nuclei_per_mm2").alias("gel_sd"),
                    r("median_nuclear_volume_um3").alias("med_volume"))


@query("material_tests_a9")
def material_tests(spark, d):
    s = summarise_materials(v.fields(spark, d), control="M0")
    return s.select("material", "n_gels", r("p_raw").alias("p_raw"), r("p_adj").alias("p_adj"), r("min_achievable_p").alias("min_p"), "statistical_note", "significance")


@query("field_rollup_a10", """SELECT image_id, n_nuclei, n_nuclei_total, n_nuclei_total - n_nuclei AS n_border_excluded, round(CASE WHEN a > 0 THEN n_nuclei / (a * 1e-6) END, 4) AS nuclei_per_mm2, round(mv, 3) AS median_volume
  FROM (SELECT image_id, count(*) FILTER (WHERE plane <> 0) AS n_nuclei, count(*) AS n_nuclei_total, max(perimeter_px) * 1000.0 AS a, median(volume_sphere_um3) AS mv FROM v_measured GROUP BY 1)""", "v_measured")
def field_rollup(spark, d):
    o = v.measured(spark, d).withColumn("out", F.col("plane") == 0)
    f = o.groupBy("image_id").agg((F.max("perimeter_px") * 1000.0).alias("area"))
    s = rn.image_rollup(o, f, volume="volume_sphere_um3", excluded="out", area="area")
    return s.select("image_id", "n_nuclei", "n_nuclei_total", "n_border_excluded", r("nuclei_per_mm2", 4).alias("nuclei_per_mm2"), r("median_nuclear_volume_um3", 3).alias("median_volume"))


@query("field_counts_a11", """SELECT image_id, count(*) AS n_objects, count(*) FILTER (WHERE volume_sphere_um3 < 60000) AS debris_count, count(*) FILTER (WHERE volume_sphere_um3 > 700000) AS merged_count,
  round(count(*) FILTER (WHERE centroid_y <= 30) / greatest(1, count(*)), 6) AS edge_frac FROM v_measured GROUP BY image_id""", "v_measured")
def field_counts(spark, d):
    c = rn.field_counts(v.measured(spark, d), ["image_id"], F.col("volume_sphere_um3"), F.col("centroid_y") <= 30, 60000.0, 700000.0)
    return c.select("image_id", "n_objects", "debris_count", "merged_count", r("edge_touching_frac").alias("edge_frac"))


@query("ablation_rows_a13", _ARM + """ SELECT run, image_id, material, replicate, regexp_extract(run, 'PP\\d\\d') AS arm, 'full' AS scope, n_nuclei FROM a WHERE run LIKE '%PP%' UNION ALL
  SELECT run, concat('SUMMARY_', material), material, 'ALL', regexp_extract(run, 'PP\\d\\d'), 'full', count(*) FROM a WHERE run LIKE '%PP%' GROUP BY run, material""", "v_field")
def ablation_rows(spark, d):
    a = armed(spark, d)
    rows = rn.ablation_rows(a.select("run", "image_id", "material", "replicate", "flag_any", "flag_summary"), a.select("run", "image_id", "material", "replicate", "n_nuclei", "nuclei_per_mm2", "peak"))
    s = rn.ablation_summary(rows, "n_nuclei", "n_nuclei", "nuclei_per_mm2", "peak", "flag_any", "flag_summary")
    s = s.select("run", "image_id", "material", F.lit("ALL").alias("replicate"), "arm", "scope", F.col("n_images").alias("n_nuclei"))
    return rows.select(*s.columns).unionByName(s)


@query("ablation_summary_a13", _ARM + """ SELECT run, material, round(avg(n_nuclei), 6) AS mean_final, round(avg(nuclei_per_mm2), 6) AS mean_density, round(stddev_samp(nuclei_per_mm2), 6) AS sd_density, bool_or(flag_any) AS flag_any, round(avg(flag_any::INT), 6) AS flag_rate,
  count(*) AS n_images, string_agg(DISTINCT flag_summary, ';' ORDER BY flag_summary) AS flags_list FROM a WHERE run LIKE '%PP%' GROUP BY run, material""", "v_field")
def ablation_summary(spark, d):
    a = armed(spark, d)
    rows = rn.ablation_rows(a.select("run", "image_id", "material", "replicate", "flag_any", "flag_summary"), a.select("run", "image_id", "material", "replicate", "n_nuclei", "nuclei_per_mm2", "peak"))
    s = rn.ablation_summary(rows, "n_nuclei", "n_nuclei", "nuclei_per_mm2", "peak", "flag_any", "flag_summary")
    return s.select("run", "material", r("mean_final").alias("mean_final"), r("mean_density").alias("mean_density"), r("sd_density").alias("sd_density"), "flag_any", r("flag_rate").alias("flag_rate"), "n_images", "flags_list")


_PIVOT = ", ".join(f"round(avg(nuclei_per_mm2) FILTER (WHERE run = '{a}'), 6) AS density_mean_{n}, round(stddev_samp(nuclei_per_mm2) FILTER (WHERE run = '{a}'), 6) AS density_sd_{n}, round(avg(n_nuclei) FILTER (WHERE run = '{a}'), 6) AS mean_count_{n}"
                   for n, a in (("PP00", "401_PP00_none"), ("PP11", "404_PP11_full")))


@query("ablation_pivot_a13", _ARM + f" SELECT 'full' AS scope, material, count(DISTINCT image_id) AS n_images, {_PIVOT} FROM a WHERE run LIKE '%PP%' GROUP BY material", "v_field")
def ablation_pivot(spark, d):
    a = armed(spark, d)
    rows = rn.ablation_rows(a.select("run", "image_id", "material", "replicate", "flag_any", "flag_summary"), a.select("run", "image_id", "material", "replicate", "n_nuclei", "nuclei_per_mm2", "peak"))
    runs = {"401_PP00_none": "PP00", "404_PP11_full": "PP11"}
    p = rn.ablation_pivot(rows, list(runs), "nuclei_per_mm2", "n_nuclei")
    return p.select("scope", "material", "n_images", *[r(F.col(f"`{run}_{c}`")).alias(f"{c}_{n}") for run, n in runs.items() for c in ("density_mean", "density_sd", "mean_count")])


_T14 = " UNION ALL ".join(f"SELECT '{n}' AS effect, round({e}, 6) AS value FROM m" for n, e in
                          [(f"mean_count_{a}", f"c{a}") for a in ("PP00", "PP10", "PP01", "PP11")] + [(f"flag_pct_{a}", f"f{a}") for a in ("PP00", "PP10", "PP01", "PP11")] + [
                              ("effect_pre_count", "cPP10 - cPP00"), ("effect_post_count", "cPP01 - cPP00"), ("effect_both_count", "cPP11 - cPP00"), ("interaction_count", "(cPP11 - cPP01) - (cPP10 - cPP00)"),
                              ("effect_pre_flag_pct", "fPP10 - fPP00"), ("effect_post_flag_pct", "fPP01 - fPP00"), ("effect_both_flag_pct", "fPP11 - fPP00")])


@query("factorial_effects_a14", _ARM + ", m AS (SELECT " + ", ".join(f"avg(n_nuclei) FILTER (WHERE run LIKE '%{a}%') AS c{a}, 100.0::DOUBLE * avg(flag_any::INT) FILTER (WHERE run LIKE '%{a}%') AS f{a}" for a in ("PP00", "PP10", "PP01", "PP11")) + " FROM a) " + _T14, "v_field")
def factorial_effects(spark, d):
    from replistat.functions.labels import ablation_arm
    e = rn.factorial_effects(armed(spark, d).withColumn("arm", ablation_arm("run")), "arm", "n_nuclei", "flag_any")
    return e.select("effect", r("value").alias("value"))


@query("arm_conflicts_a14", _ARM + " SELECT 'full' AS scope, regexp_extract(run, 'PP\\d\\d') AS arm, count(*) AS n_runs FROM (SELECT DISTINCT CASE WHEN replicate = 'Gel1' THEN concat('9', run) ELSE run END AS run FROM a) WHERE run LIKE '%PP%' GROUP BY 1, 2 HAVING count(*) > 1", "v_field")
def arm_conflicts(spark, d):
    a = armed(spark, d).withColumn("run", F.when(F.col("replicate") == "Gel1", F.concat(F.lit("9"), "run")).otherwise(F.col("run")))
    return rn.arm_conflicts(a)


@query("family_robustness_a15", """WITH f AS (SELECT * FROM v_field WHERE run <> 'view'), k AS (SELECT image_id, arg_min(material, run) AS material, CASE WHEN avg(n_nuclei) FILTER (WHERE a) > 1e-9 THEN stddev_samp(n_nuclei) FILTER (WHERE a) / avg(n_nuclei) FILTER (WHERE a) END AS ac,
    CASE WHEN avg(n_nuclei) FILTER (WHERE NOT a) > 1e-9 THEN stddev_samp(n_nuclei) FILTER (WHERE NOT a) / avg(n_nuclei) FILTER (WHERE NOT a) END AS bc FROM (SELECT *, run IN ('click', 'error') AS a FROM f) GROUP BY 1 HAVING count(DISTINCT run) = 4)
  SELECT coalesce(material, 'ALL_COHORT') AS material, count(*) AS n_images, round(avg(ac), 3) AS a_mean, round(max(ac), 3) AS a_max, round(avg(bc), 3) AS b_mean, round(100.0 * (avg(ac) - avg(bc)) / avg(ac), 1) AS cut FROM k GROUP BY ROLLUP (material)""", "v_field")
def family_robustness(spark, d):
    s = rn.robustness(rn.family_spread(v.fields(spark, d), ["click", "error"], ["purchase", "signup"]))
    return s.select("material", "n_images", F.col("orig_mean_count_spread").alias("a_mean"), F.col("orig_max_count_spread").alias("a_max"), F.col("pp_mean_count_spread").alias("b_mean"),
                    F.col("spread_reduction_mean_pct").alias("cut"))


@query("metrics_by_run_a16", "SELECT material, " + ", ".join(f"round(avg(nuclei_per_mm2) FILTER (WHERE run = '{x}'), 6) AS {x}_density, max(n_nuclei) FILTER (WHERE run = '{x}') AS {x}_top" for x in RUNS) + " FROM v_field GROUP BY material", "v_field")
def metrics_by_run(spark, d):
    s = v.fields(spark, d).groupBy("run", "material").agg(F.avg("nuclei_per_mm2").alias("m"), F.max("n_nuclei").alias("t"))
    return rn.metrics_by_run(s, RUNS, {"density": F.round("m", 6), "top": F.col("t")})


_DELTA = """WITH g AS (SELECT image_id, arg_min(material, run) AS material, count(*) AS n, max(n_nuclei) - min(n_nuclei) AS cs, CASE WHEN count(*) >= 2 THEN round_even(max(round_even(nuclei_per_mm2, 12)) - min(round_even(nuclei_per_mm2, 12)), 2) END AS ds,
  coalesce(string_agg(CASE WHEN flag_summary <> 'clean' THEN concat(run, ':', flag_summary) END, '; ' ORDER BY run), 'clean') AS active_flags,
  array_to_string(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda x: NOT list_contains(list(run), x)), ';') AS missing_in_runs FROM v_field GROUP BY image_id)"""


@query("image_deltas_a17", _DELTA + " SELECT image_id, material, n AS n_runs_present, CASE WHEN n >= 2 THEN cs END::DOUBLE AS count_spread, active_flags, missing_in_runs, CASE WHEN n >= 2 THEN row_number() OVER (ORDER BY n < 2, cs DESC, image_id) END AS rank FROM g", "v_field")
def image_deltas(spark, d):
    s = rn.image_deltas(v.fields(spark, d), RUNS)
    return s.select("image_id", "material", "n_runs_present", F.col("count_spread").cast("double").alias("count_spread"), "active_flags", "missing_in_runs", "rank")


@query("disagreement_rank_w4", _DELTA + " SELECT image_id, row_number() OVER (ORDER BY cs DESC, image_id) AS rank FROM g WHERE n >= 2", "v_field")
def disagreement_rank(spark, d):
    g = v.fields(spark, d).groupBy("image_id").agg(F.count(F.lit(1)).alias("n_runs_present"), (F.max("n_nuclei") - F.min("n_nuclei")).alias("count_spread"))
    return rn.disagreement_rank(g, "image_id").filter("rank is not null").select("image_id", "rank")


@query("run_totals_a18", """WITH t AS (SELECT run, count(*) AS n_fields, avg(n_nuclei) AS mc, avg(nuclei_per_mm2) AS md, 100.0 * avg(flag_any::INT) AS pf FROM v_field GROUP BY 1)
  SELECT run, n_fields, round(mc, 6) AS mean_count, round(md, 6) AS mean_density, round(pf, 6) AS pct_flagged, mc = max(mc) OVER () AS is_highest, mc = min(mc) OVER () AS is_lowest FROM t""", "v_field")
def run_totals(spark, d):
    t = rn.run_totals(v.fields(spark, d))
    return t.select("run", "n_fields", r("mean_count").alias("mean_count"), r("mean_density").alias("mean_density"), r("pct_flagged").alias("pct_flagged"), "is_highest", "is_lowest")


@query("spread_by_material_a18", _DELTA + " SELECT material, count(*) AS n_images, round(avg(cs), 6) AS mean_spread, max(cs)::DOUBLE AS max_spread FROM g WHERE n >= 2 GROUP BY material", "v_field")
def spread_by_material(spark, d):
    s = rn.spread_by_material(rn.image_deltas(v.fields(spark, d), RUNS))
    return s.select("material", "n_images", r("mean_spread").alias("mean_spread"), F.col("max_spread").cast("double").alias("max_spread"))


@query("identical_runs_a19", """WITH f AS (SELECT * FROM v_field UNION ALL SELECT * REPLACE ('copy' AS run) FROM v_field WHERE run = 'view'), s AS (SELECT run, count(*) AS n FROM f GROUP BY 1)
  SELECT a.run AS run_a, b.run AS run_b, count(*) AS n_common, bool_and(a.n_nuclei = b.n_nuclei AND abs(a.nuclei_per_mm2 - b.nuclei_per_mm2) <= 1e-8 + 1e-5 * abs(b.nuclei_per_mm2)) AND count(*) = any_value(sa.n) AND count(*) = any_value(sb.n) AS identical
  FROM f a JOIN f b ON a.image_id = b.image_id AND a.run < b.run JOIN s sa ON sa.run = a.run JOIN s sb ON sb.run = b.run GROUP BY 1, 2""", "v_field")
def identical_runs(spark, d):
    f = v.fields(spark, d)
    return rn.identical_runs(f.unionByName(f.filter("run = 'view'").withColumn("run", F.lit("copy"))))


@query("worst_fields_w5", """SELECT doc, severity FROM (SELECT run || image_id AS doc, (peak > 100)::BIGINT + (low < 2)::BIGINT AS severity FROM v_field) WHERE severity > 0 ORDER BY severity DESC, doc LIMIT 5""", "v_field")
def worst_fields(spark, d):
    f = v.fields(spark, d).withColumn("flags", F.concat_ws(";", F.when(F.col("peak") > 100, "saturated"), F.lit("density_outlier"), F.when(F.col("low") < 2, "low_snr")))
    s = f.select(F.concat("run", "image_id").alias("doc"), flag_severity("flags").alias("severity")).filter("severity > 0")
    return s.orderBy(F.desc("severity"), "doc").limit(5)


@query("detail_and_summary_x4", "SELECT run, image_id, n_nuclei FROM v_field UNION ALL SELECT run, 'ALL', CAST(sum(n_nuclei) AS BIGINT) FROM v_field GROUP BY run", "v_field")
def detail_and_summary(spark, d):
    f = v.fields(spark, d).select("run", "image_id", "n_nuclei")
    return f.unionByName(f.groupBy("run").agg(big(F.sum("n_nuclei")).alias("n_nuclei")).withColumn("image_id", F.lit("ALL")))
