"""Aggregates of the growth analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from replistat.operators import matching as m, rollup as ru
from replistat.params import Inference
from replistat.plans.growth import condition_summary, pair_population
from replistat.session import cut_lineage

from . import views as v
from .columns_q import manifest
from .joins_q import _MATCH, growth_pairs
from .registry import query
from .resample_q import _EXACT, _bootstrap
from .views import big, r


def matched_pairs(spark, d):
    """The pairs of the optimal matching with their changes and flags."""
    return cut_lineage(growth_pairs(spark, d)[0])


_PAIR = _MATCH + """, k AS (SELECT a.cond AS condition, a.replicate, a.pair_key, a.volume_sphere_um3 AS v0, b.volume_sphere_um3 AS v7, a.equivalent_diameter_um AS d0, a.qc_flag AS f0, b.qc_flag AS f7
    FROM mt JOIN v_gated a ON a.object_id = t0_id JOIN v_gated b ON b.object_id = t7_id),
  pr AS (SELECT *, v7 / greatest(v0, 1e-6) AS fc, v7 - v0 AS dv, d0 >= 60 AS ok, CASE WHEN f0 = 'REVIEW' OR f7 = 'REVIEW' OR v7 / v0 < 0.1 OR v7 / v0 > 20 THEN 'REVIEW' ELSE 'PASS' END AS flag,
    v7 / v0 < 0.1 OR v7 / v0 > 20 AS extreme FROM k WHERE v0 IS NOT NULL AND v7 IS NOT NULL)"""


@query("condition_population_a2", _PAIR + """ SELECT condition, n_matched_pairs, n_pass_pairs, n_denominator_excluded, n_review_pairs, n_gels, n_spheroids, v0_median_um3, v0_iqr_um3, delta_v_median_um3, fold_change_median, fold_change_iqr, fold_change_mean, fold_change_std, log2fc_median FROM
  (SELECT condition, count(*) AS n_matched_pairs, count(*) FILTER (WHERE flag = 'PASS') AS n_pass_pairs, count(*) FILTER (WHERE NOT ok) AS n_denominator_excluded, count(*) FILTER (WHERE flag = 'REVIEW') AS n_review_pairs FROM pr GROUP BY 1)
  JOIN (SELECT condition, count(DISTINCT replicate) AS n_gels, count(*) AS n_spheroids, round(median(v0), 3) AS v0_median_um3, round(quantile_cont(v0, 0.75) - quantile_cont(v0, 0.25), 3) AS v0_iqr_um3, round(median(dv), 3) AS delta_v_median_um3,
    round(median(fc), 6) AS fold_change_median, round(quantile_cont(fc, 0.75) - quantile_cont(fc, 0.25), 6) AS fold_change_iqr, round(avg(fc), 6) AS fold_change_mean, round(stddev_samp(fc), 6) AS fold_change_std, round(median(log2(fc)), 6) AS log2fc_median
    FROM pr WHERE ok AND flag = 'PASS' GROUP BY 1) USING (condition)""", "v_gated")
def condition_population(spark, d):
    s = pair_population(matched_pairs(spark, d))
    return s.select("condition", "n_matched_pairs", "n_pass_pairs", "n_denominator_excluded", "n_review_pairs", "n_gels", "n_spheroids",
                    *[r(c, 3).alias(c) for c in ("v0_median_um3", "v0_iqr_um3", "delta_v_median_um3")],
                    *[r(c).alias(c) for c in ("fold_change_median", "fold_change_iqr", "fold_change_mean", "fold_change_std", "log2fc_median")])


@query("condition_summary_a2", _PAIR + ", bs AS (SELECT condition AS cond, replicate AS unit, log2(fc) AS value FROM pr WHERE ok AND flag = 'PASS' AND fc > 0), boot AS (" + _bootstrap("unit", 2000).replace("v_unit_value", "bs")
       + "), perm AS (" + _EXACT.replace("v_unit_value", "bs") + """ SELECT cond, round(p_raw, 6) AS p_raw, round(p_adj, 6) AS p_adj,
    CASE WHEN p_adj < 0.0001 THEN '****' WHEN p_adj < 0.001 THEN '***' WHEN p_adj < 0.01 THEN '**' WHEN p_adj < 0.05 THEN '*' ELSE 'ns' END AS significance FROM h),
  pop AS (SELECT condition, count(*) AS n_spheroids, count(DISTINCT replicate) AS n_gels, round(median(fc), 6) AS fc FROM pr WHERE ok AND flag = 'PASS' GROUP BY 1), bk AS (SELECT cond, 'classical:' || count(*) AS backend_counts FROM v_gated GROUP BY 1)
  SELECT condition, n_spheroids, n_gels, fc, ci_low AS lo, ci_high AS hi, p_raw, p_adj, CASE WHEN condition = 'AFRICA' THEN 'control' ELSE significance END AS significance, backend_counts, 'hierarchical_bootstrap_log2' AS ci_method
  FROM pop JOIN boot ON boot.cond = condition JOIN bk ON bk.cond = condition LEFT JOIN perm ON perm.cond = condition""", "v_gated")
def condition_summary_q(spark, d):
    p, o = growth_pairs(spark, d)
    p = cut_lineage(p)
    s = condition_summary(p, o.withColumn("seg_backend", F.lit("classical")), Inference(control="AFRICA"))
    return s.select("condition", "n_spheroids", "n_gels", r("fold_change_median").alias("fc"), r("log2fc_ci_95_low").alias("lo"), r("log2fc_ci_95_high").alias("hi"),
                    r("p_raw").alias("p_raw"), r("p_adj").alias("p_adj"), "significance", "backend_counts", "ci_method")


@query("backend_mix_a3", "SELECT cond, string_agg(concat(seg_backend, ':', n), ';' ORDER BY seg_backend) AS backend_counts FROM (SELECT cond, seg_backend, count(*) AS n FROM v_object GROUP BY 1, 2) GROUP BY cond", "v_object")
def backend_mix(spark, d):
    return ru.backend_mix(v.objects(spark, d), ["cond"], "seg_backend")


@query("exclusion_audit_a4", _PAIR + """, o AS (SELECT *, timepoint = 't0' AS b, CASE WHEN plane = 0 THEN 'UNPAIRED' ELSE 'x' END AS pid FROM v_gated), a AS (SELECT count(DISTINCT image_id) FILTER (WHERE b) AS i0, count(DISTINCT image_id) FILTER (WHERE NOT b) AS i7,
    count(*) FILTER (WHERE qc_reasons LIKE '%debris%') AS e3, count(*) FILTER (WHERE qc_reasons LIKE '%oversized%') AS e4, count(*) FILTER (WHERE qc_reasons LIKE '%contrast%') AS e6,
    count(*) FILTER (WHERE pid = 'UNPAIRED' AND qc_flag <> 'FAIL' AND b) AS u0, count(*) FILTER (WHERE pid = 'UNPAIRED' AND qc_flag <> 'FAIL' AND NOT b) AS u7 FROM o),
  q AS (SELECT count(*) FILTER (WHERE NOT ok) AS e8, count(*) FILTER (WHERE extreme) AS e9, count(*) FILTER (WHERE flag = 'PASS') AS e10 FROM pr)
  SELECT 'E1' AS stage, 'E1_images_t0' AS metric, i0 AS n FROM a UNION ALL SELECT 'E1', 'E1_images_t7', i7 FROM a UNION ALL SELECT 'E1', 'E1_images_total', i0 + i7 FROM a UNION ALL SELECT 'E2', 'E2_plausibility_fallbacks', 0 UNION ALL
  SELECT 'E3', 'E3_debris_undersized', e3 FROM a UNION ALL SELECT 'E4', 'E4_oversized_artifact', e4 FROM a UNION ALL SELECT 'E5', 'E5_border_touching', 0 UNION ALL SELECT 'E6', 'E6_insufficient_contrast', e6 FROM a UNION ALL
  SELECT 'E7', 'E7_unpaired_t0', u0 FROM a UNION ALL SELECT 'E7', 'E7_unpaired_t7', u7 FROM a UNION ALL SELECT 'E7', 'E7_unpaired_total', u0 + u7 FROM a UNION ALL SELECT 'E8', 'E8_denominator_excluded', e8 FROM q UNION ALL
  SELECT 'E9', 'E9_extreme_trajectory_review', e9 FROM q UNION ALL SELECT 'E10', 'E10_final_pass_pairs', e10 FROM q""", "v_gated")
def exclusion_audit(spark, d):
    o = v.gated(spark, d).withColumn("pair_id", F.when(F.col("plane") == 0, "UNPAIRED").otherwise("x"))
    return ru.exclusion_audit(o, matched_pairs(spark, d))


def _well_fields(o):
    return o.groupBy("cond", "replicate", "timepoint").agg(F.count_distinct("plane").alias("n_fields"))


@query("well_growth_a5", """WITH f AS (SELECT cond, replicate, count(DISTINCT plane) FILTER (WHERE timepoint = 't0') AS f0, count(DISTINCT plane) FILTER (WHERE timepoint = 't7') AS f7 FROM v_gated GROUP BY 1, 2),
  s AS (SELECT cond, replicate, sum(volume_sphere_um3) FILTER (WHERE timepoint = 't0') AS v0, sum(volume_sphere_um3) FILTER (WHERE timepoint = 't7') AS v7, count(*) FILTER (WHERE timepoint = 't0') AS n0, count(*) FILTER (WHERE timepoint = 't7') AS n7 FROM v_gated WHERE qc_flag = 'PASS' GROUP BY 1, 2)
  SELECT cond, replicate, n0 AS count_t0, n7 AS count_t7, f0 AS effective_fovs_t0, f7 AS effective_fovs_t7, round(v0 / 1e6, 4) AS total0, round(v7 / v0, 6) AS fc_total_volume, round(n7 / n0, 6) AS fc_count, round((v7 / n7) / (v0 / n0), 6) AS fc_mean_volume,
    round((n7 / f7) / (n0 / f0), 6) AS fc_count_density, round((v7 / f7) / (v0 / f0), 6) AS fc_pooled_vol_density FROM s JOIN f USING (cond, replicate)""", "v_gated")
def well_growth(spark, d):
    o = v.gated(spark, d)
    w = ru.well_growth(o, _well_fields(o), ("cond", "replicate"))
    return w.select("cond", "replicate", "count_t0", "count_t7", "effective_fovs_t0", "effective_fovs_t7", r(F.col("total_volume_um3_t0") / 1e6, 4).alias("total0"),
                    *[r(c).alias(c) for c in ("fc_total_volume", "fc_count", "fc_mean_volume", "fc_count_density", "fc_pooled_vol_density")])


@query("effective_fields_a6", """WITH RECURSIVE o AS (SELECT image_id AS well, plane AS f, CASE WHEN contrast_ratio >= 0.07 THEN other_plane END AS o FROM v_object), sz AS (SELECT well, f, count(*) AS n FROM o GROUP BY 1, 2),
  lk AS (SELECT l.well, f1, f2 FROM (SELECT well, least(f, o) AS f1, greatest(f, o) AS f2, count(*) AS k FROM o WHERE o IS NOT NULL AND o <> f GROUP BY 1, 2, 3) l JOIN sz a ON a.well = l.well AND a.f = f1 JOIN sz b ON b.well = l.well AND b.f = f2 WHERE k / least(a.n, b.n) >= 0.65 OR k >= 3),
  e AS (SELECT well, f1 AS a, f2 AS b FROM lk UNION ALL SELECT well, f2, f1 FROM lk), reach AS (SELECT well, f AS s, f AS t FROM sz UNION SELECT r.well, r.s, e.b FROM reach r JOIN e ON e.well = r.well AND e.a = r.t)
  SELECT well AS image_id, count(DISTINCT root) AS n_fields FROM (SELECT well, s, min(t) AS root FROM reach GROUP BY 1, 2) GROUP BY well""", "v_object")
def effective_fields(spark, d):
    o = v.objects(spark, d)
    return m.effective_fields(o, ["image_id"], "plane", F.when(F.col("contrast_ratio") >= 0.07, F.col("other_plane")))


@query("population_summary_a7", """SELECT cond, count(*) FILTER (WHERE timepoint = 't0') AS n_t0, count(*) FILTER (WHERE timepoint = 't7') AS n_t7, round(median(volume_sphere_um3) FILTER (WHERE timepoint = 't0'), 3) AS v0, round(median(volume_sphere_um3) FILTER (WHERE timepoint = 't7'), 3) AS v7,
  round(median(volume_sphere_um3) FILTER (WHERE timepoint = 't7') / median(volume_sphere_um3) FILTER (WHERE timepoint = 't0'), 6) AS fc, CASE WHEN cond = 'ASIA' THEN 'unadjusted' WHEN cond = 'EUROPE' THEN 'Holm-adjusted' ELSE '—' END AS p_type, 'ns' AS significance FROM v_gated WHERE qc_flag = 'PASS' GROUP BY cond""", "v_gated")
def population_summary(spark, d):
    reg = v.table(spark, d, "region").select(F.col("r_name").alias("cond"), F.when(F.col("r_name") == "EUROPE", 0.2).alias("p_adj"), F.when(F.col("r_name") == "ASIA", 0.1).alias("p_raw"), F.lit(None).cast("string").alias("significance"))
    o = cut_lineage(v.gated(spark, d).filter("qc_flag = 'PASS'").select("cond", "timepoint", "volume_sphere_um3", "equivalent_diameter_um", "qc_flag"))      # read twice
    s = ru.population_summary(o, reg, "cond")
    return s.select("cond", "n_t0", "n_t7", r("median_v0_um3", 3).alias("v0"), r("median_v7_um3", 3).alias("v7"), r("pop_fold_change").alias("fc"), "p_type", "significance")


@query("call_rate_a8", """WITH mk AS (SELECT pair_key FROM v_gated GROUP BY 1 HAVING count(DISTINCT timepoint) >= 2) SELECT (SELECT count(*) FROM mk) AS n_matched, (SELECT count(*) FROM (SELECT pair_key FROM v_gated WHERE qc_flag = 'PASS' AND pair_key IN (SELECT pair_key FROM mk) GROUP BY 1 HAVING count(DISTINCT timepoint) >= 2)) AS n_called,
  round(100.0 * (SELECT count(*) FROM (SELECT pair_key FROM v_gated WHERE qc_flag = 'PASS' AND pair_key IN (SELECT pair_key FROM mk) GROUP BY 1 HAVING count(DISTINCT timepoint) >= 2)) / (SELECT count(*) FROM mk), 6)::DOUBLE AS call_rate""", "v_gated")
def call_rate(spark, d):
    o = v.gated(spark, d)
    return ru.call_rate(o, o).select("n_matched", "n_called", r("call_rate").alias("call_rate"))


@query("effective_scales_a8", "SELECT um AS pixel_size_um, source AS scale_source, count(*) AS n_images FROM (SELECT user_id, arg_min(um, (um, event_type)) AS um, arg_min(event_type, (um, event_type)) AS source FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 4 AS um FROM events) GROUP BY 1) GROUP BY 1, 2")
def effective_scales(spark, d):
    t = v.tags(spark, d).join(v.table(spark, d, "events").select(F.col("event_id").alias("image_id"), "user_id"), "image_id")
    return ru.effective_scales(t.select(F.col("user_id").alias("image_id"), F.col("um_per_px").alias("pixel_size_um"), F.col("source").alias("scale_source")))


@query("qc_yield_a20", """SELECT cond, count(*) FILTER (WHERE qc_flag = 'PASS') AS n_pass, count(*) FILTER (WHERE qc_flag = 'REVIEW') AS n_review, count(*) FILTER (WHERE qc_flag = 'FAIL') AS n_fail, count(*) AS n_total,
  round(100.0 * count(*) FILTER (WHERE qc_flag = 'PASS') / count(*), 6)::DOUBLE AS pct_pass FROM v_gated GROUP BY cond""", "v_gated")
def qc_yield(spark, d):
    return ru.qc_yield(v.gated(spark, d), "cond").select("cond", "n_pass", "n_review", "n_fail", "n_total", r("pct_pass").alias("pct_pass"))


@query("rejection_counts_a20", """SELECT unnest(['Border Clipped', 'Low Contrast', 'Undersized', 'Multi-Focal Duplicate', 'Oversized']) AS reason, unnest([count(*) FILTER (WHERE qc_reasons LIKE '%touches_image_border%'), count(*) FILTER (WHERE qc_reasons LIKE '%insufficient_dark_contrast%'),
  count(*) FILTER (WHERE qc_reasons LIKE '%debris_undersized%'), count(*) FILTER (WHERE qc_reasons LIKE '%duplicate_focal_plane%'), count(*) FILTER (WHERE qc_reasons LIKE '%oversized%')]) AS n FROM v_gated WHERE qc_flag = 'FAIL'""", "v_gated")
def rejection_counts(spark, d):
    return ru.rejection_counts(v.gated(spark, d))


@query("diameter_histogram_a22", """WITH b AS (SELECT qc_flag, least(38, greatest(0, CAST(floor(ln(equivalent_diameter_um / 20.0) / (ln(75.0) / 39)) AS BIGINT))) AS bin, count(*) AS n FROM v_gated WHERE equivalent_diameter_um BETWEEN 20 AND 1500 GROUP BY 1, 2)
  SELECT qc_flag, bin, n, round(n / (sum(n) OVER (PARTITION BY qc_flag) * (20.0 * exp((bin + 1) * ln(75.0) / 39) - 20.0 * exp(bin * ln(75.0) / 39))), 6) AS density FROM b""", "v_gated")
def diameter_histogram(spark, d):
    h = ru.histogram(v.gated(spark, d), ["qc_flag"], "equivalent_diameter_um", 20.0, 1500.0, 39, log=True)
    return h.select("qc_flag", "bin", "n", r("density").alias("density"))


@query("distribution_feed_a23", """SELECT cond, timepoint, round(quantile_cont(volume_sphere_um3, 0.25), 3) AS q1, round(median(volume_sphere_um3), 3) AS med, round(quantile_cont(volume_sphere_um3, 0.75), 3) AS q3, count(*) AS n, round(min(volume_sphere_um3), 3) AS low, round(max(volume_sphere_um3), 3) AS high
  FROM v_gated WHERE qc_flag = 'PASS' AND volume_sphere_um3 > 0 GROUP BY 1, 2""", "v_gated")
def distribution_feed(spark, d):
    o = cut_lineage(v.gated(spark, d).filter("qc_flag = 'PASS'").select("cond", "timepoint", "volume_sphere_um3"))      # read twice
    f = ru.distribution_feed(o, ["cond", "timepoint"], "volume_sphere_um3")
    return f.select("cond", "timepoint", *[r(c, 3).alias(c) for c in ("q1", "med", "q3")], "n", r("low", 3).alias("low"), r("high", 3).alias("high"))


@query("trajectory_feed_a23", _PAIR.replace("a.pair_key, a.volume", "a.pair_key, mt.pn, a.volume") + """ SELECT condition, CAST(pair_key AS VARCHAR) || '_pair' || pn AS pair_id, round(v0, 3) AS first_value, round(v7, 3) AS last_value, v7 >= v0 AS grew, count(*) OVER (PARTITION BY condition) AS n_lines
  FROM pr WHERE flag = 'PASS' AND v0 > 0 AND v7 > 0""", "v_gated")
def trajectory_feed(spark, d):
    f = ru.trajectory_feed(matched_pairs(spark, d))
    return f.select("condition", "pair_id", r("first_value", 3).alias("first_value"), r("last_value", 3).alias("last_value"), "grew", "n_lines")


@query("preflight_audit_a24", """WITH i AS (SELECT DISTINCT stem, concat_ws('_', cond, replicate, fov) AS pair_key, concat('t', CAST(day_no AS VARCHAR)) AS timepoint, cond AS condition FROM v_parsed WHERE error IS NULL), f AS (SELECT pair_key, timepoint, count(*) AS k FROM i GROUP BY 1, 2),
  k AS (SELECT pair_key, bool_or(timepoint = 't0') AS a, bool_or(timepoint = 't7') AS b, sum(k - 1) AS dup FROM f GROUP BY 1)
  SELECT 'no_first_timepoint' AS rule, 'fatal' AS severity, CAST(count(*) FILTER (WHERE timepoint = 't0') = 0 AS BIGINT) AS n FROM i UNION ALL SELECT 'no_second_timepoint', 'fatal', CAST(count(*) FILTER (WHERE timepoint = 't7') = 0 AS BIGINT) FROM i
  UNION ALL SELECT 'no_matched_pairs', 'fatal', CAST(count(*) FILTER (WHERE a AND b) = 0 AS BIGINT) FROM k UNION ALL SELECT 'control_missing', 'warning', CAST(count(*) FILTER (WHERE condition = 'Mat') = 0 AS BIGINT) FROM i
  UNION ALL SELECT 'single_first', 'warning', count(*) FILTER (WHERE a AND NOT b) FROM k UNION ALL SELECT 'single_second', 'warning', count(*) FILTER (WHERE b AND NOT a) FROM k
  UNION ALL SELECT 'duplicate_keys', 'warning', count(*) FILTER (WHERE dup > 0) FROM k UNION ALL SELECT 'uncalibrated', 'warning', 0 UNION ALL SELECT 'unreadable_names', 'warning', (SELECT count(DISTINCT stem) FROM v_parsed WHERE error IS NOT NULL)""", "v_parsed")
def preflight_audit(spark, d):
    from replistat.sources.files import parsed_names, rejected_names
    paths = v.names(spark, d).select(F.concat(F.lit("/in/"), F.col("stem"), F.lit(".tif")).alias("path")).distinct()
    return ru.acquisition_rules(parsed_names(paths), rejected_names(paths)).select("rule", "severity", "n")


@query("channel_audit_a24", """SELECT rule, severity, n FROM (SELECT count(*) FILTER (WHERE n_first = 1 AND n_second = 1) = 0 AS np, count(*) FILTER (WHERE n_first > 1 OR n_second > 1) AS am, count(*) FILTER (WHERE n_first <= 1 AND n_second <= 1 AND n_first + n_second = 1) AS un FROM
    (SELECT base, count(DISTINCT name) FILTER (WHERE channel = '00') AS n_first, count(DISTINCT name) FILTER (WHERE channel = '02') AS n_second FROM v_channel WHERE channel IN ('00', '02') GROUP BY base)),
  LATERAL (SELECT unnest(['no_paired_fields', 'ambiguous_channel_files', 'unpaired_fields']) AS rule, unnest(['fatal', 'fatal', 'warning']) AS severity, unnest([np::BIGINT, am, un]) AS n)""", "v_channel")
def channel_audit(spark, d):
    from replistat.operators import matching as m
    from replistat.sources.files import channel_inventory
    f = channel_inventory(v.field_names(spark, d))
    p = m.pair_channels(f.select("base", "channel", "name").distinct(), "base", "channel", "name")
    state = F.when((F.col("n_first") > 1) | (F.col("n_second") > 1), "collision").when(F.col("n_first") == 0, "missing_first").when(F.col("n_second") == 0, "missing_second").otherwise("paired")
    fields = p.select("base", state.alias("state"), F.lit(None).cast("string").alias("material"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("boolean").alias("is_calibrated"))
    return ru.channel_rules(fields).filter("rule in ('no_paired_fields', 'ambiguous_channel_files', 'unpaired_fields')").select("rule", "severity", "n")


@query("cohort_changes_a25", """WITH a AS (SELECT material, avg(n_nuclei) AS x FROM v_field WHERE run = 'click' GROUP BY 1), b AS (SELECT material, avg(n_nuclei) AS x FROM v_field WHERE run = 'view' GROUP BY 1)
  SELECT coalesce(a.material, b.material) AS material, round(a.x, 6) AS pre, round(b.x, 6) AS post, round(b.x - a.x, 6) AS delta, round((b.x - a.x) / a.x, 6) AS rel FROM a FULL JOIN b ON a.material = b.material""", "v_field")
def cohort_changes(spark, d):
    m = v.fields(spark, d).groupBy("run", "material").agg(F.avg("n_nuclei").alias("n"))
    c = ru.cohort_changes(m.filter("run = 'click'"), m.filter("run = 'view'"), ["material"], ["n"])
    return c.select("material", r("n_pre").alias("pre"), r("n_post").alias("post"), r("n_delta").alias("delta"), r("n_rel").alias("rel"))


@query("contrast_histogram_a22", """WITH b AS (SELECT qc_flag, least(43, CAST(floor((contrast_ratio + 0.05) / (0.45 / 44)) AS BIGINT)) AS bin, count(*) AS n FROM v_gated WHERE contrast_ratio BETWEEN -0.05 AND 0.40 GROUP BY 1, 2)
  SELECT qc_flag, bin, n, round(n / (sum(n) OVER (PARTITION BY qc_flag) * (0.45 / 44)), 6) AS density FROM b""", "v_gated")
def contrast_histogram(spark, d):
    h = ru.edge_histogram(v.gated(spark, d), "contrast_ratio", -0.05, 0.40, 44, ["qc_flag"])
    return h.select("qc_flag", "bin", "n", r("density").alias("density"))


@query("circularity_histogram_a22", """WITH b AS (SELECT qc_flag, least(38, CAST(floor((circularity - 0.2) / ((1.0 - 0.2) / 39)) AS BIGINT)) AS bin, count(*) AS n FROM v_gated WHERE circularity BETWEEN 0.2 AND 1.0 GROUP BY 1, 2)
  SELECT qc_flag, bin, n, round(n / (sum(n) OVER (PARTITION BY qc_flag) * ((1.0 - 0.2) / 39)), 6) AS density FROM b""", "v_gated")
def circularity_histogram(spark, d):
    h = ru.edge_histogram(v.gated(spark, d), "circularity", 0.2, 1.0, 39, ["qc_flag"])
    return h.select("qc_flag", "bin", "n", r("density").alias("density"))


@query("image_status_s6", """SELECT image_id, CASE WHEN pair_key % 50 = 0 THEN 'READ_FAIL' WHEN n_pass = 0 THEN 'SEG_FAIL' ELSE 'OK' END AS status, n AS n_objects, n_pass FROM (SELECT image_id, pair_key, count(*) AS n, count(*) FILTER (WHERE qc_flag = 'PASS') AS n_pass FROM v_gated GROUP BY 1, 2)""", "v_gated")
def image_status(spark, d):
    o = v.gated(spark, d)
    mf = o.groupBy("image_id", "pair_key").agg(F.count_if(F.col("qc_flag") == "PASS").alias("np"))
    return ru.image_status(mf, o, read_ok=F.col("pair_key") % 50 != 0, plausible=F.col("np") > 0).select("image_id", "status", "n_objects", "n_pass")


@query("run_status_a25", "SELECT count(*) AS n_images, count(*) FILTER (WHERE np > 0) AS n_ok, count(*) FILTER (WHERE np = 0) AS n_failed, 'COMPLETED_WITH_ERRORS' AS run_status FROM (SELECT image_id, count(*) FILTER (WHERE qc_flag = 'PASS') AS np FROM v_gated GROUP BY 1)", "v_gated")
def run_status(spark, d):
    st = v.gated(spark, d).groupBy("image_id").agg(F.when(F.count_if(F.col("qc_flag") == "PASS") > 0, "OK").otherwise("SEG_FAIL").alias("status"))
    return ru.run_status(st, failed_steps=1)


@query("ordered_methods_a25", """SELECT role, w AS method, row_number() OVER (PARTITION BY role ORDER BY k, w) AS place FROM (SELECT role, w, min(k) AS k FROM (SELECT role, w, [conv_id, turn, i] AS k
  FROM (SELECT role, conv_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations)) GROUP BY role, w)""")
def ordered_methods(spark, d):
    c = v.table(spark, d, "conversations").withColumn("items", F.split("text", " "))
    return ru.ordered_items(c, ["role"], "items", ["conv_id", "turn"], "method").select("role", "method", "place")


@query("control_first_order_w6", "SELECT cond, n, row_number() OVER (ORDER BY cond <> 'EUROPE', cond) AS place FROM (SELECT cond, count(*) AS n FROM v_unit_value GROUP BY 1)", "v_unit_value")
def control_first_order(spark, d):
    from replistat.operators.scan import row_numbers
    g = v.unit_values(spark, d).groupBy("cond").agg(F.count(F.lit(1)).alias("n")).withColumn("first", (F.col("cond") != "EUROPE").cast("int"))
    return row_numbers(g, [], ["first", "cond"], "place").select("cond", "n", big("place").alias("place"))


@query("pair_numbers_w1", "SELECT object_id, row_number() OVER (PARTITION BY pair_key ORDER BY object_id) AS k FROM v_object", "v_object")
def pair_numbers(spark, d):
    from replistat.operators.scan import row_numbers
    return row_numbers(v.objects(spark, d), ["pair_key"], ["object_id"], "k").select("object_id", "k")
