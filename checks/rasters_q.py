"""Raster operators over the pixel view."""

from __future__ import annotations

from pyspark.sql import functions as F

from replistat.operators import raster as ra

from . import views as v
from .registry import query
from .views import r

_SHAPED = "sh AS (SELECT *, max(y) OVER (PARTITION BY image_id) AS h FROM v_grey)"


def bright(spark, d):
    return v.grey(spark, d).filter("value >= 140")


@query("zonal_statistics_h1", """WITH s AS (SELECT image_id, CASE WHEN value >= 140 THEN 1 ELSE 2 END::BIGINT AS label, count(*) AS area_px, avg(y) AS cy, avg(x) AS cx, min(y) AS min_row, min(x) AS min_col, max(y) + 1 AS max_row, max(x) + 1 AS max_col, avg(value) AS mv, sum(value) AS sv,
    var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c FROM v_grey GROUP BY 1, 2)
  SELECT image_id, label, area_px, round(cy, 6) AS centroid_y, round(cx, 6) AS centroid_x, min_row, min_col, max_row, max_col, round(mv, 6) AS mean_value, round(sv, 3) AS sum_value, round(4 * sqrt((vx + vy) / 2 + sqrt(((vx - vy) / 2) ** 2 + c * c)), 6) AS major_axis_px,
    round(4 * sqrt((vx + vy) / 2 - sqrt(((vx - vy) / 2) ** 2 + c * c)), 6) AS minor_axis_px, round(sqrt(1 - ((vx + vy) / 2 - sqrt(((vx - vy) / 2) ** 2 + c * c)) / ((vx + vy) / 2 + sqrt(((vx - vy) / 2) ** 2 + c * c))), 6) AS eccentricity FROM s""", "v_grey")
def zonal_statistics(spark, d):
    z = ra.zonal_statistics(v.grey(spark, d).withColumn("label", F.when(F.col("value") >= 140, 1).otherwise(2).cast("bigint")))
    return z.select("image_id", "label", "area_px", r("centroid_y").alias("centroid_y"), r("centroid_x").alias("centroid_x"), "min_row", "min_col", "max_row", "max_col", r("mean_value").alias("mean_value"),
                    r("sum_value", 3).alias("sum_value"), r("major_axis_px").alias("major_axis_px"), r("minor_axis_px").alias("minor_axis_px"), r("eccentricity").alias("eccentricity"))


@query("perimeters_h2", """WITH p AS (SELECT image_id, y, x FROM v_grey WHERE value >= 140), b AS (SELECT p.* FROM p LEFT JOIN p q ON q.image_id = p.image_id AND abs(q.y - p.y) + abs(q.x - p.x) = 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 GROUP BY ALL HAVING count(q.y) < 4),
  st AS (SELECT i - 1 AS dy, j - 1 AS dx, [1, 2, 10][abs(i - 1) + abs(j - 1) + 1] AS w FROM range(3) a(i), range(3) c(j)), k AS (SELECT image_id, y + dy AS y, x + dx AS x, sum(w) AS c FROM b, st GROUP BY 1, 2, 3)
  SELECT image_id, round(count(*) FILTER (c IN (5, 7, 15, 17, 25, 27)) + count(*) FILTER (c IN (21, 33)) * sqrt(2) + count(*) FILTER (c IN (13, 23)) * (1 + sqrt(2)) / 2, 6) AS perimeter_px FROM k GROUP BY 1""", "v_grey")
def perimeters(spark, d):
    return ra.perimeters(bright(spark, d), ["image_id"]).select("image_id", r("perimeter_px").alias("perimeter_px"))


@query("hull_solidity_h2")
def hull_solidity(spark, d):
    return ra.solidity(bright(spark, d), ["image_id"]).select("image_id", "area_px", "hull_px", r("solidity").alias("solidity"))


@query("neighbour_terms_w7", """SELECT image_id, y, x, coalesce(l, q) + coalesce(q, l) + coalesce(u, w) + coalesce(w, u) - 4 * value AS laplacian, s - value AS step2 FROM (SELECT *, lag(value) OVER a AS l, lead(value) OVER a AS q, lag(value) OVER b AS u, lead(value) OVER b AS w, lead(value, 2) OVER a AS s FROM v_grey
  WINDOW a AS (PARTITION BY image_id, y ORDER BY x), b AS (PARTITION BY image_id, x ORDER BY y))""", "v_grey")
def neighbour_terms(spark, d):
    return ra.neighbour_terms(v.grey(spark, d)).select("image_id", "y", "x", "laplacian", "step2")


_FOCUS = """SELECT image_id, round(var_pop(coalesce(l, q) + coalesce(q, l) + coalesce(u, w) + coalesce(w, u) - 4 * value), 4) AS laplacian_var, round(avg((s - value) * (s - value)), 4) AS brenner, round(avg(value), 6) AS mean_intensity, round(stddev_pop(value), 6) AS std_intensity FROM (SELECT *, lag(value) OVER a AS l, lead(value) OVER a AS q,
  lag(value) OVER b AS u, lead(value) OVER b AS w, lead(value, 2) OVER a AS s FROM v_grey WINDOW a AS (PARTITION BY image_id, y ORDER BY x), b AS (PARTITION BY image_id, x ORDER BY y)) GROUP BY image_id"""


@query("focus_measures_h3", _FOCUS, "v_grey")
def focus_measures(spark, d):
    f = ra.focus_measures(v.grey(spark, d))
    return f.select("image_id", r("laplacian_var", 4).alias("laplacian_var"), r("brenner_gradient", 4).alias("brenner"), r("mean_intensity").alias("mean_intensity"), r("std_intensity").alias("std_intensity"))


@query("session_medians_a21", f"WITH f AS ({_FOCUS}) SELECT concat('C', CAST(image_id % 3 AS VARCHAR)) AS cond, round(coalesce(median(laplacian_var) FILTER (WHERE image_id % 2 = 0), 0), 4) AS t0, round(coalesce(median(laplacian_var) FILTER (WHERE image_id % 2 = 1), 0), 4) AS t7 FROM f GROUP BY 1", "v_grey")
def session_medians(spark, d):
    from replistat.operators.scan import group_summary
    f = focus_measures(spark, d)
    k, even = F.concat(F.lit("C"), (F.col("image_id") % 3).cast("string")), F.col("image_id") % 2 == 0
    s = group_summary(f.withColumn("cond", k), ["cond"], {"t0": (F.when(even, F.col("laplacian_var")), 0.5), "t7": (F.when(~even, F.col("laplacian_var")), 0.5)})
    return s.select("cond", r(F.coalesce("t0", F.lit(0.0)), 4).alias("t0"), r(F.coalesce("t7", F.lit(0.0)), 4).alias("t7"))


@query("exposure_h4", "SELECT image_id, round(avg((value >= 200)::INT), 6) AS saturation_frac, round((quantile_cont(value, 0.95) + 1e-4) / (quantile_cont(value, 0.5) + 1e-4), 6) AS snr FROM v_grey GROUP BY image_id", "v_grey")
def exposure(spark, d):
    return ra.exposure(v.grey(spark, d), top=200.0).select("image_id", r("saturation_frac").alias("saturation_frac"), r("snr").alias("snr"))


@query("spot_check_h5", "SELECT image_id, round(stddev_pop(value), 6) AS sd, round(avg((value = top)::INT), 6) AS share_at_max, stddev_pop(value) < 1e-3 AS is_blank, stddev_pop(value) >= 1e-3 AND avg((value = top)::INT) > 0.95 AS is_saturated FROM (SELECT *, max(value) OVER (PARTITION BY image_id) AS top FROM v_grey) GROUP BY image_id", "v_grey")
def spot_check(spark, d):
    return ra.spot_check(v.grey(spark, d)).select("image_id", r("sd").alias("sd"), r("share_at_max").alias("share_at_max"), "is_blank", "is_saturated")


@query("percentile_stretch_h6", """WITH q AS (SELECT image_id, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.998) AS hi, quantile_cont(value, 0.05) FILTER (WHERE y % 4 = 0 AND x % 4 = 0) AS slo, quantile_cont(value, 0.95) FILTER (WHERE y % 4 = 0 AND x % 4 = 0) AS shi FROM v_px GROUP BY 1)
  SELECT image_id, y, x, round((least(greatest(value, lo), hi) - lo) / greatest(1e-6, hi - lo), 6) AS f, round((least(greatest(value, slo), shi) - slo) / greatest(1e-6, shi - slo), 6) AS s FROM v_px JOIN q USING (image_id)""", "v_px")
def percentile_stretch(spark, d):
    p = ra.percentile_stretch(v.pixels(spark, d), 1.0, 99.8, name="f")
    return ra.percentile_stretch(p, 5.0, 95.0, sparse=True, name="s").select("image_id", "y", "x", r("f").alias("f"), r("s").alias("s"))


@query("otsu_thresholds_h7", """WITH h AS (SELECT image_id, CAST(value AS BIGINT) AS l, count(*) AS n FROM v_grey GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER a AS w0, sum(n * l) OVER a AS s0, sum(n) OVER b AS w, sum(n * l) OVER b AS s FROM h WINDOW a AS (PARTITION BY image_id ORDER BY l ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY image_id))
  SELECT image_id, l AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY w0::DOUBLE * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) ** 2 DESC, l) AS rk FROM c WHERE w > w0) WHERE rk = 1""", "v_grey")
def otsu_thresholds(spark, d):
    return ra.otsu_thresholds(v.grey(spark, d))


@query("field_extent_h8")
def field_extent(spark, d):
    p = v.grey(spark, d)
    e = ra.field_extent(p.filter("value >= 150"), p.filter("value >= 160"), 0.5)
    return e.select("image_id", "area_px", r("area_um2").alias("area_um2"), r("max_radius_um").alias("max_radius_um"), "method", "hull_fallback")


@query("density_area_h9", f"WITH {_SHAPED} SELECT image_id, count(*) AS n FROM sh WHERE value >= 140 AND y - 1 > 3 AND y - 1 < h - 4 AND x > 3 AND x < 60 GROUP BY image_id", "v_grey")
def density_area(spark, d):
    p = v.grey(spark, d)
    h = p.groupBy("image_id").agg(F.max("y").alias("h"))
    q = p.join(h, "image_id").withColumn("y", F.col("y") - 1).filter("value >= 140")
    return ra.strip_pixels(q, F.col("h"), F.lit(64), F.lit(3)).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))


@query("ring_contrast_h10", """WITH o AS (SELECT image_id, y, x FROM v_grey WHERE value >= 150), st AS (SELECT a.i - 2 AS dy, b.i - 2 AS dx FROM range(5) a(i), range(5) b(i)), rg AS (SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM o, st),
  rr AS (SELECT rg.* FROM rg ANTI JOIN o ON o.image_id = rg.image_id AND o.y = rg.y AND o.x = rg.x), m AS (SELECT g.image_id, avg(value) AS mr, count(*) AS n FROM rr JOIN v_grey g ON g.image_id = rr.image_id AND g.y = rr.y AND g.x = rr.x GROUP BY 1)
  SELECT image_id, round(mi, 6) AS mean_interior, round(mr, 6) AS mean_ring, n AS n_ring, round((mr - mi) / greatest(mr, 1e-4), 6) AS contrast FROM m JOIN (SELECT image_id, avg(value) AS mi FROM v_grey WHERE value >= 150 GROUP BY 1) USING (image_id)""", "v_grey")
def ring_contrast(spark, d):
    p = v.grey(spark, d)
    c = ra.ring_contrast(p, p.filter("value >= 150").withColumn("label", F.lit(1)), radius=2, square=True)
    return c.select("image_id", r("mean_interior").alias("mean_interior"), r("mean_ring").alias("mean_ring"), "n_ring", r("contrast_ratio").alias("contrast"))


@query("elliptic_ring_h10", """WITH o AS (SELECT image_id, y, x FROM v_grey WHERE value >= 155), st AS (SELECT i - 3 AS dy, j - 3 AS dx FROM range(7) a(i), range(7) b(j) WHERE abs(j - 3) <= [3, 3, 2, 0][abs(i - 3) + 1]),
  rg AS (SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM o, st), rr AS (SELECT rg.* FROM rg ANTI JOIN o ON o.image_id = rg.image_id AND o.y = rg.y AND o.x = rg.x), m AS (SELECT g.image_id, avg(value) AS mr, count(*) AS n FROM rr JOIN v_grey g ON g.image_id = rr.image_id AND g.y = rr.y AND g.x = rr.x GROUP BY 1)
  SELECT image_id, round(mi, 6) AS mean_interior, round(mr, 6) AS mean_ring, n AS n_ring, round((mr - mi) / greatest(mr, 1e-4), 6) AS contrast FROM m JOIN (SELECT image_id, avg(value) AS mi FROM v_grey WHERE value >= 155 GROUP BY 1) USING (image_id)""", "v_grey")
def elliptic_ring(spark, d):
    """The ring of rounded rows, as objects are grown by default."""
    p = v.grey(spark, d)
    c = ra.ring_contrast(p, p.filter("value >= 155").withColumn("label", F.lit(1)), radius=3)
    return c.select("image_id", r("mean_interior").alias("mean_interior"), r("mean_ring").alias("mean_ring"), "n_ring", r("contrast_ratio").alias("contrast"))


@query("blank_correction_h11", """WITH s AS (SELECT image_id, max(y) AS my, count(*) AS n FROM v_grey GROUP BY 1), b AS (SELECT y, x, median(value) AS blank FROM v_grey GROUP BY 1, 2), ok AS (SELECT image_id FROM s WHERE my = (SELECT max(y) FROM b) AND n = (SELECT count(*) FROM b))
  SELECT g.image_id, g.y, g.x, CASE WHEN ok.image_id IS NOT NULL THEN greatest(value - blank, 0) ELSE value END AS corrected, ok.image_id IS NOT NULL AS blank_applied FROM v_grey g JOIN b ON b.y = g.y AND b.x = g.x LEFT JOIN ok ON ok.image_id = g.image_id""", "v_grey")
def blank_correction(spark, d):
    p = v.grey(spark, d)
    return ra.subtract_blank(p, ra.blank_reference(p)).select("image_id", "y", "x", "corrected", "blank_applied")


@query("connected_regions_h12", """WITH RECURSIVE p AS (SELECT image_id, y, x, y * 64 + x AS k FROM v_grey WHERE value >= 160), e AS (SELECT a.image_id, a.k AS a, b.k AS b FROM p a JOIN p b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.k <> b.k),
  reach AS (SELECT image_id, k AS s, k AS t FROM p UNION SELECT r.image_id, r.s, e.b FROM reach r JOIN e ON e.image_id = r.image_id AND e.a = r.t)
  SELECT image_id, n_regions, n_pixels, largest FROM (SELECT image_id, count(DISTINCT root) AS n_regions, CAST(sum(1) AS BIGINT) AS n_pixels FROM (SELECT image_id, s, min(t) AS root FROM reach GROUP BY 1, 2) GROUP BY 1)
  JOIN (SELECT image_id, max(c) AS largest FROM (SELECT image_id, root, count(*) AS c FROM (SELECT image_id, s, min(t) AS root FROM reach GROUP BY 1, 2) GROUP BY 1, 2) GROUP BY 1) USING (image_id)""", "v_grey")
def connected_regions(spark, d):
    c = ra.connected_regions(v.grey(spark, d).filter("value >= 160")).groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_regions"), F.sum("n").alias("n_pixels"), F.max("n").alias("largest"))


@query("compact_labels_h12", "SELECT image_id, y, x, CASE WHEN value > 0 THEN dense_rank() OVER (PARTITION BY image_id, value > 0 ORDER BY value) ELSE 0 END AS new_label FROM v_grey", "v_grey")
def compact_labels(spark, d):
    return ra.compact_labels(v.grey(spark, d), label="value").select("image_id", "y", "x", "new_label")


_MASK = "mk AS MATERIALIZED (SELECT image_id, y, x, CASE WHEN value < 160 THEN 0 WHEN image_id % 3 = 0 THEN y % 5 + 1 WHEN image_id % 3 = 1 THEN 255 ELSE value END AS value FROM v_grey)"
_KIND = """kd AS MATERIALIZED (SELECT *, whole AND k BETWEEN 2 AND 1000 AND first = 1 AND top = k AND top <> 255 AS lab FROM (SELECT image_id, count(DISTINCT value) FILTER (value > 0) AS k, max(value) AS top, count(DISTINCT value) AS nv,
    min(value) FILTER (value > 0) AS first, bool_and(value = floor(value)) AS whole FROM mk GROUP BY 1))"""


def masks(spark, d):
    """Mask images of three kinds: labels, a drawing in two values, a drawing in grey levels."""
    n, x = F.col("image_id"), F.col("value")
    return v.grey(spark, d).withColumn("value", F.when(x < 160, 0.0).when(n % 3 == 0, (F.col("y") % 5 + 1).cast("double")).when(n % 3 == 1, 255.0).otherwise(x))


@query("mask_kinds_h12", f"WITH {_MASK}, {_KIND} SELECT image_id, lab AS is_label_image, nv AS n_values, CASE WHEN NOT lab THEN CASE WHEN nv <= 2 THEN 0 ELSE top / 2 END END::DOUBLE AS threshold FROM kd", "v_grey")
def mask_kinds(spark, d):
    return ra.mask_kind(masks(spark, d))


@query("masks_read_h12", f"""WITH RECURSIVE {_MASK}, {_KIND}, f AS MATERIALIZED (SELECT mk.*, lab, y * 64 + x AS p FROM mk JOIN kd USING (image_id) WHERE value > CASE WHEN lab OR nv <= 2 THEN 0 ELSE top / 2 END),
  e AS MATERIALIZED (SELECT a.image_id, a.p AS a, b.p AS b FROM f a JOIN f b ON a.image_id = b.image_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND a.p <> b.p WHERE NOT a.lab),
  reach AS (SELECT image_id, p AS s, p AS t FROM f WHERE NOT lab UNION SELECT q.image_id, q.s, e.b FROM reach q JOIN e ON e.image_id = q.image_id AND e.a = q.t),
  lb AS (SELECT image_id, p AS s, value AS root FROM f WHERE lab UNION ALL SELECT image_id, s, min(t) FROM reach GROUP BY 1, 2)
  SELECT image_id, count(DISTINCT root) AS n_labels, count(*) AS n_pixels, max(n) AS largest FROM (SELECT image_id, root, count(*) OVER (PARTITION BY image_id, root) AS n FROM lb) GROUP BY 1""", "v_grey")
def masks_read(spark, d):
    c = ra.read_mask(masks(spark, d)).groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_labels"), F.sum("n").alias("n_pixels"), F.max("n").alias("largest"))


@query("caller_segmentation_u3")
def caller_segmentation(spark, d):
    def above_mean(pdf):
        pdf["label"] = (pdf["value"] > pdf["value"].mean()).astype("int64")
        return pdf[["image_id", "y", "x", "label"]]
    return ra.relabel_with(v.grey(spark, d), above_mean, "image_id bigint, y bigint, x bigint, label bigint")
