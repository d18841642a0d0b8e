"""Column functions, calibration and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from replistat.functions import calibration as cal, geometry as geo, labels, naming
from replistat.operators.gates import volumes_from_area
from replistat.params import SizeGate
from replistat.sources.files import as_bool, channel_inventory, complete_manifest, image_manifest

from . import views as v
from .registry import query
from .views import big, r


@query("timepoint_parsing_f1", r"""SELECT event_id, CAST(nullif(regexp_extract(part, '(?i)^(?:(?:day|d|t)\s*)?(\d+)$', 1), '') AS BIGINT) AS day,
  CAST(nullif(regexp_extract(part, '(?i)^(?:(?:day|d|t)\s*)?(\d+)$', 1), '') AS BIGINT) = 0 AS is_t0
  FROM (SELECT event_id, trim(regexp_extract(stem, '^(Day0|d 7|[^ ]*)', 1)) AS part FROM v_name)""", "v_name")
def timepoint_parsing(spark, d):
    part = F.regexp_extract("stem", "^(Day0|d 7|[^ ]*)", 1)
    return v.names(spark, d).select("event_id", naming.parse_timepoint(part).alias("day"), naming.is_baseline(part).alias("is_t0"))


@query("condition_normalising_f2", r"""SELECT event_id, CASE WHEN raw = 'mat' THEN 'Mat'
    WHEN regexp_matches(replace(raw, ' ', ''), '(?i)^S(\d+)(?:D(\d+))?$') THEN upper(replace(raw, ' ', ''))
    WHEN regexp_matches(raw, '^[A-Za-z0-9-]+$') THEN raw END AS condition
  FROM (SELECT event_id, regexp_extract(stem, '^(Day0|d 7) (.+?) gel', 2) AS raw FROM v_name)""", "v_name")
def condition_normalising(spark, d):
    raw = F.regexp_extract("stem", "^(Day0|d 7) (.+?) gel", 2)
    return v.names(spark, d).select("event_id", naming.normalise_condition(raw).alias("condition"))


@query("file_name_parsing_f3", """SELECT event_id, CASE WHEN error IS NULL THEN stem END AS image_id,
  CASE WHEN error IS NULL THEN concat('t', CAST(day_no AS VARCHAR)) END AS timepoint, CASE WHEN error IS NULL THEN day_no END AS timepoint_day,
  CASE WHEN error IS NULL THEN cond END AS condition, CASE WHEN error IS NULL THEN replicate END AS replicate,
  CASE WHEN error IS NULL THEN fov END AS fov, CASE WHEN error IS NULL THEN concat_ws('_', cond, replicate, fov) END AS pair_key, error
  FROM v_parsed""", "v_parsed")
def file_name_parsing(spark, d):
    return v.names(spark, d).select("event_id", naming.parse_stem("stem").alias("m")).select("event_id", "m.*")


@query("field_name_parsing_f4", r"""SELECT field_no, base, channel, CASE WHEN ok THEN regexp_extract(base, p, 1) END AS cell_line,
  CASE WHEN ok THEN regexp_extract(base, p, 2) END AS day, CASE WHEN ok THEN regexp_extract(base, p, 4) END AS material,
  CASE WHEN ok THEN regexp_extract(base, p, 5) END AS replicate,
  CASE WHEN ok THEN coalesce(nullif(regexp_extract(base, p, 6), ''), '1') END AS subfield
  FROM (SELECT DISTINCT field_no, base, channel, regexp_matches(base, p) AS ok, p FROM v_channel,
    (SELECT '^(\S+)\s+Spheroid\s+D(\d+(?:\.\d+)?)(?:\s+([^_]+?))?\s*_([A-Za-z0-9][A-Za-z0-9._]*?)-([Gg]el\d+)(?:-(.+))?$' AS p))""", "v_channel")
def field_name_parsing(spark, d):
    return channel_inventory(v.field_names(spark, d)).drop("name", "side", "tax").distinct()


@query("geometry_f5", """SELECT object_id, round(pi() / 6 * s * s * s, 4) AS sphere, round(pi() / 6 * s * m * m, 4) AS ellipsoid,
  round(pi() / 6 * d * d * d, 4) AS from_area, round(power(6.0 * area_px / pi(), 1.0 / 3.0), 6) AS back, round(d * pixel_size_um, 6) AS eq_um,
  round(s * pixel_size_um, 6) AS um, round(s / pixel_size_um, 6) AS px
  FROM (SELECT *, perimeter_px AS s, area_px / 100.0 AS m, 2.0 * sqrt(area_px / pi()) AS d FROM v_object)""", "v_object")
def geometry_values(spark, d):
    s, m, a, p = "perimeter_px", F.col("area_px") / 100.0, "area_px", "pixel_size_um"
    return v.objects(spark, d).select(
        "object_id", r(geo.sphere_volume(s), 4).alias("sphere"), r(geo.ellipsoid_volume(s, m), 4).alias("ellipsoid"),
        r(geo.area_to_volume(a), 4).alias("from_area"), r(geo.volume_to_diameter(a)).alias("back"),
        r(geo.equivalent_diameter(a, p)).alias("eq_um"), r(geo.px_to_um(s, p)).alias("um"), r(geo.um_to_px(s, p)).alias("px"))


@query("shape_ratios_f6", """SELECT object_id, round(abs(vs - ve) / greatest(vs, 1e-6), 6) AS discrepancy,
  round(least(1.0, 4 * pi() * area_px / (greatest(1e-4, perimeter_px) * greatest(1e-4, perimeter_px))), 6) AS circ
  FROM (SELECT *, area_px * perimeter_px AS vs, area_px * 150.0 AS ve FROM v_object)""", "v_object")
def shape_ratios(spark, d):
    return v.objects(spark, d).select(
        "object_id", r(geo.volume_discrepancy(F.col("area_px") * F.col("perimeter_px"), F.col("area_px") * 150.0)).alias("discrepancy"),
        r(geo.circularity("area_px", "perimeter_px")).alias("circ"))


@query("object_measures_f7", """SELECT object_id, round(d, 6) AS d_px, round(area_px * 2.25, 4) AS area_um2, round(d * 1.5, 6) AS d_um,
  round(mj, 6) AS major_um, round(mn, 6) AS minor_um, round(mj / greatest(mn, 1e-4), 6) AS aspect, round(pi() / 6 * mj * mn * mn, 3) AS v_ell,
  least(1.0, greatest(0.0, contrast_ratio * 12.0)) AS sol
  FROM (SELECT *, (CASE WHEN area_px - 1000.0 > 0 THEN area_px - 1000.0 ELSE d END) * 1.5 AS mj, d * 1.5 AS mn
    FROM (SELECT *, 2.0 * sqrt(area_px / pi()) AS d FROM v_object))""", "v_object")
def object_measures(spark, d):
    o = v.objects(spark, d).withColumn("mj", F.col("area_px") - 1000.0).withColumn("so", F.col("contrast_ratio") * 12.0)
    m = geo.object_measures(major_px="mj", solidity="so")
    return o.select("object_id", r(m["equivalent_diameter_px"]).alias("d_px"), r(m["area_um2"], 4).alias("area_um2"),
                    r(m["equivalent_diameter_um"]).alias("d_um"), r(m["major_axis_um"]).alias("major_um"), r(m["minor_axis_um"]).alias("minor_um"),
                    r(m["aspect_ratio"]).alias("aspect"), r(m["volume_ellipsoid_um3"], 3).alias("v_ell"), m["solidity"].alias("sol"))


@query("number_and_unit_text_f8", r"""SELECT event_id, TRY_CAST(nullif(regexp_extract(props, '[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?', 0), '') AS DOUBLE) AS number,
  CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 1000.0 WHEN 'signup' THEN 25400.0 ELSE NULL END::DOUBLE AS factor,
  event_type <> 'error' AS known, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 4.0 BETWEEN 0.05 AND 20.0 AS plausible FROM events""")
def number_and_unit_text(spark, d):
    e = v.table(spark, d, "events")
    unit = (F.when(F.col("event_type") == "click", " Microns ").when(F.col("event_type") == "view", "MM")
            .when(F.col("event_type") == "signup", "inch").when(F.col("event_type") == "purchase", "px").otherwise("furlong"))
    return e.select("event_id", cal.lenient_float("props").alias("number"), cal.unit_factor(unit).alias("factor"),
                    cal.unit_known(unit).alias("known"),
                    cal.is_plausible(F.get_json_object("props", "$.k").cast("double") / 4.0).alias("plausible"))


@query("significance_stars_f9", """SELECT o_orderkey, CASE WHEN p < 0.0001 THEN '****' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*'
    WHEN p IS NULL THEN 'untested' ELSE 'ns' END AS four,
  CASE WHEN p IS NULL THEN 'untested' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS three,
  CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS two_sample
  FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice / 500000.0 * o_totalprice / 500000.0 * o_totalprice / 500000.0 END AS p FROM orders)""")
def significance_stars(spark, d):
    x = F.col("o_totalprice")
    p = F.when(F.col("o_orderstatus") != "P", x / 500000.0 * x / 500000.0 * x / 500000.0)
    return v.table(spark, d, "orders").select(
        "o_orderkey", labels.stars(p).alias("four"), labels.stars(p, 3).alias("three"), labels.stars(p, 3, "ns").alias("two_sample"))


@query("run_naming_f10", r"""SELECT l_orderkey AS k, run, CASE WHEN run LIKE '%\_subset' ESCAPE '\' THEN 'subset' ELSE 'full' END AS scope,
  nullif(arm, '') AS arm, CASE WHEN run LIKE '%\_subset' ESCAPE '\' THEN run ELSE concat(run, '_subset') END AS subset_name,
  CASE WHEN l_returnflag = 'N' THEN concat(lpad(CAST(l_orderkey AS VARCHAR), 3, '0'), '_base') ELSE concat(run, '_subset') END AS slug
  FROM (SELECT DISTINCT l_orderkey % 100 AS l_orderkey, l_returnflag, l_linenumber % 4 AS ln,
    concat('3', CASE l_linenumber % 4 WHEN 0 THEN '_PP00_none' WHEN 1 THEN '_PP10' WHEN 2 THEN 'xPP01' ELSE '_PP111' END,
      CASE WHEN l_returnflag = 'A' THEN '' ELSE '_v' END) AS run,
    CASE l_linenumber % 4 WHEN 0 THEN 'PP00' WHEN 1 THEN 'PP10' ELSE '' END AS arm FROM lineitem)""")
def run_naming(spark, d):
    n = F.col("l_linenumber") % 4
    run = F.concat(F.lit("3"), F.when(n == 0, "_PP00_none").when(n == 1, "_PP10").when(n == 2, "xPP01").otherwise("_PP111"),
                   F.when(F.col("l_returnflag") == "A", "").otherwise("_v"))
    rows = v.table(spark, d, "lineitem").select((F.col("l_orderkey") % 100).alias("k"), "l_returnflag", n.alias("ln"), run.alias("run")).distinct()
    named = F.col("l_returnflag") == "N"
    slug = labels.run_slug(F.when(~named, F.col("run")), F.col("k"), F.lit("base"), F.when(named, "full").otherwise("subset"))
    return rows.select("k", "run", labels.run_scope("run").alias("scope"), labels.ablation_arm("run").alias("arm"),
                       labels.subset_slug("run").alias("subset_name"), slug.alias("slug"))


@query("densities_f11", """SELECT run, image_id, round(CASE WHEN a > 0 THEN n_nuclei / (a * 1e-6) END, 3) AS per_mm2,
  round(CASE WHEN a > 0 AND NOT flag_any THEN n_nuclei / a * 1e9 END, 3) AS per_mm3
  FROM (SELECT *, nuclei_per_mm2 - 20.0 AS a FROM v_field)""", "v_field")
def densities(spark, d):
    a = F.col("nuclei_per_mm2") - 20.0
    return v.fields(spark, d).select("run", "image_id", r(geo.areal_density("n_nuclei", a), 3).alias("per_mm2"),
                                     r(geo.volumetric_density("n_nuclei", a, "flag_any"), 3).alias("per_mm3"))


@query("size_bounds_f12", """SELECT object_id, round(v, 3) AS volume, v < 0.25 * 50000.0 AS below, v > 4.0 * 50000.0 AS above,
  CASE WHEN contrast_ratio * 100 <= 0 THEN 0 ELSE greatest(1, CAST(round_even(contrast_ratio * 100 / 1.5, 0) AS BIGINT)) END AS clearance
  FROM (SELECT *, volume_sphere_um3 AS v FROM v_measured)""", "v_measured")
def size_bounds(spark, d):
    b = SizeGate(reference_um3=50000.0).bounds()
    vol = volumes_from_area("area_px", "pixel_size_um")
    return v.objects(spark, d).select("object_id", r(vol, 3).alias("volume"), (vol < b["min"]).alias("below"), (vol > b["max"]).alias("above"),
                                      geo.clearance_px(F.col("contrast_ratio") * 100, "pixel_size_um").alias("clearance"))


@query("growth_ratios_f13", """SELECT object_id, round(v7 - v0, 4) AS dv, round(v7 / greatest(v0, 1e-6), 6) AS fc,
  round(CASE WHEN v7 > 0 THEN log2(v7 / greatest(v0, 1e-6)) END, 6) AS l2, round(d7 - d0, 6) AS dd, round(d7 / greatest(d0, 1e-6), 6) AS fd
  FROM (SELECT object_id, area_px AS v0, contrast_ratio * 1000.0 AS v7, perimeter_px AS d0, centroid_y AS d7 FROM v_object)""", "v_object")
def growth_ratios(spark, d):
    g = geo.growth("area_px", F.col("contrast_ratio") * 1000.0, "perimeter_px", "centroid_y")
    return v.objects(spark, d).select("object_id", r(g["delta_volume_um3"], 4).alias("dv"), r(g["fold_change_volume"]).alias("fc"),
                                      r(g["log2_fold_change"]).alias("l2"), r(g["delta_diameter_um"]).alias("dd"), r(g["fold_change_diameter"]).alias("fd"))


@query("pixel_depth_f14", """SELECT image_id, y, x, round(least(1.0, g * 16.0 / greatest(top, 1e-6)), 6) AS unit,
  round_even(least(1.0, g * 16.0 / greatest(top, 1e-6)) * 255.0, 0) AS eight, round(g * 0.299 + x * 0.587 + y * 0.114, 6) AS grey
  FROM (SELECT image_id, y, x, value AS g, CASE WHEN max(value) OVER (PARTITION BY image_id) * 16.0 <= 255.0 THEN 255.0
    ELSE max(value) OVER (PARTITION BY image_id) * 16.0 END AS top FROM v_grey)""", "v_grey")
def pixel_depth(spark, d):
    p = v.grey(spark, d).withColumn("deep", F.col("value") * 16.0)
    top = p.groupBy("image_id").agg(F.max("deep").alias("top"))
    p = p.join(top, "image_id")
    return p.select("image_id", "y", "x", r(geo.unit_scaled("deep", "top")).alias("unit"), geo.eight_bit("deep", "top").alias("eight"),
                    r(geo.luma("value", "x", "y")).alias("grey"))


@query("display_order_f15", """SELECT condition, CASE condition WHEN 'Mat' THEN 1 WHEN 'S34D30' THEN 2 WHEN 'S40D30' THEN 3 ELSE 7 END::BIGINT AS place, min(day_no) AS first_day, count(*) AS n
  FROM (SELECT cond AS condition, day_no FROM v_parsed WHERE error IS NULL) GROUP BY 1, 2""", "v_parsed")
def display_order(spark, d):
    m = v.names(spark, d).select(naming.parse_stem("stem").alias("m")).filter("m.error is null")
    g = m.groupBy(F.col("m.condition").alias("condition")).agg(F.min("m.timepoint_day").alias("first_day"), F.count(F.lit(1)).alias("n"))
    return g.select("condition", labels.known_first("condition").alias("place"), "first_day", "n").orderBy("place", "condition")


# ---------------------------------------------------------------- calibration

def _vendor_text(k):
    return F.concat(F.lit("hdr "), F.when(F.col("event_type") == "click", F.concat(F.lit('{"MicronsPerPixel": "'), k, F.lit(' um"}')))
                    .when(F.col("event_type") == "view", F.concat(F.lit('{"Target": {"PixelSize": '), k, F.lit('}}')))
                    .when(F.col("event_type") == "error", F.concat(F.lit('{"PixelSize": '), k, F.lit(" broken")))
                    .otherwise(F.concat(F.lit('{"PixelSize": '), k, F.lit("}"))))


@query("vendor_json_scale_c1", """SELECT event_id, CASE WHEN ok AND k BETWEEN 0.05 AND 20 THEN k END AS um, CASE WHEN ok AND k > 0 THEN k BETWEEN 0.05 AND 20 END AS calibrated,
  CASE WHEN ok AND k BETWEEN 0.05 AND 20 THEN 'evos_tag_37510' WHEN ok AND k > 0 THEN 'evos_tag_37510 implausible' END AS source
  FROM (SELECT event_id, event_type <> 'error' AS ok, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 4.0 AS k FROM events)""")
def vendor_json_scale(spark, d):
    k = (F.get_json_object("props", "$.k").cast("double") / 4.0).cast("string")
    e = v.table(spark, d, "events").withColumn("tag", _vendor_text(k))
    return e.select("event_id", cal.evos("tag", F.lit(None).cast("string")).alias("c")).select("event_id", "c.*")


@query("ome_xml_scale_c2", """SELECT event_id, CASE WHEN ok AND um BETWEEN 0.05 AND 20 THEN round(um, 6) END AS um, CASE WHEN ok THEN um BETWEEN 0.05 AND 20 END AS calibrated,
  CASE WHEN ok AND um BETWEEN 0.05 AND 20 THEN 'OME-XML Tag 270' WHEN ok THEN 'OME-XML Tag 270 implausible' END AS source
  FROM (SELECT event_id, event_type NOT IN ('error', 'signup') AS ok, CAST(json_extract_string(props, '$.k') AS DOUBLE) *
    CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.001 ELSE 1.0 END AS um FROM events)""")
def ome_xml_scale(spark, d):
    k = F.get_json_object("props", "$.k")
    t = F.col("event_type")
    unit = F.when(t == "click", ' PhysicalSizeXUnit="µm"').when(t == "view", ' PhysicalSizeXUnit="nm"').when(
        t == "error", ' PhysicalSizeXUnit="parsec"').otherwise("")
    root = F.when(t == "signup", "Other").otherwise("ome:OME")
    xml = F.concat(F.lit("<?xml version='1.0'?><!-- <OME PhysicalSizeX=\"9\"> --><"), root, F.lit(" a='b'><Image><ome:Pixels SizeX='3' PhysicalSizeX=\""), k,
                   F.lit('"'), unit, F.lit("/></Image></ome:OME>"))
    e = v.table(spark, d, "events").withColumn("tag", xml)
    return e.select("event_id", cal.ome("tag").alias("c")).select("event_id", r("c.um").alias("um"), "c.calibrated", "c.source")


@query("imagej_and_resolution_scale_c3", """SELECT event_id, CASE WHEN j_ok THEN round(j, 6) END AS j_um, j_src,
  CASE WHEN t_ok THEN round(25400.0 / res, 6) END AS t_um,
  CASE WHEN res <= 1 THEN NULL WHEN abs(res - 72) < 1 OR abs(res - 96) < 1 THEN concat(CAST(res AS BIGINT), ' DPI screen default')
    WHEN t_ok THEN 'TIFF Resolution Tags' ELSE 'TIFF Resolution Tags implausible' END AS t_src
  FROM (SELECT *, kind IN ('click', 'view') AND j BETWEEN 0.05 AND 20 AS j_ok,
      res > 1 AND abs(res - 72) >= 1 AND abs(res - 96) >= 1 AND 25400.0 / res BETWEEN 0.05 AND 20 AS t_ok,
      CASE WHEN k = 0 THEN NULL WHEN kind = 'signup' THEN 'ImageJ unit=pixel' WHEN kind = 'purchase' THEN 'ImageJ unknown unit ''ell'''
        WHEN kind = 'error' THEN NULL WHEN j BETWEEN 0.05 AND 20 THEN 'ImageJ metadata' ELSE 'ImageJ metadata implausible' END AS j_src
    FROM (SELECT event_id, event_type AS kind, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(json_extract_string(props, '$.k') AS DOUBLE) * 30.0 AS res,
      CAST(json_extract_string(props, '$.k') AS DOUBLE) * CASE event_type WHEN 'click' THEN 0.5 ELSE 0.001 END AS j FROM events))""")
def imagej_and_resolution_scale(spark, d):
    t, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("double")
    half = (k * 0.5).cast("decimal(10,4)").cast("string")
    whole = k.cast("decimal(10,1)").cast("string")
    desc = (F.when(t == "click", F.concat(F.lit("ImageJ=1.53\nunit=\\u00B5m\nspacing=4\npixelWidth="), half))
            .when(t == "view", F.concat(F.lit("ImageJ=1.53\nunit=nm\npixelWidth="), whole))
            .when(t == "signup", F.concat(F.lit("ImageJ=1.53\nunit=pixel\npixelWidth="), whole))
            .when(t == "purchase", F.concat(F.lit("ImageJ=1.53\nunit=ell\npixelWidth="), whole)).otherwise("plain text"))
    res = k * 30.0
    e = v.table(spark, d, "events").select("event_id", cal.imagej(desc, res, F.lit(2)).alias("j"), cal.tiff_resolution(res, F.lit(2)).alias("t"))
    return e.select("event_id", r("j.um").alias("j_um"), F.col("j.source").alias("j_src"), r("t.um").alias("t_um"), F.col("t.source").alias("t_src"))


@query("scale_priority_c4", """SELECT user_id AS image_id, coalesce(arg_min(um, pr) FILTER (WHERE good), 1.518817::DOUBLE) AS pixel_size_um,
  coalesce(arg_min(source, pr) FILTER (WHERE good), concat('config_default_uncalibrated (', arg_min(source, pr), ' implausible)')) AS scale_source,
  count(*) FILTER (WHERE good) > 0 AS is_calibrated
  FROM (SELECT user_id, source, um_per_px AS um, um_per_px BETWEEN 0.05 AND 20 AS good,
      row_number() OVER (PARTITION BY user_id ORDER BY length(source), source, um_per_px) AS pr
    FROM v_tag JOIN events ON event_id = image_id) GROUP BY user_id""", "v_tag")
def scale_priority(spark, d):
    t = v.tags(spark, d).join(v.table(spark, d, "events").select(F.col("event_id").alias("image_id"), "user_id"), "image_id")
    c = cal.resolve_candidates(t.withColumn("pr", F.length("source")), "user_id", "pr", "um_per_px", "source")
    return c.withColumnRenamed("user_id", "image_id")


@query("scale_from_pages_c4", """SELECT image_id, round(CASE WHEN good THEN um ELSE 1.518817 END, 6) AS pixel_size_um, CASE WHEN good THEN 'evos_tag_37510' WHEN um > 0 THEN
    'config_default_uncalibrated (evos_tag_37510 implausible)' ELSE 'config_default_uncalibrated' END AS scale_source, coalesce(good, false) AS is_calibrated
  FROM (SELECT user_id AS image_id, arg_min(k, p) AS um, arg_min(k, p) BETWEEN 0.05 AND 20 AS good
    FROM (SELECT user_id, CASE WHEN event_type <> 'error' AND k > 0 THEN k END AS k, CASE WHEN event_type <> 'error' AND k > 0 THEN 0 ELSE 1 END * 1000000000 + event_id AS p
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 4.0 AS k FROM events))
    GROUP BY user_id)""")
def scale_from_pages(spark, d):
    k = (F.get_json_object("props", "$.k").cast("double") / 4.0).cast("string")
    none = F.lit(None).cast("string")
    e = v.table(spark, d, "events").select(
        F.col("user_id").alias("image_id"), F.col("event_id").alias("page"), _vendor_text(k).alias("tag_37510"),
        none.alias("tag_270"), F.lit(None).cast("double").alias("x_resolution"), F.lit(None).cast("int").alias("resolution_unit"))
    c = cal.resolve(e, page="page")
    return c.select("image_id", r("pixel_size_um").alias("pixel_size_um"), "scale_source", "is_calibrated")


@query("four_sources_c4", """WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 4.0 AS k FROM events),
  c AS (SELECT event_id, 1 AS pr, k AS um, 'evos_tag_37510' AS src, false AS screen FROM e WHERE event_id % 2 = 0 AND k > 0
    UNION ALL SELECT event_id, 2, k * 2, 'OME-XML Tag 270', false FROM e WHERE event_id % 3 = 0
    UNION ALL SELECT event_id, 3, k / 8, 'ImageJ metadata', false FROM e WHERE event_id % 3 = 1 AND k > 0
    UNION ALL SELECT event_id, 4, 25400.0 / (k * 12), CASE WHEN abs(k * 12 - 72) < 1 OR abs(k * 12 - 96) < 1 THEN concat(CAST(k * 12 AS BIGINT), ' DPI screen default') ELSE 'TIFF Resolution Tags' END,
      abs(k * 12 - 72) < 1 OR abs(k * 12 - 96) < 1 FROM e WHERE event_id % 5 < 3 AND k * 12 > 1),
  g AS (SELECT *, um BETWEEN 0.05 AND 20 AND NOT screen AS good FROM c),
  b AS (SELECT event_id, arg_min(um, pr) FILTER (WHERE good) AS um, arg_min(src, pr) FILTER (WHERE good) AS src, arg_min(CASE WHEN screen THEN src ELSE src || ' implausible' END, pr) AS refused FROM g GROUP BY 1)
  SELECT e.event_id AS image_id, round(coalesce(um, 1.518817), 6) AS pixel_size_um, coalesce(src, CASE WHEN refused IS NULL THEN 'config_default_uncalibrated' ELSE 'config_default_uncalibrated (' || refused || ')' END) AS scale_source,
    um IS NOT NULL AS is_calibrated FROM e LEFT JOIN b ON b.event_id = e.event_id""")
def four_sources(spark, d):
    """Vendor JSON, OME-XML or ImageJ text, and TIFF resolution side by side: the first plausible one in order of priority."""
    k = F.get_json_object("props", "$.k").cast("double") / 4.0
    n, text = F.col("event_id"), lambda x: x.cast("decimal(20,6)").cast("string")
    e = v.table(spark, d, "events").select(
        n.alias("image_id"), F.when(n % 2 == 0, F.concat(F.lit('{"PixelSize": '), text(k), F.lit("}"))).alias("tag_37510"),
        F.when(n % 3 == 0, F.concat(F.lit('<OME xmlns="x"><Image><Pixels PhysicalSizeX="'), text(k * 2), F.lit('"/></Image></OME>')))
        .when(n % 3 == 1, F.concat(F.lit("ImageJ=1.53\nunit=um\npixelWidth="), text(k / 8))).alias("tag_270"),
        F.when(n % 5 < 3, k * 12).alias("x_resolution"), F.lit(2).alias("resolution_unit"))
    return cal.resolve(e).select("image_id", r("pixel_size_um").alias("pixel_size_um"), "scale_source", "is_calibrated")


# ---------------------------------------------------------------- sources

def manifest(spark, d):
    paths = v.names(spark, d).select(F.concat(F.lit("/in/"), F.col("stem"), F.lit(".tif")).alias("path")).distinct()
    return image_manifest(paths)


@query("image_manifest_s1", """SELECT image_id, timepoint, timepoint_day, condition, replicate, fov, pair_key, concat('/in/', image_id, '.tif') AS file_path,
  is_matched_pair FROM v_manifest""", "v_manifest")
def image_manifest_q(spark, d):
    return manifest(spark, d)


@query("complete_manifest_s2", """SELECT doc_id, n_bytes AS file_size_bytes, sha256(text) AS sha256,
  CASE WHEN doc_id % 3 = 0 THEN 1.518817 ELSE doc_id % 7 + 0.25 END::DOUBLE AS pixel_size_um,
  CASE WHEN doc_id % 3 = 0 THEN 'default_fallback' ELSE source END AS scale_source, coalesce(quality = 1, false) AS is_calibrated
  FROM (SELECT d.doc_id, text, source, quality, strlen(text) AS n_bytes FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""")
def complete_manifest_q(spark, d):
    docs = v.table(spark, d, "documents").join(v.table(spark, d, "labels"), "doc_id", "left")
    given = F.col("doc_id") % 3 != 0
    m = docs.select("doc_id", F.octet_length("text").alias("length"), F.col("text").cast("binary").alias("content"),
                    F.when(given, F.col("doc_id") % 7 + 0.25).cast("double").alias("pixel_size_um"), F.when(given, F.col("source")).alias("scale_source"),
                    F.when(F.col("quality") == 1, " Yes ").when(F.col("quality") == 0, "no").alias("is_calibrated"))
    return complete_manifest(m, content="content").select("doc_id", "file_size_bytes", "sha256", "pixel_size_um", "scale_source", "is_calibrated")


@query("boolean_coercion_s2", """SELECT t, lower(trim(t)) IN ('true', '1', 'yes') AS b, n FROM (SELECT CASE l_linenumber WHEN 1 THEN ' TRUE' WHEN 2 THEN 'Yes' WHEN 3 THEN '1' WHEN 4 THEN 'nan'
  ELSE 'false' END AS t, count(*) AS n FROM lineitem GROUP BY 1)""")
def boolean_coercion(spark, d):
    n = F.col("l_linenumber")
    t = F.when(n == 1, " TRUE").when(n == 2, "Yes").when(n == 3, "1").when(n == 4, "nan").otherwise("false")
    g = v.table(spark, d, "lineitem").groupBy(t.alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("t", as_bool("t").alias("b"), "n")


@query("run_selection_s3", r"""SELECT run, count(*) AS n, sum(n_nuclei)::BIGINT AS total FROM (SELECT concat(run, CASE WHEN replicate = 'Gel0' THEN '_subset' ELSE '' END) AS run, n_nuclei FROM v_field)
  WHERE run NOT LIKE '%\_subset' ESCAPE '\' GROUP BY run""", "v_field")
def run_selection(spark, d):
    from replistat.operators.runs import select_runs
    f = v.fields(spark, d).withColumn("run", F.concat("run", F.when(F.col("replicate") == "Gel0", "_subset").otherwise("")))
    return select_runs(f, "run", scope="full").groupBy("run").agg(F.count(F.lit(1)).alias("n"), big(F.sum("n_nuclei")).alias("total"))
