"""Joins, matching and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from replistat.operators import matching as m, sets as s
from replistat.operators.gates import reason_text
from replistat.operators.rollup import merge_tables
from replistat.operators.scan import first_per_key
from replistat.plans.growth import pair
from replistat.session import cut_lineage, unless_large
from replistat.sources.files import channel_inventory
from replistat.streaming.incremental import complete_runs, pending, run_fingerprint, work_key

from . import views as v
from .registry import query
from .views import big, r


@query("matched_pairs_j1", "SELECT pair_key, count(DISTINCT timepoint) >= 2 AS matched, count(*) AS n FROM v_object GROUP BY pair_key", "v_object")
def matched_pairs(spark, d):
    o = unless_large(cut_lineage(v.objects(spark, d).select("pair_key", "timepoint")))      # read twice
    o = m.mark_matched(o, "pair_key", "timepoint", "matched")
    return o.groupBy("pair_key", "matched").agg(F.count(F.lit(1)).alias("n"))


@query("matched_and_single_keys_j1", """SELECT pair_key, CASE WHEN count(DISTINCT timepoint) = 2 THEN 'matched' WHEN min(timepoint) = 't0' THEN 'only_first' ELSE 'only_second' END AS state FROM v_object GROUP BY pair_key""", "v_object")
def matched_and_single_keys(spark, d):
    return m.matched_keys(v.objects(spark, d), "pair_key", "timepoint")


_CHAN = """WITH p AS (SELECT base, min(name) FILTER (WHERE channel = '00') AS first_file, min(name) FILTER (WHERE channel = '02') AS second_file,
  count(DISTINCT name) FILTER (WHERE channel = '00') AS n_first, count(DISTINCT name) FILTER (WHERE channel = '02') AS n_second FROM v_channel WHERE channel IN ('00', '02') GROUP BY base),
  s AS (SELECT name, max(side) AS side, max(tax) AS tax FROM v_channel GROUP BY name)
  SELECT base, first_file, second_file, n_first, n_second, CASE WHEN n_first > 1 OR n_second > 1 THEN 'collision' WHEN n_first = 0 THEN 'missing_first' WHEN n_second = 0 THEN 'missing_second'
    WHEN a.side > 25 AND b.side <= 25 THEN 'shape_mismatch' WHEN a.tax > 0 AND b.tax > 0 AND abs(b.tax - a.tax) > 0.01 * a.tax THEN 'pixel_size_mismatch' ELSE 'paired' END AS state
  FROM p LEFT JOIN s a ON a.name = first_file LEFT JOIN s b ON b.name = second_file"""


@query("channel_pairing_j2", _CHAN, "v_channel")
def channel_pairing(spark, d):
    f = channel_inventory(v.field_names(spark, d))
    p = m.pair_channels(f.select("base", "channel", "name").distinct(), "base", "channel", "name")
    props = f.groupBy("name").agg(F.max("side").alias("side"), F.max("tax").alias("tax"))
    a = props.select(F.col("name").alias("first_file"), F.col("side").alias("sa"), F.col("tax").alias("ta"))
    b = props.select(F.col("name").alias("second_file"), F.col("side").alias("sb"), F.col("tax").alias("tb"))
    p = p.join(a, "first_file", "left").join(b, "second_file", "left")
    wide_a, wide_b = F.col("sa") > 25, (F.col("sb") > 25) | (F.col("sa") <= 25)
    out = m.field_state(p, wide_a, F.when(wide_a, wide_b).otherwise(False), F.col("ta"), F.col("tb"), F.col("ta") > 0, F.col("tb") > 0)
    return out.select("base", "first_file", "second_file", "n_first", "n_second", "state")


@query("material_qualifying_j2", """SELECT material, count(*) AS n FROM (SELECT DISTINCT concat(regexp_extract(base, p, 1), '_D', regexp_extract(base, p, 2), '_', regexp_extract(base, p, 4)) AS material, base FROM v_channel,
    (SELECT '^(\\S+)\\s+Spheroid\\s+D(\\d+(?:\\.\\d+)?)(?:\\s+([^_]+?))?\\s*_([A-Za-z0-9][A-Za-z0-9._]*?)-([Gg]el\\d+)(?:-(.+))?$' AS p) WHERE regexp_matches(base, p)) GROUP BY 1""", "v_channel")
def material_qualifying(spark, d):
    f = channel_inventory(v.field_names(spark, d)).filter("material is not null").select("base", "cell_line", "day", "material").distinct()
    return m.qualify_materials(f).groupBy("material").agg(F.count(F.lit(1)).alias("n"))


_EDGE = """WITH g AS (SELECT * FROM v_gated WHERE qc_flag <> 'FAIL'), e AS (SELECT a.object_id AS t0_id, b.object_id AS t7_id,
    sqrt((a.centroid_x - b.centroid_x) * (a.centroid_x - b.centroid_x) + (a.centroid_y - b.centroid_y) * (a.centroid_y - b.centroid_y)) AS dist,
    greatest(50.0, (a.equivalent_diameter_px + b.equivalent_diameter_px) / 4.0 * 1.5) AS lim
  FROM g a JOIN g b ON a.pair_key = b.pair_key AND a.timepoint = 't0' AND b.timepoint = 't7')"""


def _edges(spark, d):
    o = cut_lineage(v.gated(spark, d).select("object_id", "pair_key", "timepoint", "centroid_x", "centroid_y", "equivalent_diameter_px", "qc_flag"))
    return m.admissible_edges(o.filter("timepoint = 't0'"), o.filter("timepoint = 't7'"), "pair_key", stored=True)


@query("admissible_edges_j3", _EDGE + " SELECT t0_id, t7_id, round(dist, 6) AS distance FROM e WHERE dist <= lim", "v_gated")
def admissible_edges(spark, d):
    return _edges(spark, d).select(F.col("a_object_id").alias("t0_id"), F.col("b_object_id").alias("t7_id"), r("distance").alias("distance"))


@query("single_edge_matches_j3", _EDGE + """, k AS (SELECT *, count(*) OVER (PARTITION BY t0_id) AS c0, count(*) OVER (PARTITION BY t7_id) AS c7 FROM e WHERE dist <= lim)
  SELECT t0_id, t7_id, round(dist, 6) AS distance FROM k WHERE c0 = 1 AND c7 = 1""", "v_gated")
def single_edge_matches(spark, d):
    lone, _ = m.lone_edges(_edges(spark, d), "a_object_id", "b_object_id")
    return lone.select(F.col("a_object_id").alias("t0_id"), F.col("b_object_id").alias("t7_id"), r("distance").alias("distance"))


def growth_pairs(spark, d):
    o = v.gated(spark, d).withColumnsRenamed({"cond": "condition"}).withColumn("volume_ellipsoid_um3", F.col("volume_sphere_um3"))
    o = o.withColumn("pair_key", F.col("pair_key").cast("string"))
    return pair(o, order="object_id", last=True)


_MATCH = _EDGE.replace("SELECT a.object_id AS t0_id", "SELECT a.pair_key, a.object_id AS t0_id").replace("WITH g AS", "WITH RECURSIVE g AS MATERIALIZED") + """, r AS MATERIALIZED (
    SELECT pair_key, t0_id, dense_rank() OVER (PARTITION BY pair_key ORDER BY t0_id) AS i, t7_id, dist FROM e WHERE dist <= lim), top AS (SELECT pair_key, max(i) AS top FROM r GROUP BY 1),
  w AS (SELECT pair_key, 0::BIGINT AS i, []::BIGINT[] AS used, 0::BIGINT AS n, 0.0::DOUBLE AS total, []::STRUCT(a BIGINT, b BIGINT, d DOUBLE)[] AS picks FROM top
    UNION ALL SELECT pair_key, i, used, any_value(n), min(total), arg_min(picks, total) FROM (
      SELECT w.pair_key, w.i + 1 AS i, list_sort(list_append(w.used, r.t7_id)) AS used, w.n + 1 AS n, w.total + r.dist AS total, list_append(w.picks, struct_pack(a := r.t0_id, b := r.t7_id, d := r.dist)) AS picks
      FROM w JOIN r ON r.pair_key = w.pair_key AND r.i = w.i + 1 WHERE NOT list_contains(w.used, r.t7_id)
      UNION ALL SELECT w.pair_key, w.i + 1, w.used, w.n, w.total, w.picks FROM w JOIN top ON top.pair_key = w.pair_key WHERE w.i < top.top) GROUP BY pair_key, i, used),
  best AS (SELECT w.pair_key, picks FROM w JOIN top ON top.pair_key = w.pair_key AND w.i = top.top QUALIFY row_number() OVER (PARTITION BY w.pair_key ORDER BY n DESC, total) = 1),
  mt AS MATERIALIZED (SELECT pair_key, p.a AS t0_id, p.b AS t7_id, p.d AS dist, row_number() OVER (PARTITION BY pair_key ORDER BY p.a) AS pn FROM (SELECT pair_key, unnest(picks) AS p FROM best))"""


@query("optimal_matching_j3", _MATCH + " SELECT t0_id, t7_id, round(dist, 6) AS distance FROM mt", "v_gated")
def optimal_matching_q(spark, d):
    got = m.optimal_matching(_edges(spark, d), "a_object_id", "b_object_id", last=True)
    return got.select(F.col("a_object_id").alias("t0_id"), F.col("b_object_id").alias("t7_id"), r("distance").alias("distance"))


@query("matched_pair_ids_j5", _MATCH + """, p AS (SELECT t0_id AS oid, CAST(pair_key AS VARCHAR) || '_pair' || pn AS pid FROM mt UNION ALL SELECT t7_id, CAST(pair_key AS VARCHAR) || '_pair' || pn FROM mt)
  SELECT object_id, CASE WHEN qc_flag = 'FAIL' THEN 'UNPAIRED' ELSE coalesce(pid, 'UNPAIRED') END AS pair_id FROM v_gated LEFT JOIN p ON oid = object_id""", "v_gated")
def matched_pair_ids(spark, d):
    """Pair ids of all objects, from the optimal matching."""
    return growth_pairs(spark, d)[1].select("object_id", "pair_id")


@query("optimal_pairs_j3", _MATCH + """, k AS (SELECT CAST(mt.pair_key AS VARCHAR) || '_pair' || pn AS pair_id, t0_id, t7_id, dist, b.volume_sphere_um3 / greatest(a.volume_sphere_um3, 1e-6) AS fc, a.qc_flag AS f0, b.qc_flag AS f7, a.equivalent_diameter_um >= 60 AS ok
    FROM mt JOIN v_gated a ON a.object_id = t0_id JOIN v_gated b ON b.object_id = t7_id)
  SELECT pair_id, t0_id AS t0_object_id, t7_id AS t7_object_id, round(dist, 6) AS distance, round(fc, 6) AS fc, CASE WHEN f0 = 'REVIEW' OR f7 = 'REVIEW' OR fc < 0.1 OR fc > 20 THEN 'REVIEW' ELSE 'PASS' END AS combined_qc_flag,
    coalesce(nullif(concat_ws('; ', CASE WHEN f0 = 'REVIEW' THEN 't0_REVIEW' END, CASE WHEN f7 = 'REVIEW' THEN 't7_REVIEW' END, CASE WHEN fc < 0.1 THEN 'extreme_shrinkage' WHEN fc > 20 THEN 'extreme_expansion' END, CASE WHEN NOT ok THEN 'sub_denominator_baseline' END), ''), 'None') AS qc_reasons FROM k""", "v_gated")
def optimal_pairs(spark, d):
    p, _ = growth_pairs(spark, d)
    return p.select("pair_id", "t0_object_id", "t7_object_id", r("centroid_distance_px").alias("distance"), r("fold_change_volume").alias("fc"), "combined_qc_flag", "qc_reasons")


@query("greedy_pairs_j4", _EDGE.replace("SELECT a.object_id AS t0_id", "SELECT a.pair_key, a.object_id AS t0_id").replace("WITH g AS", "WITH RECURSIVE g AS MATERIALIZED") + """, r AS MATERIALIZED (SELECT pair_key, t0_id, row_number() OVER (PARTITION BY pair_key ORDER BY t0_id) AS i, list(struct_pack(d := dist, b := t7_id) ORDER BY dist, t7_id) AS opts
    FROM e WHERE dist <= lim GROUP BY pair_key, t0_id),
  w AS (SELECT pair_key, 0::BIGINT AS i, NULL::BIGINT AS t0_id, NULL::STRUCT(d DOUBLE, b BIGINT) AS pick, []::BIGINT[] AS used FROM r WHERE i = 1
    UNION ALL SELECT pair_key, i, t0_id, pick, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick.b) END
    FROM (SELECT w.pair_key, r.i, r.t0_id, w.used, list_filter(r.opts, lambda x: NOT list_contains(w.used, x.b))[1] AS pick FROM w JOIN r ON r.pair_key = w.pair_key AND r.i = w.i + 1))
  SELECT t0_id AS a_object_id, pick.b AS b_object_id, round(pick.d, 6) AS distance FROM w WHERE pick IS NOT NULL""", "v_gated")
def greedy_pairs(spark, d):
    return m.greedy_matching(_edges(spark, d), "a_object_id", "b_object_id", "a_object_id", "b_object_id").withColumn("distance", r("distance"))


@query("pair_id_assignment_j5", """WITH p AS (SELECT pair_key, min(object_id) FILTER (WHERE timepoint = 't0' AND qc_flag <> 'FAIL') AS a, min(object_id) FILTER (WHERE timepoint = 't7') AS b FROM v_gated GROUP BY pair_key)
  SELECT object_id, CASE WHEN qc_flag = 'FAIL' THEN 'UNPAIRED' ELSE coalesce(CAST(p.pair_key AS VARCHAR) || '_pair1', 'UNPAIRED') END AS pair_id
  FROM v_gated g LEFT JOIN (SELECT pair_key, a AS oid FROM p WHERE a IS NOT NULL AND b IS NOT NULL UNION ALL SELECT pair_key, b FROM p WHERE a IS NOT NULL AND b IS NOT NULL) p ON g.object_id = p.oid""", "v_gated")
def pair_id_assignment(spark, d):
    o = v.gated(spark, d)
    p = o.groupBy("pair_key").agg(F.min(F.when((F.col("timepoint") == "t0") & (F.col("qc_flag") != "FAIL"), F.col("object_id"))).alias("t0_object_id"),
                                  F.min(F.when(F.col("timepoint") == "t7", F.col("object_id"))).alias("t7_object_id")).dropna()
    p = p.withColumn("pair_id", F.concat(F.col("pair_key").cast("string"), F.lit("_pair1")))
    return m.assign_pair_ids(o, p).select("object_id", "pair_id")


@query("duplicate_id_check_j5", "SELECT l_orderkey * 10 + l_linenumber AS object_id, count(*) AS n_rows FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_id_check(spark, d):
    li = v.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("object_id"))
    return m.duplicate_ids(li)


_DUP = """WITH g AS MATERIALIZED (SELECT * FROM v_gated WHERE qc_flag <> 'FAIL'), e AS (SELECT a.object_id AS a, b.object_id AS b, concat_ws('|', a.cond, a.pair_key, a.timepoint) AS grp,
    sqrt((a.centroid_x - b.centroid_x) * (a.centroid_x - b.centroid_x) + (a.centroid_y - b.centroid_y) * (a.centroid_y - b.centroid_y)) AS dist,
    CASE WHEN abs(a.contrast_ratio - b.contrast_ratio) > 0.02 THEN CASE WHEN a.contrast_ratio > b.contrast_ratio THEN b.object_id ELSE a.object_id END
      WHEN a.circularity - b.circularity >= 0 THEN b.object_id ELSE a.object_id END AS loser
  FROM g a JOIN g b ON a.cond = b.cond AND a.pair_key = b.pair_key AND a.timepoint = b.timepoint AND a.plane <> b.plane AND a.object_id < b.object_id),
  d AS MATERIALIZED (SELECT * FROM e WHERE dist <= 80 / 1.5)"""


def duplicate_edges(spark, d):
    o = v.gated(spark, d).select("cond", "pair_key", "timepoint", "plane", "object_id", "centroid_x", "centroid_y", "pixel_size_um", "contrast_ratio", "circularity", "qc_flag")
    return m.duplicate_edges(o, ["cond", "pair_key", "timepoint"], "plane", "object_id", "object_id", max_um=80.0)


@query("duplicate_edges_j6", _DUP + " SELECT a, b, round(dist, 6) AS distance, loser FROM d", "v_gated")
def duplicate_edges_q(spark, d):
    return duplicate_edges(spark, d).select(F.col("a_object_id").alias("a"), F.col("b_object_id").alias("b"), r("distance").alias("distance"), m.loser_id("object_id").alias("loser"))


@query("duplicate_first_losers_j6", _DUP + """, v AS (SELECT a AS n, dist, a, b FROM d UNION ALL SELECT b, dist, a, b FROM d),
  l AS MATERIALIZED (SELECT n, arg_min(a, rn) AS fa, arg_min(b, rn) AS fb FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY dist, a, b) AS rn FROM v) GROUP BY n)
  SELECT d.a, d.b, d.loser FROM d JOIN l x ON x.n = d.a AND x.fa = d.a AND x.fb = d.b JOIN l y ON y.n = d.b AND y.fa = d.a AND y.fb = d.b""", "v_gated")
def duplicate_first_losers(spark, d):
    """Edges that come first at both ends: each object keeps only its nearest partner, as an aggregate."""
    e = cut_lineage(duplicate_edges(spark, d).select(
        F.col("a_object_id").alias("a"), F.col("b_object_id").alias("b"), "distance", m.loser_id("object_id").alias("loser")))
    rank = F.struct("distance", "a", "b")
    first = e.select(F.explode(F.array("a", "b")).alias("n"), rank.alias("rk")).groupBy("n").agg(F.min("rk").alias("rk"))
    x, y = first.select(F.col("n").alias("xn"), F.col("rk").alias("xr")), first.select(F.col("n").alias("yn"), F.col("rk").alias("yr"))
    e = e.withColumn("rk", rank)
    return e.join(x, (F.col("a") == F.col("xn")) & (F.col("rk") == F.col("xr"))).join(y, (F.col("b") == F.col("yn")) & (F.col("rk") == F.col("yr"))).select("a", "b", "loser")


@query("duplicates_resolved_j6", _DUP.replace("WITH g", "WITH RECURSIVE g") + """, r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY dist, a, b) AS i FROM d),
  w AS (SELECT grp, 0::BIGINT AS i, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::DOUBLE AS dist, NULL::BIGINT AS loser, []::BIGINT[] AS lost FROM r WHERE i = 1
    UNION ALL SELECT w.grp, r.i, r.a, r.b, r.dist, CASE WHEN NOT list_has_any(w.lost, [r.a, r.b]) THEN r.loser END, CASE WHEN list_has_any(w.lost, [r.a, r.b]) THEN w.lost ELSE list_append(w.lost, r.loser) END
    FROM w JOIN r ON r.grp = w.grp AND r.i = w.i + 1)
  SELECT loser, CASE WHEN loser = a THEN b ELSE a END AS winner, round(dist, 6) AS distance FROM w WHERE loser IS NOT NULL""", "v_gated")
def duplicates_resolved(spark, d):
    return m.resolve_duplicates(duplicate_edges(spark, d), "object_id", "object_id").select("loser", "winner", r("distance").alias("distance"))


@query("overlap_edges_j7", """WITH n AS (SELECT image_id, cand_id, count(*) AS n, md5(string_agg(elem, chr(1) ORDER BY elem)) AS sig FROM v_set GROUP BY 1, 2),
  m AS (SELECT image_id, cand_id, n, min(cand_id) OVER (PARTITION BY image_id, sig) AS rep FROM n),
  i AS (SELECT a.image_id, a.cand_id AS ca, b.cand_id AS cb, count(*) AS k FROM v_set a JOIN v_set b ON a.image_id = b.image_id AND a.elem = b.elem AND a.cand_id < b.cand_id GROUP BY 1, 2, 3),
  p AS (SELECT i.image_id, k, k / (p.n + q.n - k) AS iou, p.n > q.n OR (p.n = q.n AND p.rep <= q.rep) AS fwd, p.rep AS ra, q.rep AS rb
    FROM i JOIN m p ON p.image_id = i.image_id AND p.cand_id = ca JOIN m q ON q.image_id = i.image_id AND q.cand_id = cb)
  SELECT image_id, CASE WHEN fwd THEN ra ELSE rb END AS first, CASE WHEN fwd THEN rb ELSE ra END AS second, any_value(k) AS n_both, round(any_value(iou), 6) AS iou, count(*) AS n_pairs FROM p WHERE iou > 0.5 GROUP BY 1, 2, 3""", "v_set")
def overlap_edges(spark, d):
    edges, _ = s.overlap_edges(v.set_rows(spark, d), "image_id", "cand_id", "elem")
    return edges.select("image_id", "first", "second", "n_both", r("iou").alias("iou"), "n_pairs")


@query("overlaps_suppressed_j7", """WITH RECURSIVE n AS (SELECT image_id, cand_id, count(*) AS n, md5(string_agg(elem, chr(1) ORDER BY elem)) AS sig FROM v_set GROUP BY 1, 2),
  i AS (SELECT a.image_id, a.cand_id AS ca, b.cand_id AS cb, count(*) AS k FROM v_set a JOIN v_set b ON a.image_id = b.image_id AND a.elem = b.elem AND a.cand_id <> b.cand_id GROUP BY 1, 2, 3),
  p AS (SELECT i.image_id, ca, list(cb) AS near FROM i JOIN n p ON p.image_id = i.image_id AND p.cand_id = ca JOIN n q ON q.image_id = i.image_id AND q.cand_id = cb WHERE k / (p.n + q.n - k) > 0.5 GROUP BY 1, 2),
  r AS MATERIALIZED (SELECT n.*, coalesce(near, []) AS near, count(*) OVER (PARTITION BY n.image_id, sig) AS n_same, row_number() OVER (PARTITION BY n.image_id ORDER BY n DESC, cand_id) AS i FROM n LEFT JOIN p ON p.image_id = n.image_id AND p.ca = n.cand_id),
  w AS (SELECT image_id, 0::BIGINT AS i, NULL::BIGINT AS cand_id, NULL::BIGINT AS n_elements, NULL::BIGINT AS n_same, false AS kept, []::BIGINT[] AS have FROM r WHERE i = 1
    UNION ALL SELECT w.image_id, r.i, r.cand_id, r.n, r.n_same, NOT list_has_any(w.have, r.near), CASE WHEN list_has_any(w.have, r.near) THEN w.have ELSE list_append(w.have, r.cand_id) END
    FROM w JOIN r ON r.image_id = w.image_id AND r.i = w.i + 1)
  SELECT image_id, cand_id, n_elements, n_same FROM w WHERE kept""", "v_set")
def overlaps_suppressed(spark, d):
    return s.suppress_overlaps(v.set_rows(spark, d), "image_id", "cand_id", "elem")


@query("elements_claimed_j7", """WITH RECURSIVE c AS (SELECT l_orderkey AS image_id, l_linenumber::BIGINT AS cand_id, max(l_quantity) AS q, list_distinct(flatten(list(range(l_partkey % 50, l_partkey % 50 + CAST(l_quantity AS BIGINT) + 1)))) AS s FROM lineitem GROUP BY 1, 2),
  r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY q DESC, cand_id) AS i FROM c),
  w AS (SELECT image_id, 0::BIGINT AS i, NULL::BIGINT AS cand_id, 0::BIGINT AS n, []::BIGINT[] AS have FROM r WHERE i = 1
    UNION ALL SELECT image_id, i, cand_id, CASE WHEN (len(s) - len(fresh)) / len(s) < 0.5 THEN len(fresh) ELSE 0 END, CASE WHEN (len(s) - len(fresh)) / len(s) < 0.5 THEN list_concat(have, fresh) ELSE have END
    FROM (SELECT w.image_id, r.i, r.cand_id, r.s, w.have, list_filter(r.s, lambda x: NOT list_contains(w.have, x)) AS fresh FROM w JOIN r ON r.image_id = w.image_id AND r.i = w.i + 1))
  SELECT image_id, cand_id, n AS n_claimed FROM w WHERE n > 0""")
def elements_claimed(spark, d):
    """Each order line claims a stretch of one raster row of its order, longest first."""
    li = v.table(spark, d, "lineitem")
    # lines are dealt by order before their stretches are made: the elements are never shuffled
    li = li.repartition(max(spark.sparkContext.defaultParallelism, li.count() // v.PART_ROWS + 1), "l_orderkey")
    li = li.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").cast("bigint").alias("cand_id"), "l_quantity", "l_partkey")
    start = F.col("l_partkey") % 50
    stretch = F.struct(start.alias("a"), (start + F.col("l_quantity").cast("bigint")).alias("b"))
    c = li.groupBy("image_id", "cand_id").agg(F.max("l_quantity").alias("q"), F.collect_list(stretch).alias("r"))
    e = c.select("image_id", "cand_id", F.struct(-F.col("q"), "cand_id").alias("ord"), F.flatten(F.array_compact(F.transform("r", lambda x: F.sequence(x["a"], x["b"])))).alias("elem"))
    return s.claimed_sizes(e, "image_id", "cand_id", "elem", "ord")


@query("merged_tables_j8", """SELECT a.image_id, a.material, a.replicate, a.n_nuclei AS n_qc, b.n_nuclei AS n_feat, coalesce(b.n_nuclei, a.n_nuclei) AS n_any, coalesce(c.flag_summary, 'clean') AS flags
  FROM (SELECT * FROM v_field WHERE run = 'click') a JOIN (SELECT * FROM v_field WHERE run = 'view') b USING (image_id, material, replicate)
  LEFT JOIN (SELECT * FROM v_field WHERE run = 'error') c USING (image_id)""", "v_field")
def merged_tables(spark, d):
    f = v.fields(spark, d)
    a = f.filter("run = 'click'").select("image_id", "material", "replicate", "n_nuclei")
    b = f.filter("run = 'view'").select("image_id", "material", "replicate", "n_nuclei")
    c = f.filter("run = 'error'").select("image_id", F.col("flag_summary").alias("fl"))
    j = merge_tables(a, b, ["image_id", "material", "replicate"], suffix="_feat", prefer={"n_any": ["n_nuclei_feat", "n_counted", "n_nuclei"]})
    j = merge_tables(j, c, ["image_id"], "left")
    return j.select("image_id", "material", "replicate", F.col("n_nuclei").alias("n_qc"), F.col("n_nuclei_feat").alias("n_feat"), "n_any", F.coalesce("fl", F.lit("clean")).alias("flags"))


@query("mask_agreement_j9", """WITH a AS (SELECT DISTINCT image_id, elem FROM v_set JOIN documents ON doc_id = cand_id WHERE length(source) = 4), b AS (SELECT DISTINCT image_id, elem FROM v_set JOIN documents ON doc_id = cand_id WHERE length(source) <> 4),
  u AS (SELECT coalesce(a.image_id, b.image_id) AS image_id, (a.elem IS NOT NULL)::INT AS x, (b.elem IS NOT NULL)::INT AS y FROM a FULL JOIN b ON a.image_id = b.image_id AND a.elem = b.elem)
  SELECT image_id, CAST(sum(x) AS BIGINT) AS n_auto, CAST(sum(y) AS BIGINT) AS n_manual, CAST(sum(x * y) AS BIGINT) AS n_both, round(2.0 * sum(x * y) / (sum(x) + sum(y)), 6) AS dice,
    round(sum(x * y) / (sum(x) + sum(y) - sum(x * y)), 6) AS iou FROM u GROUP BY image_id""", "v_set")
def mask_agreement(spark, d):
    w = v.sets(spark, d).join(v.table(spark, d, "documents").select(F.col("doc_id").alias("cand_id"), (F.length("source") == 4).alias("short")), "cand_id")
    out = s.agreement(w.filter("short"), w.filter("not short"), "image_id", "elem")
    return out.select("image_id", big("n_auto").alias("n_auto"), big("n_manual").alias("n_manual"), big("n_both").alias("n_both"), r("dice").alias("dice"), r("iou").alias("iou"))


@query("common_images_j10", "SELECT image_id, count(DISTINCT run) AS n_sources, count(DISTINCT run) = (SELECT count(DISTINCT run) FROM v_field) AS in_all FROM v_field GROUP BY image_id", "v_field")
def common_images(spark, d):
    return s.common_members(v.fields(spark, d), "image_id", "run")


_KEY = "sha256(concat('img:', sha256(text), '|params:', sha256('{\"diameter\":30.0,\"seed\":42}'), '|model:', sha256('none'), '|pkg:', sha256('1')))"


@query("pending_work_j11", f"""WITH k AS (SELECT doc_id, source, {_KEY} AS work_key FROM documents) SELECT doc_id, work_key FROM k
  WHERE work_key NOT IN (SELECT k2.work_key FROM k k2 JOIN labels l ON l.doc_id = k2.doc_id)""")
def pending_work(spark, d):
    params = {"seed": 42, "diameter": 30.0}
    docs = v.table(spark, d, "documents").select("doc_id", work_key(F.sha2("text", 256), params, version="1").alias("work_key"))
    return pending(docs, docs.join(v.table(spark, d, "labels"), "doc_id", "left_semi"))


@query("run_fingerprints_j11", """WITH h AS (SELECT run, md5(concat_ws('|', CAST(image_id AS VARCHAR), CAST(n_nuclei AS VARCHAR))) AS m FROM v_field WHERE run <> 'view'),
  s AS (SELECT run, count(*) AS n_inputs, sum(CAST('0x' || substr(m, 1, 8) AS BIGINT)) AS a, sum(CAST('0x' || substr(m, 9, 8) AS BIGINT)) AS b FROM h GROUP BY run)
  SELECT run, n_inputs, sha256(concat_ws('|', '{"seed":42}', 'none', CAST(n_inputs AS VARCHAR), CAST(a AS VARCHAR), CAST(b AS VARCHAR))) AS fingerprint FROM s""", "v_field")
def run_fingerprints(spark, d):
    f = run_fingerprint(v.fields(spark, d), ["run"], ["image_id", "n_nuclei"], {"seed": 42})
    return complete_runs(f, f.filter("run <> 'view'"), ["run"])


@query("radial_distance_j12", """SELECT object_id, round(sqrt((centroid_x - cx) * (centroid_x - cx) + (centroid_y - cy) * (centroid_y - cy)) / greatest(1.0, rad), 9) AS dist
  FROM v_object JOIN (SELECT image_id, (min(centroid_x) + max(centroid_x)) / 2 AS cx, (min(centroid_y) + max(centroid_y)) / 2 AS cy, max(perimeter_px) AS rad FROM v_object GROUP BY 1) USING (image_id)""", "v_object")
def radial_distance(spark, d):
    o = v.objects(spark, d)
    mid = lambda c: (F.min(c) + F.max(c)) / 2
    e = o.groupBy("image_id").agg(mid("centroid_x").alias("cx"), mid("centroid_y").alias("cy"), F.max("perimeter_px").alias("rad"))
    return m.radial_distance(o, e, "image_id", "centroid_x", "centroid_y", "cx", "cy", "rad").select("object_id", r("normalized_radial_distance", 9).alias("dist"))


@query("first_row_per_key_w3", "SELECT run, image_id, o_orderkey FROM (SELECT o_orderpriority AS run, o_custkey AS image_id, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_totalprice, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def first_row_per_key(spark, d):
    o = v.table(spark, d, "orders").select(F.col("o_orderpriority").alias("run"), F.col("o_custkey").alias("image_id"), "o_orderkey", "o_totalprice")
    return first_per_key(o, ["run", "image_id"], ["o_totalprice", "o_orderkey"]).select("run", "image_id", "o_orderkey")


@query("image_union_x1", "SELECT DISTINCT image_id FROM v_field", "v_field")
def image_union(spark, d):
    """Every image of any run."""
    return s.common_members(v.fields(spark, d), "image_id", "run").select("image_id")


@query("common_and_dropped_x2", """SELECT image_id, CASE WHEN count(DISTINCT run) = (SELECT count(DISTINCT run) FROM v_field) THEN 'common' ELSE 'dropped' END AS part FROM v_field GROUP BY image_id""", "v_field")
def common_and_dropped(spark, d):
    """Images present in all runs, and those that some run lacks."""
    f = s.common_members(v.fields(spark, d), "image_id", "run")
    return f.select("image_id", F.when(F.col("in_all"), "common").otherwise("dropped").alias("part"))


@query("one_sided_keys_x3", "SELECT image_id FROM v_field WHERE run = 'click' EXCEPT SELECT image_id FROM v_field WHERE run = 'view'", "v_field")
def one_sided_keys(spark, d):
    return s.only_in(v.fields(spark, d), "image_id", "run", F.col("run") == "click", F.col("run") == "view")
