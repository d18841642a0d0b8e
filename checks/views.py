"""The test tables seen as objects, fields, names, pixels, sets and tags: once in Spark, once as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from replistat.functions.geometry import object_measures
from replistat.operators.gates import morphology_gate, reason_text
from replistat.operators.scan import row_numbers
from replistat.params import ObjectGate
from replistat.session import cut_lineage, unless_large

RUNS = ["click", "error", "purchase", "signup", "view"]
#: Order lines in a part of the object view, about.
PART_ROWS = 200_000
GATE = ObjectGate(min_d_um=40.0, max_d_um=115.0, min_pass_d_um=45.0, max_pass_d_um=110.0, ring_contrast_factor=0.97)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r(c, digits: int = 6) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), digits)


def big(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def located_orders(spark, d) -> DataFrame:
    o, c = table(spark, d, "orders"), unless_large(table(spark, d, "customer"))
    n, g = table(spark, d, "nation"), table(spark, d, "region")
    return (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
            .join(g, n.n_regionkey == g.r_regionkey))


def unit_values(spark, d) -> DataFrame:
    return located_orders(spark, d).select(F.col("r_name").alias("cond"), F.col("n_name").alias("unit"),
                                           F.col("o_totalprice").alias("value"))


def objects(spark, d) -> DataFrame:
    """One object per (order, line); the smallest row stands for lines that repeat the key.

    Both the deduplication and the join run on the order key, so the lines are shuffled once, to a number of
    parts that follows the rows: merged by compressed size, parts would grow with the input.
    """
    li = table(spark, d, "lineitem")
    rows = li.count()
    li = li.repartition(max(spark.sparkContext.defaultParallelism, rows // PART_ROWS + 1), "l_orderkey")
    cols = ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax"]
    li = li.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct(*cols)).alias("s")).select("l_orderkey", "l_linenumber", "s.*")
    orders = located_orders(spark, d)
    j = li.join(orders.hint("merge") if rows > 100_000 else orders, F.col("l_orderkey") == F.col("o_orderkey"))    # orders are small as files only
    early = F.col("l_shipdate") < F.lit("1998-06-01 00:00:00").cast("timestamp")
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("object_id"), F.when(early, "t0").otherwise("t7").alias("timepoint"),
        F.col("r_name").alias("cond"), F.col("n_name").alias("replicate"), big(F.col("o_custkey") % 4).alias("fov"),
        F.col("o_custkey").alias("pair_key"), (F.col("l_extendedprice") / 200.0).alias("centroid_x"),
        (F.col("l_quantity") * 10.0).alias("centroid_y"), (F.col("l_quantity") * 100.0).alias("area_px"),
        (20.0 + F.col("l_quantity") * 4.0).alias("perimeter_px"), F.lit(1.5).alias("pixel_size_um"),
        F.col("l_discount").alias("contrast_ratio"), (1.0 - F.col("l_tax") * 5.0).alias("circularity"),
        big(F.col("l_suppkey") % 4).alias("plane"), big(F.col("l_partkey") % 4).alias("other_plane"),
        big("l_linenumber").alias("label"), F.col("o_orderpriority").alias("seg_backend"),
        F.concat(F.col("o_custkey").cast("string"), F.lit("_"), F.when(early, "t0").otherwise("t7")).alias("image_id"))


def measured(spark, d) -> DataFrame:
    o = objects(spark, d)
    keep = ("equivalent_diameter_px", "equivalent_diameter_um", "area_um2", "volume_sphere_um3")
    m = object_measures()
    return o.withColumns({k: m[k] for k in keep})


def gated(spark, d) -> DataFrame:
    g = morphology_gate(measured(spark, d), GATE, solidity=None, eccentricity=None, box=None)
    return g.withColumn("qc_reasons", reason_text("qc_codes"))


def fields(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    img = F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit("_W"),
                   F.floor((F.dayofmonth("ts") - 1) / 5).cast("string"))
    g = e.groupBy(F.col("event_type").alias("run"), img.alias("image_id"), F.col("user_id").alias("_u")).agg(
        F.count(F.lit(1)).alias("n_nuclei"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("_s"),
        F.max("value").alias("_m"), F.min("value").alias("_lo"))
    return g.select(
        "run", "image_id", F.concat(F.lit("M"), (F.col("_u") % 5).cast("string")).alias("material"),
        F.concat(F.lit("Gel"), (F.floor(F.col("_u") / 5) % 5).cast("string")).alias("replicate"), "n_nuclei",
        (F.col("_s") / F.col("n_nuclei")).alias("nuclei_per_mm2"), F.col("_m").alias("peak"), F.col("_lo").alias("low"),
        (F.col("_m") > 100.0).alias("flag_any"), F.when(F.col("_m") > 100.0, "saturated").when(F.col("_lo") < 2.0, "low_snr").otherwise("clean").alias("flag_summary"))


def names(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    i, u = F.col("event_id"), F.col("user_id")
    cond = F.when(u % 5 == 0, "mat").when(u % 5 == 1, "s34d30").when(u % 5 == 2, "S40 D30").when(u % 5 == 3, "Mat+drug").otherwise("Ctrl-2")
    tail = F.when(i % 17 == 0, " (1)").when(i % 19 == 0, " copy").otherwise("")
    return e.select("event_id", F.concat(
        F.when(i % 2 == 0, "Day0").otherwise("d 7"), F.lit(" "), cond, F.lit(" gel0"), (u % 4 + 1).cast("string"),
        F.lit("_"), (i % 7).cast("string"), F.lit("_TRANS"), tail).alias("stem"))


def field_names(spark, d) -> DataFrame:
    """Channel files of two-channel fields made of part, supplier and order keys."""
    li = table(spark, d, "lineitem")
    o = F.col("l_orderkey")
    mat = F.when(o % 3 == 0, "Mat").when(o % 3 == 1, "S34D30").otherwise("S4.5_D30")
    tag = F.when(o % 4 == 0, " Mor").otherwise("")
    base = F.concat(F.lit("SKOV"), (o % 2 + 3).cast("string"), F.when(o % 13 == 0, " Sphere D").otherwise(" Spheroid D"),
                    (o % 2 * 7 + 7).cast("string"), tag, F.lit("_"), mat, F.lit("-Gel"), (o % 9 + 1).cast("string"), F.lit("-"), o.cast("string"))
    ch = F.when(F.col("l_linenumber") % 3 == 0, "00").when(F.col("l_linenumber") % 3 == 1, "02").otherwise("01")
    ext = F.when(F.col("l_quantity") > 45, ".TIFF").otherwise(".tif")
    return li.select(o.alias("field_no"), F.concat(base, F.lit("_ch"), ch, ext).alias("name"), F.col("l_quantity").alias("side"),
                     F.col("l_tax").alias("tax")).distinct()


def pixels(spark, d) -> DataFrame:
    """Rasters: one image per label, one row per vector, one column per vector element.

    Row numbers use the skew-safe scan, since one label may hold a large share of the vectors.
    """
    e = row_numbers(table(spark, d, "embeddings"), ["label"], ["vec_id"], "y")
    p = e.select(F.col("label").alias("image_id"), "y", F.posexplode("embedding").alias("x", "v"))
    return p.select(big("image_id").alias("image_id"), big("y").alias("y"), big("x").alias("x"), F.col("v").cast("double").alias("value"))


def grey(spark, d) -> DataFrame:
    """The same rasters as whole grey levels 0..255."""
    p = pixels(spark, d)
    lv = F.least(F.greatest(F.floor((F.col("value") + 0.5) * 256.0), F.lit(0)), F.lit(255))
    return p.withColumn("value", lv.cast("double"))


def sets(spark, d) -> DataFrame:
    w = table(spark, d, "documents").select(F.col("doc_id").alias("cand_id"), F.col("lang").alias("image_id"),
                                            F.explode(F.split("text", " ")).alias("elem"))
    return w.filter(F.col("elem") != "").distinct()


def set_rows(spark, d) -> DataFrame:
    """The same sets, one row per document with its different words; documents that repeat a key are put together."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("cand_id"), F.col("lang").alias("image_id"), "text").filter("cand_id is not null and image_id is not null")
    again = unless_large(cut_lineage(docs.groupBy("cand_id", "image_id").count().filter("count > 1").drop("count")))
    words = lambda w: w.select("cand_id", "image_id", F.array_distinct(F.filter(F.split("text", " "), lambda x: x != "")).alias("elem"))
    keys = ["cand_id", "image_id"]
    more = words(docs.join(again, keys, "left_semi")).select(*keys, F.explode("elem").alias("elem")).groupBy(*keys).agg(F.collect_set("elem").alias("elem"))
    return words(docs.join(again, keys, "left_anti")).filter("elem is not null").unionByName(more)


def tags(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("image_id"), F.col("event_type").alias("source"),
                                            (F.get_json_object("props", "$.k").cast("double") / 4.0).alias("um_per_px"))


SQL = {
    "v_unit_value": """SELECT r_name AS cond, n_name AS unit, o_totalprice AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey""",
    "v_object": """SELECT l_orderkey * 10 + l_linenumber AS object_id,
    CASE WHEN l_shipdate < TIMESTAMP '1998-06-01 00:00:00' THEN 't0' ELSE 't7' END AS timepoint,
    r_name AS cond, n_name AS replicate, CAST(o_custkey % 4 AS BIGINT) AS fov, o_custkey AS pair_key,
    l_extendedprice / 200.0 AS centroid_x, l_quantity * 10.0 AS centroid_y, l_quantity * 100.0 AS area_px,
    20.0 + l_quantity * 4.0 AS perimeter_px, CAST(1.5 AS DOUBLE) AS pixel_size_um, l_discount AS contrast_ratio,
    1.0 - l_tax * 5.0 AS circularity, CAST(l_suppkey % 4 AS BIGINT) AS plane, CAST(l_partkey % 4 AS BIGINT) AS other_plane,
    CAST(l_linenumber AS BIGINT) AS label, o_orderpriority AS seg_backend,
    concat(CAST(o_custkey AS VARCHAR), '_', CASE WHEN l_shipdate < TIMESTAMP '1998-06-01 00:00:00' THEN 't0' ELSE 't7' END) AS image_id
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS rn FROM lineitem) l
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE rn = 1""",
    "v_measured": """SELECT *, 2.0 * sqrt(area_px / pi()) AS equivalent_diameter_px,
    2.0 * sqrt(area_px / pi()) * pixel_size_um AS equivalent_diameter_um, area_px * pixel_size_um * pixel_size_um AS area_um2,
    pi() / 6.0 * (2.0 * sqrt(area_px / pi()) * pixel_size_um) * (2.0 * sqrt(area_px / pi()) * pixel_size_um)
      * (2.0 * sqrt(area_px / pi()) * pixel_size_um) AS volume_sphere_um3 FROM v_object""",
    "v_gated": """SELECT *, CASE WHEN fail_text <> '' THEN 'FAIL' WHEN review_text <> '' THEN 'REVIEW' ELSE 'PASS' END AS qc_flag,
    CASE WHEN fail_text <> '' THEN fail_text WHEN review_text <> '' THEN review_text ELSE 'None' END AS qc_reasons
  FROM (SELECT *, concat_ws('; ', CASE WHEN equivalent_diameter_um < 40 THEN 'debris_undersized' END,
      CASE WHEN equivalent_diameter_um > 115 THEN 'oversized_artifact' END,
      CASE WHEN contrast_ratio < 0.03 - 1e-7 THEN 'insufficient_dark_contrast' END) AS fail_text,
    concat_ws('; ', CASE WHEN circularity < 0.65 THEN 'low_circularity' END,
      CASE WHEN equivalent_diameter_um < 45 OR equivalent_diameter_um > 110 THEN 'outside_pass_diameter' END) AS review_text
    FROM v_measured)""",
    "v_field": """SELECT run, image_id, concat('M', CAST(u % 5 AS VARCHAR)) AS material,
    concat('Gel', CAST((u // 5) % 5 AS VARCHAR)) AS replicate, n_nuclei, s / n_nuclei AS nuclei_per_mm2, peak, low,
    peak > 100.0 AS flag_any, CASE WHEN peak > 100.0 THEN 'saturated' WHEN low < 2.0 THEN 'low_snr' ELSE 'clean' END AS flag_summary
  FROM (SELECT event_type AS run, concat('U', CAST(user_id AS VARCHAR), '_W', CAST((day(ts) - 1) // 5 AS VARCHAR)) AS image_id,
    user_id AS u, count(*) AS n_nuclei, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS s, max(value) AS peak, min(value) AS low
    FROM events GROUP BY ALL)""",
    "v_name": """SELECT event_id, concat(CASE WHEN event_id % 2 = 0 THEN 'Day0' ELSE 'd 7' END, ' ',
    CASE user_id % 5 WHEN 0 THEN 'mat' WHEN 1 THEN 's34d30' WHEN 2 THEN 'S40 D30' WHEN 3 THEN 'Mat+drug' ELSE 'Ctrl-2' END,
    ' gel0', CAST(user_id % 4 + 1 AS VARCHAR), '_', CAST(event_id % 7 AS VARCHAR), '_TRANS',
    CASE WHEN event_id % 17 = 0 THEN ' (1)' WHEN event_id % 19 = 0 THEN ' copy' ELSE '' END) AS stem FROM events""",
    "v_parsed": r"""SELECT event_id, stem,
    CASE WHEN regexp_matches(stem, '(?i)(\s*\(\d+\)|[ _-]+copy([ _]*\d+)?)$') THEN 'copy_suffix'
      WHEN NOT regexp_matches(stem, '(?i)^(day|d)[ _]?(\d+)[ _]+(.+?)[ _]+gel[ _]?(\d+)[ _](\d+)[ _]TRANS$') THEN 'unmatched'
      WHEN stem LIKE '%Mat+drug%' THEN 'ambiguous_condition' END AS error,
    CAST(regexp_extract(stem, '(?i)^(day|d)[ _]?(\d+)', 2) AS BIGINT) AS day_no,
    CASE regexp_extract(stem, '(?i)^(day|d)[ _]?\d+[ _]+(.+?)[ _]+gel', 2) WHEN 'mat' THEN 'Mat' WHEN 's34d30' THEN 'S34D30'
      WHEN 'S40 D30' THEN 'S40D30' ELSE 'Ctrl-2' END AS cond,
    concat('gel', CAST(CAST(regexp_extract(stem, '(?i)gel[ _]?(\d+)[ _](\d+)[ _]TRANS', 1) AS BIGINT) AS VARCHAR)) AS replicate,
    lpad(CAST(CAST(regexp_extract(stem, '(?i)gel[ _]?(\d+)[ _](\d+)[ _]TRANS', 2) AS BIGINT) AS VARCHAR), 4, '0') AS fov
  FROM v_name""",
    "v_manifest": """SELECT *, count(DISTINCT timepoint) OVER (PARTITION BY pair_key) >= 2 AS is_matched_pair FROM (
    SELECT stem AS image_id, concat('t', CAST(day_no AS VARCHAR)) AS timepoint, day_no AS timepoint_day, cond AS condition, replicate, fov,
      concat_ws('_', cond, replicate, fov) AS pair_key,
      row_number() OVER (PARTITION BY concat_ws('_', cond, replicate, fov), day_no ORDER BY concat('/in/', stem, '.tif')) AS rn
    FROM v_parsed WHERE error IS NULL) WHERE rn = 1""",
    "v_file": """SELECT DISTINCT l_orderkey AS field_no, concat('SKOV', CAST(l_orderkey % 2 + 3 AS VARCHAR),
    CASE WHEN l_orderkey % 13 = 0 THEN ' Sphere D' ELSE ' Spheroid D' END, CAST(l_orderkey % 2 * 7 + 7 AS VARCHAR),
    CASE WHEN l_orderkey % 4 = 0 THEN ' Mor' ELSE '' END, '_', CASE l_orderkey % 3 WHEN 0 THEN 'Mat' WHEN 1 THEN 'S34D30' ELSE 'S4.5_D30' END,
    '-Gel', CAST(l_orderkey % 9 + 1 AS VARCHAR), '-', CAST(l_orderkey AS VARCHAR), '_ch',
    CASE l_linenumber % 3 WHEN 0 THEN '00' WHEN 1 THEN '02' ELSE '01' END, CASE WHEN l_quantity > 45 THEN '.TIFF' ELSE '.tif' END) AS name,
    l_quantity AS side, l_tax AS tax FROM lineitem""",
    "v_channel": r"""SELECT *, regexp_extract(name, '(?i)^(.+)_ch(\d{2})\.tiff?$', 1) AS base,
    regexp_extract(name, '(?i)^(.+)_ch(\d{2})\.tiff?$', 2) AS channel FROM v_file""",
    "v_pixel": """SELECT CAST(label AS BIGINT) AS image_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS y, embedding FROM embeddings""",
    "v_px": """SELECT image_id, y, CAST(i AS BIGINT) AS x, CAST(embedding[i + 1] AS DOUBLE) AS value FROM v_pixel, range(64) t(i)""",
    "v_grey": """SELECT image_id, y, x, least(greatest(floor((value + 0.5) * 256.0), 0), 255) AS value FROM v_px""",
    "v_set": """SELECT DISTINCT doc_id AS cand_id, lang AS image_id, word AS elem FROM (
    SELECT doc_id, lang, unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> ''""",
    "v_tag": """SELECT event_id AS image_id, event_type AS source,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) / 4.0 AS um_per_px FROM events""",
}
_NEEDS = {"v_measured": ("v_object",), "v_gated": ("v_measured",), "v_parsed": ("v_name",), "v_manifest": ("v_parsed",),
          "v_channel": ("v_file",), "v_px": ("v_pixel",), "v_grey": ("v_px",)}


def with_views(needs, sql: str) -> str:
    """Prefix ``sql`` (optionally starting with more CTEs after ``WITH``) by the shared views."""
    order: list[str] = []

    def add(v: str) -> None:
        for n in _NEEDS.get(v, ()):
            add(n)
        if v not in order:
            order.append(v)

    for v in needs:
        add(v)
    if not order:
        return sql
    head = ", ".join(f"{v} AS ({SQL[v]})" for v in order)
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if recursive:
        body = body[len("WITH RECURSIVE"):]
    elif body.upper().startswith("WITH"):
        body = body[4:]
    else:
        return f"WITH {head} {body}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}, {body}"
