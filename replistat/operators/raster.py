"""Rasters as pixel tables ``(image_id, y, x, value, label)``: statistics, focus, extents, contrast.

Windows run along one raster row or column, so a huge image is split by its rows; everything else
is a partial aggregate or an equi-join on coordinates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import disk_diameter, num, sphere_volume
from ..params import MIN_EXTENT_PX
from .graph import connected_components
from .scan import group_summary, row_numbers


def zonal_statistics(pixels: DataFrame, keys: Sequence[str] = ("image_id", "label"), y="y", x="x", value="value") -> DataFrame:
    """Area, centroid, box (exclusive maxima), intensity and equal-moment ellipse of each region."""
    xs, ys, v = num(x), num(y), num(value)
    s = pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("area_px"), F.avg(ys).alias("centroid_y"), F.avg(xs).alias("centroid_x"),
        F.min(y).alias("min_row"), F.min(x).alias("min_col"), (F.max(y) + 1).alias("max_row"), (F.max(x) + 1).alias("max_col"),
        F.avg(v).alias("mean_value"), F.sum(v).alias("sum_value"),
        F.var_pop(xs).alias("_vx"), F.var_pop(ys).alias("_vy"), F.covar_pop(xs, ys).alias("_cxy"))
    half = (F.col("_vx") + F.col("_vy")) / 2.0
    root = F.sqrt(F.pow((F.col("_vx") - F.col("_vy")) / 2.0, 2) + F.pow("_cxy", 2))
    l1, l2 = half + root, F.greatest(half - root, F.lit(0.0))
    ecc = F.when(l1 > 0, F.sqrt(F.greatest(1.0 - l2 / l1, F.lit(0.0)))).otherwise(0.0)
    return s.withColumns({"major_axis_px": 4.0 * F.sqrt(l1), "minor_axis_px": 4.0 * F.sqrt(l2), "eccentricity": ecc}).drop("_vx", "_vy", "_cxy")


def perimeters(pixels: DataFrame, keys: Sequence[str] = ("image_id", "label"), y="y", x="x") -> DataFrame:
    """Boundary length of each region from the 3 x 3 pattern around every border pixel.

    A border pixel has one of its four neighbours outside the region. Each border pixel sends its
    weight to the nine positions around it; the sum there says straight, diagonal or corner step.
    """
    along = lambda fixed, moving: Window.partitionBy(*keys, fixed).orderBy(moving)
    wx, wy = along(y, x), along(x, y)
    near = lambda w, c, k: F.coalesce(F.lag(c, k).over(w) == F.col(c) - k, F.lit(False))
    border = (
        pixels.select(*keys, y, x)
        .withColumn("_inx", near(wx, x, 1) & near(wx, x, -1)).withColumn("_iny", near(wy, y, 1) & near(wy, y, -1))
        .filter(~(F.col("_inx") & F.col("_iny"))).select(*keys, y, x))
    # 1 for the pixel itself, 2 across an edge, 10 across a corner.
    weight = {0: 1, 1: 2, 2: 10}
    steps = F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx"), F.lit(weight[abs(i) + abs(j)]).alias("w"))
                      for i in (-1, 0, 1) for j in (-1, 0, 1)])
    code = border.withColumn("_s", F.explode(steps)).groupBy(
        *keys, (F.col(y) + F.col("_s.dy")).alias("_y"), (F.col(x) + F.col("_s.dx")).alias("_x")).agg(F.sum("_s.w").alias("_c"))
    # Length by pattern code.
    c = F.col("_c")
    length = (F.when(c.isin(5, 7, 15, 17, 25, 27), 1.0).when(c.isin(21, 33), 2.0 ** 0.5)
              .when(c.isin(13, 23), (1.0 + 2.0 ** 0.5) / 2.0).otherwise(0.0))
    # counts per code first, so that the float sum has three terms whatever the order
    n = code.groupBy(*keys).agg(
        F.count_if(length == 1.0).alias("_n1"), F.count_if(c.isin(21, 33)).alias("_n2"), F.count_if(c.isin(13, 23)).alias("_n3"))
    return n.select(*keys, (F.col("_n1") + F.col("_n2") * (2.0 ** 0.5) + F.col("_n3") * ((1.0 + 2.0 ** 0.5) / 2.0)).alias("perimeter_px"))


def row_extremes(pixels: DataFrame, keys: Sequence[str], y="y", x="x") -> DataFrame:
    """First and last column of each region in each raster row: all a convex hull needs."""
    return pixels.groupBy(*keys, y).agg(F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.count(F.lit(1)).alias("n"))


def _hull_counter(keys: Sequence[str], y: str):
    keys = list(keys)

    def run(pdf):
        import math

        import pandas as pd

        rows = pdf.sort_values(y)
        pts = set()
        for r, lo, hi in zip(rows[y].tolist(), rows["x_min"].tolist(), rows["x_max"].tolist()):
            for c in (lo, hi):
                pts.update(((r - 0.5, c), (r + 0.5, c), (r, c - 0.5), (r, c + 0.5)))
        pts = sorted(pts)

        def chain(points):
            out = []
            for p in points:
                while len(out) > 1 and ((out[-1][0] - out[-2][0]) * (p[1] - out[-2][1])
                                        - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])) <= 0:
                    out.pop()
                out.append(p)
            return out

        low, high = chain(pts), chain(pts[::-1])
        ring = low[:-1] + high[:-1]
        total, sy, sx = 0, 0.0, 0.0
        for r in range(math.ceil(pts[0][0]), math.floor(pts[-1][0]) + 1):
            cross = []
            for (y0, x0), (y1, x1) in zip(ring, ring[1:] + ring[:1]):
                if min(y0, y1) <= r <= max(y0, y1):
                    cross += [x0, x1] if y0 == y1 else [x0 + (x1 - x0) * (r - y0) / (y1 - y0)]
            first, last = math.ceil(min(cross) - 1e-9), math.floor(max(cross) + 1e-9)
            if last >= first:
                n = last - first + 1
                total, sy, sx = total + n, sy + r * n, sx + n * (first + last) / 2.0
        head = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**head, "hull_px": [total], "hull_cy": [sy / max(total, 1)], "hull_cx": [sx / max(total, 1)]})

    return run


def hull_areas(pixels: DataFrame, keys: Sequence[str] = ("image_id", "label"), y="y", x="x") -> DataFrame:
    """Pixels whose centre lies in the convex hull of the region's pixel-edge midpoints.

    Only the two outer pixels of every raster row reach the grouped function, so its input is bounded
    by the height of an image.
    """
    rows = row_extremes(pixels, keys, y, x).select(*keys, F.col(y).cast("bigint").alias(y), F.col("x_min").cast("bigint").alias("x_min"),
                                                   F.col("x_max").cast("bigint").alias("x_max"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", hull_px bigint, hull_cy double, hull_cx double"
    return rows.groupBy(*keys).applyInPandas(_hull_counter(keys, y), schema)


def solidity(pixels: DataFrame, keys: Sequence[str] = ("image_id", "label"), y="y", x="x") -> DataFrame:
    area = pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("area_px"))
    j = area.join(hull_areas(pixels, keys, y, x), list(keys))
    return j.withColumn("solidity", F.col("area_px") / F.col("hull_px"))


def neighbour_terms(pixels: DataFrame, image="image_id", y="y", x="x", value="value") -> DataFrame:
    """Laplacian (mirrored at the edge) and two-step horizontal difference of every pixel."""
    wx, wy = Window.partitionBy(image, y).orderBy(x), Window.partitionBy(image, x).orderBy(y)
    v = F.col(value)
    left, right = F.lag(v, 1).over(wx), F.lead(v, 1).over(wx)
    up, down = F.lag(v, 1).over(wy), F.lead(v, 1).over(wy)
    lap = (F.coalesce(left, right, v) + F.coalesce(right, left, v) + F.coalesce(up, down, v) + F.coalesce(down, up, v) - 4 * v)
    return pixels.withColumn("laplacian", lap).withColumn("step2", F.lead(v, 2).over(wx) - v)


def focus_measures(pixels: DataFrame, image="image_id", y="y", x="x", value="value") -> DataFrame:
    """Laplacian variance, Brenner gradient, mean and deviation (population) per image."""
    t = neighbour_terms(pixels, image, y, x, value)
    return t.groupBy(image).agg(
        F.var_pop("laplacian").alias("laplacian_var"), F.avg(F.col("step2") * F.col("step2")).alias("brenner_gradient"),
        F.avg(value).alias("mean_intensity"), F.stddev_pop(value).alias("std_intensity"))


def exposure(pixels: DataFrame, image="image_id", value="value", top: float = 255.0) -> DataFrame:
    """Share of pixels at the depth limit and the ratio of the 95th to the 50th percentile."""
    v = num(value)
    s = group_summary(pixels, [image], {"p50": (v, 0.5), "p95": (v, 0.95)},
                      [F.avg((v >= top).cast("double")).alias("saturation_frac")])
    return s.withColumn("snr", (F.col("p95") + 1e-4) / (F.col("p50") + 1e-4))


def spot_check(pixels: DataFrame, image="image_id", value="value") -> DataFrame:
    """Blank (no variation) and saturated (more than 95 percent at the maximum) images."""
    top = pixels.groupBy(image).agg(F.max(value).alias("_top"), F.stddev_pop(value).alias("sd"), F.count(F.lit(1)).alias("_n"))
    # equal values are counted before the join, so it carries one row per distinct value
    counts = pixels.groupBy(image, value).agg(F.count(F.lit(1)).alias("_c"))
    at = counts.join(top.select(F.col(image).alias("_i"), "_top"), (F.col(image) == F.col("_i")) & (F.col(value) == F.col("_top")))
    at = at.select(F.col("_i"), F.col("_c"))
    j = top.join(at, F.col(image) == F.col("_i"))
    share = F.col("_c") / F.col("_n")
    return j.select(image, "sd", share.alias("share_at_max"), (F.col("sd") < 1e-3).alias("is_blank"),
                    ((F.col("sd") >= 1e-3) & (share > 0.95)).alias("is_saturated"))


def percentile_stretch(pixels: DataFrame, low: float, high: float, image="image_id", value="value", sparse: bool = False,
                       y="y", x="x", name: str = "stretched") -> DataFrame:
    """Clip to two percentiles of the image and scale to 0..1.

    ``sparse`` takes the percentiles on every fourth row and column and maps a flat image to zero.
    """
    v = num(value)
    base = pixels.filter((F.col(y) % 4 == 0) & (F.col(x) % 4 == 0)) if sparse else pixels
    ends = group_summary(base, [image], {"_lo": (v, low / 100.0), "_hi": (v, high / 100.0)})
    j = pixels.join(ends.withColumnRenamed(image, "_i"), F.col(image) == F.col("_i"), "left")
    span = F.col("_hi") - F.col("_lo")
    scaled = (F.least(F.greatest(v, F.col("_lo")), F.col("_hi")) - F.col("_lo")) / F.greatest(span, F.lit(1e-6))
    if sparse:
        scaled = F.when(span <= 1e-6, F.lit(0.0)).otherwise(scaled)
    return j.withColumn(name, scaled).drop("_i", "_lo", "_hi")


def otsu_thresholds(pixels: DataFrame, image="image_id", value="value") -> DataFrame:
    """8-bit threshold per image that maximises the variance between the two classes."""
    level = F.least(F.greatest(F.floor(F.col(value)), F.lit(0)), F.lit(255)).cast("bigint")
    hist = pixels.groupBy(image, level.alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(image).orderBy("_l").rowsBetween(Window.unboundedPreceding, 0)   # at most 256 rows
    whole = Window.partitionBy(image)
    h = hist.select(image, "_l", F.sum("_n").over(upto).alias("_w0"), F.sum(F.col("_n") * F.col("_l")).over(upto).alias("_s0"),
                    F.sum("_n").over(whole).alias("_w"), F.sum(F.col("_n") * F.col("_l")).over(whole).alias("_s"))
    w0, w1 = F.col("_w0").cast("double"), (F.col("_w") - F.col("_w0")).cast("double")
    gap = F.col("_s0") / w0 - (F.col("_s") - F.col("_s0")) / F.nullif(w1, F.lit(0.0))
    between = F.when(w1 > 0, w0 * w1 * gap * gap)
    return h.withColumn("_b", between).groupBy(image).agg(
        F.coalesce(F.max_by("_l", F.when(F.col("_b").isNotNull(), F.struct(F.col("_b"), -F.col("_l")))), F.max("_l")).alias("threshold"))


def strip_pixels(pixels: DataFrame, height: Column, width: Column, clearance: Column, y="y", x="x") -> DataFrame:
    """Pixels outside the excluded border strip (rows and columns up to the clearance, inclusive)."""
    c = clearance
    inside = (F.col(y) > c) & (F.col(y) < height - 1 - c) & (F.col(x) > c) & (F.col(x) < width - 1 - c)
    return pixels.filter(F.when(c <= 0, True).otherwise(inside))


def connected_regions(pixels: DataFrame, image="image_id", y="y", x="x") -> DataFrame:
    """Label 8-connected regions of a set of pixels, numbered in scan order per image.

    Pixels become horizontal runs first; only runs that touch in adjacent rows are linked, so the
    graph is far smaller than the raster.
    """
    row = Window.partitionBy(image, y).orderBy(x)
    new = F.when(F.coalesce(F.lag(x, 1).over(row) == F.col(x) - 1, F.lit(False)), 0).otherwise(1)
    marked = pixels.select(image, y, x).withColumn("_new", new)
    runs_px = marked.withColumn("_run", F.sum("_new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs_px.groupBy(image, y, "_run").agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"))
    node = lambda p: F.struct(F.col(p + image).alias("i"), F.col(p + y).alias("r"), F.col(p + "_x0").alias("c"))
    up = runs.select(*[F.col(c).alias("u" + c) for c in runs.columns])
    dn = runs.select(*[F.col(c).alias("d" + c) for c in runs.columns])
    # touching runs of adjacent rows share a block of 64 columns (or sit on its edge)
    cut = lambda df, p: df.withColumn(p + "_blk", F.explode(F.sequence(
        F.floor((F.col(p + "_x0") - 1) / 64), F.floor((F.col(p + "_x1") + 1) / 64))))
    links = cut(up, "u").join(cut(dn, "d"), (F.col("u" + image) == F.col("d" + image)) & (F.col("u" + y) + 1 == F.col("d" + y))
                              & (F.col("u_blk") == F.col("d_blk"))
                              & (F.col("u_x0") <= F.col("d_x1") + 1) & (F.col("d_x0") <= F.col("u_x1") + 1))
    edges = links.select(node("u").alias("_p"), node("d").alias("_q")).distinct()
    comp = connected_components(runs.select(node("").alias("_node")), edges, "_node", "_p", "_q")
    heads = comp.select(F.col("component")).distinct().select(F.col("component"), F.col("component.i").alias("_i"),
                                                              F.col("component.r").alias("_r"), F.col("component.c").alias("_c"))
    heads = row_numbers(heads, ["_i"], ["_r", "_c"], "label")
    named = comp.join(heads.select("component", "label"), "component").select(
        F.col("_node.i").alias("_i"), F.col("_node.r").alias("_r"), F.col("_node.c").alias("_c"), "label")
    flat = runs.join(named, (F.col(image) == F.col("_i")) & (F.col(y) == F.col("_r")) & (F.col("_x0") == F.col("_c"))).select(
        F.col(image), F.col(y), "_run", "label")
    return runs_px.join(flat, [image, y, "_run"]).select(image, y, x, "label")


def largest_region(regions: DataFrame, image="image_id", label="label") -> DataFrame:
    """Pixels of the largest region of each image (the first in scan order on a tie)."""
    size = regions.groupBy(image, label).agg(F.count(F.lit(1)).alias("_n"))
    best = size.groupBy(image).agg(F.max_by(label, F.struct(F.col("_n"), -F.col(label))).alias("_best"))
    return regions.join(best.withColumnRenamed(image, "_i"), (F.col(image) == F.col("_i")) & (F.col(label) == F.col("_best"))).drop("_i", "_best")


def field_extent(foreground: DataFrame, nuclei: DataFrame, px_um: float, image="image_id", y="y", x="x",
                 min_px: int = MIN_EXTENT_PX, method: str = "actin_threshold", fields: DataFrame | None = None) -> DataFrame:
    """Area, volume, centre and radius of each field's main structure.

    ``actin_threshold``: the largest connected region of the thresholded pixels; below ``min_px``
    pixels the convex hull of the nuclei replaces it and the fallback is recorded.
    ``nuclei_convex_hull``: always the hull. ``fields`` (image, image_h, image_w) adds a row with method
    ``none`` and the image centre for fields that have neither.
    """
    if method not in ("actin_threshold", "nuclei_convex_hull"):
        raise ValueError(f"unknown extent method {method!r}")
    hull = hull_areas(nuclei, [image], y, x).select(F.col(image).alias("_hi"), "hull_px", "hull_cy", "hull_cx")
    main = largest_region(connected_regions(foreground, image, y, x), image).groupBy(image).agg(
        F.count(F.lit(1)).alias("_a"), F.avg(y).alias("_cy"), F.avg(x).alias("_cx"))
    j = main.join(hull, F.col(image) == F.col("_hi"), "full_outer").withColumn("_img", F.coalesce(F.col(image), F.col("_hi"))).drop(image, "_hi")
    centre_y = centre_x = F.lit(None).cast("double")
    if fields is not None:
        j = fields.select(F.col(image).alias("_all"), "image_h", "image_w").join(j, F.col("_all") == F.col("_img"), "left").withColumn("_img", F.col("_all"))
        centre_y, centre_x = F.col("image_h") / 2.0 * px_um, F.col("image_w") / 2.0 * px_um
    always = method == "nuclei_convex_hull"
    weak = F.lit(True) if always else F.coalesce(F.col("_a"), F.lit(0)) < min_px
    use_hull = weak & F.col("hull_px").isNotNull()
    own = F.lit(None).cast("bigint") if always else F.col("_a")
    area = F.when(use_hull, F.col("hull_px")).otherwise(own).cast("double")
    um2 = area * px_um * px_um
    centre = lambda a, b, c: F.when(use_hull, F.col(b) * px_um).when(own > 0, F.col(a) * px_um).otherwise(c)
    hull_name = "nuclei_convex_hull" if always else "nuclei_convex_hull_fallback"
    name = F.when(use_hull, hull_name).when(own > 0, "actin_threshold").otherwise("none")
    return j.select(F.col("_img").alias(image), area.cast("bigint").alias("area_px"), um2.alias("area_um2"),
                    centre("_cy", "hull_cy", centre_y).alias("centroid_y_um"), centre("_cx", "hull_cx", centre_x).alias("centroid_x_um"),
                    F.sqrt(um2 / F.pi()).alias("max_radius_um"), sphere_volume(disk_diameter(um2)).alias("volume_um3"), name.alias("method"),
                    (use_hull & F.lit(not always)).alias("hull_fallback"))


def disk_offsets(radius: int, square: bool = False) -> Column:
    """Array of the offsets of an elliptic (row-wise rounded) or square neighbourhood.

    Its length depends on the radius only.
    """
    radius = max(1, radius)
    cells = []
    for dy in range(-radius, radius + 1):
        half = radius if square else int(round(radius * max(0.0, 1.0 - (dy / radius) ** 2) ** 0.5))
        cells += [(dy, dx) for dx in range(-half, half + 1)]
    return F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in cells])


def ring_contrast(pixels: DataFrame, objects: DataFrame, radius: int = 15, square: bool = False, image="image_id",
                  y="y", x="x", value="value", label="label") -> DataFrame:
    """Mean inside each object, mean of the ring around it and their contrast.

    Only boundary pixels need to be grown: a ring pixel is never inside an object, so the nearest
    object pixel is always on the boundary. Without ring pixels the image median is used.
    """
    wx, wy = Window.partitionBy(image, label, y).orderBy(x), Window.partitionBy(image, label, x).orderBy(y)
    near = lambda w, c, k: F.coalesce(F.lag(c, k).over(w) == F.col(c) - k, F.lit(False))
    edge = (objects.select(image, label, y, x)
            .withColumn("_h", near(wx, x, 1) & near(wx, x, -1)).withColumn("_v", near(wy, y, 1) & near(wy, y, -1))
            .filter(~(F.col("_h") & F.col("_v"))))
    ring = edge.withColumn("_s", F.explode(disk_offsets(radius, square))).select(
        image, label, (F.col(y) + F.col("_s.dy")).alias(y), (F.col(x) + F.col("_s.dx")).alias(x)).distinct()
    ring = ring.join(objects.select(image, y, x), [image, y, x], "left_anti")
    vals = pixels.select(image, y, x, num(value).alias("_val"))
    outside = ring.join(vals, [image, y, x]).groupBy(image, label).agg(F.avg("_val").alias("mean_ring"), F.count(F.lit(1)).alias("n_ring"))
    inside = objects.select(image, label, y, x).join(vals, [image, y, x]).groupBy(image, label).agg(F.avg("_val").alias("mean_interior"))
    med = group_summary(pixels, [image], {"_med": (num(value), 0.5)})
    j = inside.join(outside, [image, label], "left").join(med, image, "left")
    ring_mean = F.coalesce("mean_ring", "_med")
    return j.select(image, label, "mean_interior", ring_mean.alias("mean_ring"), F.coalesce("n_ring", F.lit(0)).cast("bigint").alias("n_ring"),
                    ((ring_mean - F.col("mean_interior")) / F.greatest(ring_mean, F.lit(1e-4))).alias("contrast_ratio"))


def blank_reference(blanks: DataFrame, y="y", x="x", value="value") -> DataFrame:
    """Median of every pixel position over the blank images."""
    return group_summary(blanks, [y, x], {"blank": (num(value), 0.5)})


def subtract_blank(pixels: DataFrame, reference: DataFrame, image="image_id", y="y", x="x", value="value", name: str = "corrected") -> DataFrame:
    """Subtract the reference and clip at zero; images of another shape than the reference stay as they are."""
    shape = lambda df, by: df.groupBy(*by).agg(F.max(y).alias("_my"), F.max(x).alias("_mx"), F.count(F.lit(1)).alias("_np"))
    ref_shape = reference.agg(F.struct(F.max(y).alias("a"), F.max(x).alias("b"), F.count(F.lit(1)).alias("n"))).scalar()
    fits = shape(pixels, [image]).withColumn("_r", ref_shape).filter(
        (F.col("_my") == F.col("_r.a")) & (F.col("_mx") == F.col("_r.b")) & (F.col("_np") == F.col("_r.n"))).select(
        F.col(image).alias("_i"))
    j = pixels.join(fits, F.col(image) == F.col("_i"), "left").join(
        reference.select(F.col(y).alias("_y"), F.col(x).alias("_x"), "blank").hint("merge"), (F.col(y) == F.col("_y")) & (F.col(x) == F.col("_x")), "left")
    applied = F.col("_i").isNotNull()
    v = num(value)
    return j.withColumn(name, F.when(applied, F.greatest(v - F.col("blank"), F.lit(0.0))).otherwise(v)).withColumn(
        "blank_applied", applied).drop("_i", "_y", "_x", "blank")


def compact_labels(pixels: DataFrame, image="image_id", label="label", name: str = "new_label") -> DataFrame:
    """Renumber the labels of each image 1, 2, ... in label order; background (0) stays 0."""
    names = pixels.filter(F.col(label) > 0).select(image, label).distinct()
    names = row_numbers(names, [image], [label], name)
    j = pixels.join(names.select(F.col(image).alias("_i"), F.col(label).alias("_l"), name),
                    (F.col(image) == F.col("_i")) & (F.col(label) == F.col("_l")), "left").drop("_i", "_l")
    return j.withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("bigint"))


def mask_kind(pixels: DataFrame, image="image_id", value="value", eight_bit: bool = True, max_labels: int = 1000) -> DataFrame:
    """Whether a mask image is a label image (labels exactly 1..K, 2 <= K <= 1000) or a drawing.

    ``threshold`` is the value above which a drawing counts as foreground: half its maximum, or zero
    when it has at most two values.
    """
    vals = pixels.groupBy(image, value).agg(F.count(F.lit(1)).alias("_n"))
    v = F.col(value)
    s = vals.groupBy(image).agg(
        F.count_if(v > 0).alias("_k"), F.max(v).alias("_top"), F.count(F.lit(1)).alias("n_values"),
        F.bool_and(v == F.floor(v)).alias("_int"), F.min(F.when(v > 0, v)).alias("_first"))
    k = F.col("_k")
    is_label = F.col("_int") & (k >= 2) & (k <= max_labels) & (F.col("_first") == 1) & (F.col("_top") == k)
    if eight_bit:
        is_label = is_label & (F.col("_top") != 255)
    threshold = F.when(F.col("n_values") <= 2, F.lit(0.0)).otherwise(F.col("_top") / 2.0)
    return s.select(image, is_label.alias("is_label_image"), F.col("n_values").cast("bigint").alias("n_values"),
                    F.when(~is_label, threshold).alias("threshold"))


def read_mask(pixels: DataFrame, image="image_id", y="y", x="x", value="value", eight_bit: bool = True) -> DataFrame:
    """Labels of mask images: kept as they are for label images, connected regions for drawings."""
    kind = mask_kind(pixels, image, value, eight_bit).withColumnRenamed(image, "_i")
    j = pixels.join(kind, F.col(image) == F.col("_i")).drop("_i")
    kept = j.filter(F.col("is_label_image") & (F.col(value) > 0)).select(image, y, x, F.col(value).cast("bigint").alias("label"))
    drawn = j.filter(~F.col("is_label_image") & (F.col(value) > F.col("threshold")))
    return kept.unionByName(connected_regions(drawn, image, y, x).withColumn("label", F.col("label").cast("bigint")))


def relabel_with(pixels: DataFrame, producer, schema: str, image: str = "image_id") -> DataFrame:
    """Run a caller's segmentation function image by image (pandas in, pandas out).

    The package brings no model; one image is the natural unit of such a function.
    """
    return pixels.groupBy(image).applyInPandas(producer, schema)
