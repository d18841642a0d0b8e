"""File inventories: listings, image manifests, checksums and calibration columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.geometry import num
from ..functions.naming import file_stem, parse_channel, parse_field, parse_stem
from ..operators.matching import mark_matched
from ..operators.scan import first_per_key
from ..params import DEFAULT_PIXEL_UM


def list_images(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """TIFF files of a folder (any letter case) as ``path, length`` and, on request, ``content``.

    Without ``content`` the reader lists files only and opens none of them.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[tT][iI][fF]*").load(folder)
    files = files.filter(F.lower("path").rlike(r"\.tiff?$"))
    return files.select("path", "length", *(["content"] if content else []))


def parsed_names(paths: DataFrame, path: str = "path", folder_timepoint: Column | str | None = None) -> DataFrame:
    """Every readable file with the parts of its name; several may share a (pair key, timepoint)."""
    parsed = paths.withColumn("_m", parse_stem(file_stem(path), folder_timepoint)).filter(F.col("_m.error").isNull())
    rest = [c for c in paths.columns if c != path]
    return parsed.select(F.col(path).alias("file_path"), *rest, "_m.image_id", "_m.timepoint", "_m.timepoint_day",
                         "_m.condition", "_m.replicate", "_m.fov", "_m.pair_key")


def image_manifest(paths: DataFrame, path: str = "path", folder_timepoint: Column | str | None = None) -> DataFrame:
    """The first file of every (pair key, timepoint), and whether the key is matched.

    Unreadable names are left out; ``rejected_names`` lists them with their reason.
    """
    flat = parsed_names(paths, path, folder_timepoint)
    return mark_matched(first_per_key(flat, ["pair_key", "timepoint"], ["file_path"]), "pair_key", "timepoint")


def rejected_names(paths: DataFrame, path: str = "path", folder_timepoint: Column | str | None = None) -> DataFrame:
    parsed = paths.withColumn("_m", parse_stem(file_stem(path), folder_timepoint))
    return parsed.filter(F.col("_m.error").isNotNull()).select(F.col(path).alias("file_path"), F.col("_m.error").alias("error"))


def as_bool(value: Column | str) -> Column:
    """True for true/1/yes in any case; NULL and everything else is False."""
    v = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.lower(F.trim(v.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def complete_manifest(manifest: DataFrame, calibration: DataFrame | None = None, content: str | None = None,
                      size: str = "length", default_um: float = DEFAULT_PIXEL_UM) -> DataFrame:
    """Add size, SHA-256 and scale columns; a missing scale comes from ``calibration`` or the default.

    The checksum is computed where the bytes are, inside the scan, and the bytes go no further.
    """
    out = manifest
    for name, kind in (("pixel_size_um", "double"), ("scale_source", "string"), ("is_calibrated", "string")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    own = F.col("is_calibrated").cast("string")
    if calibration is not None:
        c = calibration.select(F.col("image_id").alias("_ci"), F.col("pixel_size_um").alias("_px"),
                               F.col("scale_source").alias("_src"), F.col("is_calibrated").cast("string").alias("_cal"))
        out = out.join(c, F.col("image_id") == F.col("_ci"), "left")
        px, src, cal = F.coalesce(num("pixel_size_um"), "_px"), F.coalesce("scale_source", "_src"), F.coalesce(own, "_cal")
    else:
        px, src, cal = num("pixel_size_um"), F.col("scale_source"), own
    out = out.withColumns({
        "pixel_size_um": F.coalesce(px, F.lit(float(default_um))),
        "scale_source": F.coalesce(src, F.lit("default_fallback")),
        "is_calibrated": as_bool(cal),
        "file_size_bytes": F.coalesce(F.col(size).cast("bigint"), F.lit(0).cast("bigint")) if size in out.columns else F.lit(0).cast("bigint"),
        "sha256": F.sha2(F.col(content), 256) if content else F.lit("skipped"),
    })
    return out.drop("_ci", "_px", "_src", "_cal", *( [content] if content else []))


def channel_inventory(names: DataFrame, name: str = "name") -> DataFrame:
    """File names with base, channel and the parts of the field name."""
    return names.withColumn("_c", parse_channel(name)).select(*names.columns, "_c.base", "_c.channel").withColumn(
        "_f", parse_field("base")).select(*names.columns, "base", "channel", "_f.*")


def shape_text(shape: Column | str) -> Column:
    """``HxW`` text of a shape array."""
    s = F.col(shape) if isinstance(shape, str) else shape
    return F.array_join(F.transform(s, lambda n: n.cast("string")), "x")


def shape_kind(shape: Column | str) -> Column:
    """2D, RGB or 3D from the dimensions of an image."""
    s = F.col(shape) if isinstance(shape, str) else shape
    n = F.size(s)
    planes = F.forall(F.slice(s, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda d: d == 1)
    rgb = (n == 3) & F.element_at(s, -1).isin(3, 4) & (F.element_at(s, 1) > 4)
    return F.when(n == 2, "2D").when(rgb, "RGB").when(planes, "2D").otherwise("3D")
