"""Sizes, shapes and densities as column expressions. NULL means undefined; NaN becomes NULL."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

PI = math.pi


def num(c) -> Column:
    """A double column with NaN turned into NULL."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.nullif(c, F.lit(float("nan")))


def finite(c) -> Column:
    """A double column that is NULL unless the value is a finite number."""
    return F.nullif(F.nullif(num(c), F.lit(float("inf"))), F.lit(float("-inf")))


def clip_low(c, low: float = 0.0) -> Column:
    c = num(c)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def pixel_size(c, strict: bool = False) -> Column:
    """A usable pixel size (finite, above zero); otherwise NULL, or an error when ``strict``."""
    c = finite(c)
    ok = F.when(c > 0, c)
    if strict:
        return F.coalesce(ok, F.raise_error(F.lit("pixel size must be a finite positive number")).cast("double"))
    return ok


def sphere_volume(d) -> Column:
    return F.lit(PI / 6.0) * F.pow(clip_low(d), F.lit(3.0))


def ellipsoid_volume(major, minor) -> Column:
    return F.lit(PI / 6.0) * clip_low(major) * F.pow(clip_low(minor), F.lit(2.0))


def disk_diameter(area) -> Column:
    """Diameter of the disk with this area."""
    return F.lit(2.0) * F.sqrt(clip_low(area) / F.lit(PI))


def area_to_volume(area) -> Column:
    return sphere_volume(disk_diameter(area))


def volume_to_diameter(volume) -> Column:
    return F.pow(F.lit(6.0) * clip_low(volume) / F.lit(PI), F.lit(1.0 / 3.0))


def equivalent_diameter(area_px, px_um) -> Column:
    return disk_diameter(area_px) * pixel_size(px_um)


def px_to_um(px, px_um) -> Column:
    return num(px) * pixel_size(px_um)


def um_to_px(um, px_um) -> Column:
    return num(um) / pixel_size(px_um)


def volume_discrepancy(sphere, ellipsoid) -> Column:
    s, e = clip_low(sphere), clip_low(ellipsoid)
    return F.abs(s - e) / clip_low(s, 1e-6)


def circularity(area_px, perimeter_px) -> Column:
    raw = F.lit(4.0 * PI) * clip_low(area_px) / F.pow(clip_low(perimeter_px, 1e-4), F.lit(2.0))
    return F.when(num(area_px).isNotNull() & num(perimeter_px).isNotNull(), F.least(raw, F.lit(1.0)))


def areal_density(n, area_um2) -> Column:
    """Objects per square millimetre; NULL without a positive area."""
    a = num(area_um2)
    return F.when(a > 0, num(n) / (a * F.lit(1e-6)))


def volumetric_density(n, volume_um3, is_plane) -> Column:
    """Objects per cubic millimetre; a single plane has no volume, so it gives NULL."""
    v = num(volume_um3)
    flat = F.col(is_plane) if isinstance(is_plane, str) else is_plane
    return F.when(~flat & (v > 0), num(n) / v * F.lit(1e9))


def clearance_px(clearance_um, px_um) -> Column:
    """Border clearance in whole pixels: at least 1 when switched on, 0 when off."""
    c = num(clearance_um)
    px = F.bround(c / clip_low(px_um, 1e-6), 0).cast("bigint")
    return F.when(c <= 0, F.lit(0).cast("bigint")).otherwise(F.greatest(F.lit(1).cast("bigint"), px))


def object_measures(
    area_px="area_px", perimeter_px="perimeter_px", px_um="pixel_size_um",
    major_px=None, minor_px=None, solidity=None, eccentricity=None,
) -> dict[str, Column]:
    """Derived size and shape columns of an object, with the fallbacks for missing inputs."""
    scale = clip_low(px_um, 1e-6)
    area = num(area_px)
    perimeter = F.when(num(perimeter_px) > 0, num(perimeter_px)).otherwise(F.lit(1.0))
    d_px = disk_diameter(area)

    def axis(c) -> Column:
        if c is None:
            return d_px
        return F.when(num(c) > 0, num(c)).otherwise(d_px)

    def share(c, missing: float) -> Column:
        if c is None:
            return F.lit(missing)
        v = F.coalesce(num(c), F.lit(missing))
        return F.when(v > 1.0, F.lit(1.0)).otherwise(clip_low(v))

    major, minor = axis(major_px) * scale, axis(minor_px) * scale
    v_sphere, v_ell = sphere_volume(d_px * scale), ellipsoid_volume(major, minor)
    return {
        "equivalent_diameter_px": d_px,
        "area_um2": area * scale * scale,
        "equivalent_diameter_um": d_px * scale,
        "major_axis_um": major,
        "minor_axis_um": minor,
        "aspect_ratio": major / clip_low(minor, 1e-4),
        "volume_sphere_um3": v_sphere,
        "volume_ellipsoid_um3": v_ell,
        "volume_discrepancy_ratio": volume_discrepancy(v_sphere, v_ell),
        "circularity": circularity(area, perimeter),
        "solidity": share(solidity, 1.0),
        "eccentricity": share(eccentricity, 0.0),
    }


def growth(v0, v7, d0, d7) -> dict[str, Column]:
    """Change between two timepoints: differences, ratios, log2 ratio (NULL when not positive)."""
    v0, v7, d0, d7 = num(v0), num(v7), num(d0), num(d7)
    ratio = v7 / clip_low(v0, 1e-6)
    return {
        "delta_volume_um3": v7 - v0,
        "fold_change_volume": ratio,
        "log2_fold_change": F.when((v7 > 0) & (ratio > 0), F.log2(ratio)),
        "delta_diameter_um": d7 - d0,
        "fold_change_diameter": d7 / clip_low(d0, 1e-6),
    }


def unit_scaled(value, image_max, is_integer: bool = True) -> Column:
    """Pixel value on 0..1 by bit depth; ``image_max`` is the largest value of the image."""
    top = num(image_max)
    if is_integer:
        divisor = F.when(top <= 255.0, F.lit(255.0)).otherwise(top)
    else:
        divisor = F.when(top <= 1.0, F.lit(1.0)).otherwise(top)
    scaled = clip_low(value) / clip_low(divisor, 1e-6)
    return F.when(scaled > 1.0, F.lit(1.0)).otherwise(scaled)


def eight_bit(value, image_max, is_integer: bool = True) -> Column:
    return F.bround(unit_scaled(value, image_max, is_integer) * 255.0, 0)


def luma(r, g, b) -> Column:
    """Grey value of a colour pixel (fixed weights 0.299, 0.587, 0.114)."""
    return num(r) * 0.299 + num(g) * 0.587 + num(b) * 0.114
