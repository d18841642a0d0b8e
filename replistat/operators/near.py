"""Spatial near-joins: all pairs closer than a per-pair limit, as an equi-join on grid cells.

Each object has a reach; the limit of a pair never exceeds the larger reach of its two ends. Reaches are
rounded up to powers of two, the levels; a pair is met at the higher level of its ends, on a grid with cells of twice
that length. One side waits in its own cell at each level in use from its own up, the side with fewer rows looks into the
four cells that its surroundings can touch. One grid per level keeps a few very large objects from blowing up the cells of all others.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage


#: The length of a level in its cells, with room for rounding.
_HALF = 0.5 + 1e-9


def _level(reach: Column) -> Column:
    return F.ceil(F.log2(F.greatest(reach, F.lit(1e-9)))).cast("int")


def _place(v: Column, level: Column) -> Column:
    """Coordinate in cells of a level."""
    return v / F.pow(F.lit(2.0), level + 1)


def _tag(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def near_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    x: str,
    y: str,
    reach: str,
    limit: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    extra: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None,
    stored: bool = False,
) -> DataFrame:
    """Pairs ``a_*``/``b_*`` with ``distance <= limit`` inside equal ``keys``.

    ``limit`` and ``extra`` receive accessors for the two sides. ``stored`` says that both sides are cheap
    to read, else they are written once. The distance test is part of the join, so candidate pairs are never written out.
    """
    once = left if stored else cut_lineage(left)
    other = once if right is left else right if stored else cut_lineage(right)
    a, b = _tag(once, "a_"), _tag(other, "b_")
    pa = lambda c: F.col("a_" + c)
    pb = lambda c: F.col("b_" + c)
    # the grid levels in use: a handful of whole numbers, read as a scalar subquery
    levels = once.select(reach).unionByName(other.select(reach)).agg(F.collect_set(_level(F.col(reach))).alias("lv")).select("lv")
    left_seeks = right is not left and once.count() < other.count()
    a, b = _cells(a, "a_", x, y, reach, levels, left_seeks), _cells(b, "b_", x, y, reach, levels, not left_seeks)
    dist = F.sqrt(F.pow(pa(x) - pb(x), 2) + F.pow(pa(y) - pb(y), 2))
    on = [pa(k) == pb(k) for k in keys] + [F.col("a__" + c) == F.col("b__" + c) for c in ("lv", "cx", "cy")]
    on += [F.col("a__lv") == F.greatest("a__own", "b__own"), dist <= limit(pa, pb)]
    if extra is not None:
        on.append(extra(pa, pb))
    # rows are multiplied by their cells, which size estimates of stored tables don't show: never a broadcast
    joined = a.join(b.hint("merge"), reduce(lambda p, q: p & q, on))
    return joined.drop(*[p + c for p in ("a__", "b__") for c in ("own", "lv", "cx", "cy")]).withColumn("distance", dist)


def _cells(df: DataFrame, p: str, x: str, y: str, reach: str, levels: DataFrame, seek: bool) -> DataFrame:
    """Rows with their level and one cell per level in use from there up, or the cells around when they seek."""
    lv = F.col(p + "_lv")
    df = df.withColumn(p + "_own", _level(F.col(p + reach))).withColumn(p + "_lv", F.explode(levels.scalar())).filter(lv >= F.col(p + "_own"))
    for name, v in (("_cx", F.col(p + x)), ("_cy", F.col(p + y))):
        at = _place(v, lv)
        around = F.explode(F.sequence(F.floor(at - _HALF), F.floor(at + _HALF)))
        df = df.filter(F.abs(v) < float("inf")).withColumn(p + name, around if seek else F.floor(at))
    return df
