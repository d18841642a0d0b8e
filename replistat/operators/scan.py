"""Running totals, positions and exact quantiles inside groups of any size.

A window partitioned by the group key sends a whole group to one task. Here rows are first dealt by
range of (group, whole order), so that a group of any size lies in as many partitions as its share of
the rows asks for, ties included, as the range boundaries are drawn from the whole order. Each partition
scans its part; one total per (group, partition) is accumulated and added back. The same code
serves every size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage, unless_large


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    parts = [left[k].eqNullSafe(right[prefix + k]) for k in keys]
    return reduce(lambda a, b: a & b, parts)


_COMBINE = {
    "sum": lambda before, here: F.coalesce(before, F.lit(0)) + here,
    "count": lambda before, here: F.coalesce(before, F.lit(0)) + here,
    "max": lambda before, here: F.greatest(before, here),
    "min": lambda before, here: F.least(before, here),
}
_AGG = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
_REACH = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    aggs: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Add running ``sum``/``count``/``max``/``min`` columns over ``order`` within ``keys``.

    With empty ``keys`` the scan is global. ``order`` has to be a total order for a repeatable result;
    columns may be descending. The range partition of every row is stored before it is used twice, as
    boundaries drawn anew would cut elsewhere.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = cut_lineage(df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    cell = [*keys, "_part"]
    inside = Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", *[_AGG[f](e).over(inside).alias("_w_" + n) for n, (f, e) in aggs.items()])

    totals = cut.groupBy(*cell).agg(*[_AGG[f](e).alias("_t_" + n) for n, (f, e) in aggs.items()])
    # one row per group and partition; without a group one row per partition
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias("_o_" + k) for k in cell],
        *[_REACH[f](F.col("_t_" + n)).over(before).alias("_b_" + n) for n, (f, e) in aggs.items()])
    # only the first group of a partition can have begun in an earlier one: fewer rows than partitions
    offsets = F.broadcast(offsets.filter(reduce(lambda p, q: p | q, [F.col("_b_" + n).isNotNull() for n in aggs])))
    joined = local.join(offsets, _same(local, offsets, cell, "_o_"), "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[_COMBINE[f](F.col("_b_" + n), F.col("_w_" + n)).alias(n) for n, (f, e) in aggs.items()])


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """Position 1, 2, ... of each row within its group."""
    return running(df, keys, order, {name: ("count", F.lit(1))})


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first whole row of every key, as a partial aggregate (no per-key window)."""
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("_row"))
    return best.select(*[F.col(k) if k in keys else F.col("_row")[k].alias(k) for k in df.columns])


def group_summary(
    df: DataFrame,
    keys: Sequence[str],
    quantiles: dict[str, tuple[Column, float]],
    aggs: Sequence[Column] = (),
    weight: Column | None = None,
) -> DataFrame:
    """One row per key: exact linear quantiles ``{name: (value, share)}`` next to plain aggregates.

    ``weight`` is a whole number of times that a row counts for the quantiles.

    The input is planned twice: for the plain aggregates, and for the distinct values with their
    counts (a partial aggregate). Quantiles come from running counts over those, so no task holds the
    values of a group.
    """
    base = df if keys else df.withColumn("_all", F.lit(0))
    group = list(keys) or ["_all"]
    value_names: dict[str, str] = {}
    values = []
    for name, (col, _) in quantiles.items():
        text = str(col)
        if text not in value_names:
            value_names[text] = f"_v{len(value_names)}"
            values.append(col.cast("double").alias(value_names[text]))
    spec = {n: (value_names[str(c)], float(p)) for n, (c, p) in quantiles.items()}
    counted = base.groupBy(*group).agg(*aggs) if aggs else base.select(*group).distinct()

    pairs = ", ".join(f"'{v}', `{v}`" for v in value_names.values())
    cell = [*group, "_name"]
    counts = (
        base.select(*group, *values, (F.lit(1) if weight is None else weight).cast("bigint").alias("_times")).select(*group, "_times", F.expr(f"stack({len(value_names)}, {pairs}) as (_name, _value)"))
        .filter(F.col("_value").isNotNull())
        .groupBy(*cell, "_value").agg(F.sum("_times").alias("_c"))
    )
    ends = cut_lineage(running(counts, cell, ["_value"], {"_end": ("sum", F.col("_c"))}))
    sizes = unless_large(cut_lineage(ends.groupBy(*[F.col(k).alias("_n_" + k) for k in cell]).agg(F.max("_end").alias("_n"))))
    wanted = F.array(*[F.struct(F.lit(n).alias("q"), F.lit(v).alias("v"), F.lit(p).alias("p")) for n, (v, p) in spec.items()])
    hits = (
        ends.join(sizes, _same(ends, sizes, cell, "_n_"))
        .withColumn("_q", F.explode(F.filter(wanted, lambda q: q["v"] == F.col("_name"))))
        .withColumn("_pos", F.col("_q.p") * (F.col("_n") - 1))
        .filter((F.ceil("_pos") >= F.col("_end") - F.col("_c")) & (F.floor("_pos") < F.col("_end")))
    )
    part = hits.groupBy(*group, F.col("_q.q").alias("_name_q")).agg(
        F.min("_value").alias("_lo"), F.max("_value").alias("_hi"), F.max("_pos").alias("_pos"))
    point = part.withColumn("_x", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_pos") - F.floor("_pos")))
    wide = point.groupBy(*[F.col(k).alias("_w_" + k) for k in group]).agg(
        *[F.max(F.when(F.col("_name_q") == n, F.col("_x"))).alias(n) for n in spec])
    out = counted.join(wide.hint("merge"), _same(counted, wide, group, "_w_"), "left").drop(*["_w_" + k for k in group])
    return out if keys else out.drop("_all")


def average_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values per group with their count and shared (tie-averaged) rank."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_tied"))
    scanned = running(counts, keys, [value], {"_end": ("sum", F.col("n_tied"))})
    return scanned.select(*keys, value, "n_tied",
                          (F.col("_end") - (F.col("n_tied") - 1) / F.lit(2.0)).alias("avg_rank"))
