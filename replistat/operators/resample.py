"""Resampling statistics at the level of the replicate, with keyed draws instead of a random stream.

Every draw is a hash of seed, replicate and slot, so results do not depend on row order,
partitioning or retries after a lost executor. They agree with a seeded generator in distribution.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import finite
from ..session import cut_lineage
from .draws import drawn_sums
from .scan import group_summary, row_numbers, running
from .splitting import order_statistics, split_medians

TOLERANCE = 1e-12
_BLOCK = 65536


def keyed_draw(n: Column, *parts) -> Column:
    """Whole number in ``0 .. n-1`` that depends only on ``parts``."""
    text = F.concat_ws("|", *[(F.lit(p) if not isinstance(p, Column) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % n


def _spread(df: DataFrame, count: str, name: str, by: Sequence[str]) -> DataFrame:
    """``count`` rows per input row numbered from 0, in blocks so that one row never explodes at once."""
    last = F.col(count) - 1
    blocks = df.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(_BLOCK).cast("bigint"))))
    blocks = blocks.repartition(*by, "_from")
    return blocks.withColumn(name, F.explode(F.sequence(F.col("_from"), F.least(last, F.col("_from") + (_BLOCK - 1))))).drop("_from")


def unit_summary(df: DataFrame, units: Sequence[str], value: str, agg: str | Callable[[Column], Column] = "median") -> DataFrame:
    """One row per unit: ``unit_value`` (median, mean or a caller's aggregate) and ``n_obs``."""
    v = finite(value)
    n = F.count(v).alias("n_obs")
    if agg == "median":
        return group_summary(df, units, {"unit_value": (v, 0.5)}, [n])
    how = F.avg if agg == "mean" else agg
    return df.groupBy(*units).agg(how(v).alias("unit_value"), n)


def bootstrap_interval(df: DataFrame, group: Sequence[str], cluster: str | None, value: str, n_boot: int = 2000,
                       level: float = 0.95, seed: int = 42, stat: Callable[[Column], Column] | None = None) -> DataFrame:
    """Percentile interval of a statistic (the median) under two-stage resampling.

    Draw as many clusters as there are, with replacement; inside each draw as many observations as
    it has. ``cluster=None`` resamples observations only. Clusters without finite values drop out.

    For the median no observation is drawn: counts of draws are split down the tree of values
    (``splitting``), so the work is replicates x clusters x depth. A caller's ``stat``, an aggregate of the drawn values,
    needs them all, so there each draw is a row; of the mean (``F.avg``) only sums are kept (``draws``).
    """
    group = list(group)
    rows = df.select(*group, (F.col(cluster) if cluster else F.lit("all")).cast("string").alias("_c"),
                     finite(value).alias("_x")).filter(F.col("_x").isNotNull() & F.col("_c").isNotNull())
    sizes = rows.groupBy(*group, "_c").agg(F.count(F.lit(1)).alias("_n"))
    sizes = row_numbers(sizes, group, ["_c"], "_ci")
    sizes = cut_lineage(sizes.withColumns({"_ci": F.col("_ci") - 1, "_id": F.monotonically_increasing_id()}))    # one row per cluster
    key = [F.col(g).cast("string") for g in group]

    plan = sizes.groupBy(*group).agg(F.count(F.lit(1)).alias("_k"))
    plan = plan.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    slots = _spread(plan, "_k", "_slot", [*group, "_rep"])
    slots = slots.withColumn("_ci", keyed_draw(F.col("_k"), seed, *key, F.col("_rep"), F.col("_slot")))
    if stat is None:
        times = slots.groupBy(*group, "_rep", "_ci").agg(F.count(F.lit(1)).alias("_m"))
        draws = cut_lineage(times.join(sizes, [*group, "_ci"]).select(*group, "_rep", "_c", (F.col("_m") * F.col("_n")).alias("_n")))
        total = draws.groupBy(*group, "_rep").agg(F.sum("_n").alias("_m"))
        middle = F.array(F.expr("(_m - 1) div 2"), F.expr("_m div 2"))
        wanted = total.select(*group, "_rep", F.posexplode(middle).alias("_t", "_k"))
        placed = row_numbers(rows, group, ["_x", "_c"], "_pos")
        placed = cut_lineage(placed.withColumn("_pos", F.col("_pos") - 1))
        est = order_statistics(placed, draws, wanted, group, seed).groupBy(*group, "_rep").agg(((F.min("_x") + F.max("_x")) / 2).alias("_t"))
    elif stat in (F.avg, F.mean):
        chosen = slots.join(sizes, [*group, "_ci"])
        prefix = F.concat_ws("|", F.lit(str(seed)), *key, F.col("_rep").cast("string"), F.col("_slot").cast("string"), F.lit(""))
        est = drawn_sums(rows, sizes, chosen, group, prefix).withColumn("_t", F.col("_s") / F.col("_m"))
    else:
        chosen = slots.join(sizes, [*group, "_ci"])
        draws = _spread(chosen.drop("_k", "_ci"), "_n", "_o", [*group, "_rep", "_slot"])
        draws = draws.withColumn("_xi", keyed_draw(F.col("_n"), seed, *key, F.col("_rep"), F.col("_slot"), F.col("_o")))
        # equal values are interchangeable, so the position by value is a complete index
        placed = row_numbers(rows, [*group, "_c"], ["_x"], "_xi")
        draws = draws.select(*group, "_rep", "_c", F.col("_xi") + 1)
        draws = draws.toDF(*group, "_rep", "_c", "_xi")
        # all observations, in few compressed bytes: never a broadcast
        est = draws.join(placed.hint("merge"), [*group, "_c", "_xi"]).groupBy(*group, "_rep").agg(stat(F.col("_x")).alias("_t"))
    tail = (1.0 - level) / 2.0
    return est.groupBy(*group).agg(
        F.percentile("_t", F.lit(tail)).alias("ci_low"), F.percentile("_t", F.lit(1.0 - tail)).alias("ci_high"),
        F.count(F.lit(1)).alias("n_boot"))


def _median_of(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    low = F.element_at(s, F.floor((n + 1) / 2).cast("int"))
    return (low + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2.0


def _subsets(n: Column, k: Column) -> Column:
    """All index sets of size ``k`` out of ``0 .. n-1`` as one array of arrays."""
    def grow(acc: Column, i: Column) -> Column:
        longer = F.transform(F.filter(acc, lambda s: F.size(s) < k), lambda s: F.array_append(s, i))
        return F.filter(F.concat(acc, longer), lambda s: F.size(s) + (n - 1 - i) >= k)

    empty = F.array(F.array().cast("array<int>"))
    return F.aggregate(F.sequence(F.lit(0), n - 1), empty, grow)


def log_choose(n: Column, k: Column) -> Column:
    """Natural logarithm of the number of ``k``-subsets."""
    ln = lambda upto: F.aggregate(
        F.when(upto >= 1, F.sequence(F.lit(1).cast("bigint"), upto)).otherwise(F.array().cast("array<bigint>")),
        F.lit(0.0), lambda acc, x: acc + F.log(x.cast("double")))
    n, k = n.cast("bigint"), k.cast("bigint")
    return ln(n) - ln(k) - ln(n - k)


def permutation_test(df: DataFrame, group: str, cluster: str, value: str, control: str,
                     n_perm: int = 10000, seed: int = 42, exact_limit: int = 2000) -> DataFrame:
    """Each group against the control: difference of medians of unit medians under relabelling of units.

    Few relabellings are enumerated, otherwise ``n_perm`` keyed ones are drawn. Columns: group,
    ``obs_diff``, ``p_raw``, ``min_p``, ``n_ref``, ``n_treat``, ``method``. Groups with fewer than two
    units, or without a control of two, get NULL p-values.
    """
    units = unit_summary(df.filter(F.col(cluster).isNotNull()), [group, cluster], value, "median")
    units = units.filter(F.col("unit_value").isNotNull()).select(
        F.col(group).alias("_g"), F.col(cluster).cast("string").alias("_u"), F.col("unit_value").alias("_x"))
    units = cut_lineage(units)   # one row per unit, read several times below
    return _permute(df.select(F.col(group).alias("_g")).distinct(), units, group, control, n_perm, seed, exact_limit)


def _permute(groups, units, group, control, n_perm, seed, exact_limit) -> DataFrame:
    ref = units.filter(F.col("_g") == control)
    n_ref = ref.agg(F.count(F.lit(1)).alias("n")).scalar()
    med = cut_lineage(group_summary(units, ["_g"], {"_m": (F.col("_x"), 0.5)}, [F.count(F.lit(1)).alias("_nt")]))
    ref_m = med.filter(F.col("_g") == control).select("_m").scalar()
    tests = (
        groups.filter(F.col("_g") != control).join(med.withColumnRenamed("_g", "_gm"), F.col("_g") == F.col("_gm"), "left")
        .select(F.col("_g").alias("_t"), F.coalesce("_nt", F.lit(0)).alias("n_treat"), "_m")
        .withColumn("n_ref", n_ref).withColumn("_rm", ref_m)
        .withColumn("obs_diff", F.abs(F.col("_m") - F.col("_rm"))))
    usable = (F.col("n_ref") >= 2) & (F.col("n_treat") >= 2)
    total = F.col("n_ref") + F.col("n_treat")
    tests = tests.withColumn("_lc", F.when(usable, log_choose(total, F.col("n_ref"))))
    exact = F.col("_lc") <= math.log(exact_limit + 0.5)
    tests = cut_lineage(tests.withColumn("_exact", exact))     # one row per group

    mine = tests.join(units, F.col("_t") == F.col("_g")).withColumn("_is_ref", F.lit(0))
    shared = tests.withColumn("_ctl", F.lit(control)).join(ref, F.col("_ctl") == F.col("_g")).drop("_ctl").withColumn("_is_ref", F.lit(1))
    pool = mine.unionByName(shared)

    # at most 63 units when the number of relabellings is within the limit
    arrays = pool.filter("_exact").groupBy("_t", "n_ref", "n_treat", "obs_diff").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(F.lit(1) - F.col("_is_ref"), "_u", "_x"))), lambda s: s["_x"]).alias("_v"))
    k = F.least("n_ref", "n_treat").cast("int")
    each = arrays.withColumn("_s", F.explode(_subsets(F.size("_v"), k))).withColumn(
        "_in", F.transform("_s", lambda i: F.get("_v", i))).withColumn(
        "_out", F.filter("_v", lambda x, i: ~F.array_contains("_s", i)))
    diffs = each.select("_t", "obs_diff", F.abs(_median_of(F.col("_out")) - _median_of(F.col("_in"))).alias("_d"))
    top = diffs.groupBy("_t").agg(F.max("_d").alias("_top")).withColumnRenamed("_t", "_t2")
    enumerated = diffs.join(top, F.col("_t") == F.col("_t2")).groupBy("_t").agg(
        F.avg((F.col("_d") >= F.col("obs_diff") - TOLERANCE).cast("double")).alias("_p"),
        F.avg((F.col("_d") >= F.col("_top") - TOLERANCE).cast("double")).alias("_f"))

    many = pool.filter(~F.col("_exact")).withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
    who = F.concat_ws("|", F.lit(str(seed)), F.col("_rep").cast("string"), F.col("_g"), F.col("_u"))
    shuffled = row_numbers(many.withColumn("_h", F.md5(who)), ["_t", "_rep"], ["_h"], "_pos")
    sides = group_summary(shuffled.withColumn("_side", F.when(F.col("_pos") <= F.col("n_ref"), 0).otherwise(1)),
                          ["_t", "_rep", "_side"], {"_sm": (F.col("_x"), 0.5)}, [F.first("obs_diff").alias("obs_diff")])
    drawn = sides.groupBy("_t", "_rep").agg(F.abs(F.max(F.when(F.col("_side") == 1, F.col("_sm")))
                                                  - F.max(F.when(F.col("_side") == 0, F.col("_sm")))).alias("_d"),
                                            F.first("obs_diff").alias("obs_diff"))
    sampled = drawn.groupBy("_t").agg(
        ((F.count_if(F.col("_d") >= F.col("obs_diff") - TOLERANCE) + 1) / F.lit(n_perm + 1.0)).alias("_p"))
    floor = F.when(F.col("n_ref") == F.col("n_treat"), 2.0).otherwise(1.0) / F.exp("_lc")
    sampled = sampled.withColumn("_f", F.lit(None).cast("double"))
    kinds = {row[0] for row in tests.select("_exact").distinct().collect()}      # at most three values
    found = enumerated if False not in kinds else sampled if True not in kinds else enumerated.unionByName(sampled)
    found = found.withColumnRenamed("_t", "_t3")
    out = tests.join(found, F.col("_t") == F.col("_t3"), "left")
    low = F.when(usable, F.coalesce("_f", floor))
    method = F.when(~usable, "untested").when(F.col("_exact"), "exact").otherwise("monte_carlo")
    return out.select(F.col("_t").alias(group), "obs_diff", F.greatest("_p", low).alias("p_raw"), low.alias("min_p"),
                      F.col("n_ref").cast("bigint").alias("n_ref"), F.col("n_treat").cast("bigint").alias("n_treat"),
                      method.alias("method"))


_TRIALS = 512


def observation_test(df: DataFrame, group: str, value: str, control: str, n_perm: int = 10000, seed: int = 42) -> DataFrame:
    """Monte Carlo permutation of single observations: p of the difference of medians to the control.

    A relabelling is a random choice of as many pooled observations as the group has. Its two medians
    are found by splitting that number down the tree of pooled positions (``splitting``), so the work is
    relabellings x depth, and observations are put in order once.
    """
    rows = df.select(F.col(group).alias("_g"), finite(value).alias("_x")).filter(F.col("_x").isNotNull())
    med = group_summary(rows, ["_g"], {"_m": (F.col("_x"), 0.5)}, [F.count(F.lit(1)).alias("_n")])
    med = cut_lineage(med)
    base = med.filter(F.col("_g") == control)
    tests = med.filter(F.col("_g") != control).select(F.col("_g").alias("_t"), F.col("_n").alias("_nt"), "_m").withColumn(
        "_rm", base.select("_m").scalar()).withColumn("obs_diff", F.abs(F.col("_m") - F.col("_rm")))
    mine = tests.select("_t", "_nt").join(rows, F.col("_t") == F.col("_g")).select("_t", "_x")
    ctl = tests.select("_t", F.lit(control).alias("_ctl")).join(rows, F.col("_ctl") == F.col("_g")).select("_t", "_x")
    placed = row_numbers(mine.unionByName(ctl), ["_t"], ["_x"], "_pos").withColumn("_pos", F.col("_pos") - 1)
    sizes = tests.withColumn("_n", F.col("_nt") + base.select("_n").scalar())
    trials = sizes.withColumn("_from", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1), F.lit(_TRIALS)))).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_t", "_from")
    trials = trials.withColumn("_rep", F.explode(F.sequence("_from", F.least(F.col("_from") + (_TRIALS - 1), F.lit(n_perm - 1)))))
    walk = F.pandas_udf(lambda name, n, t: pd.Series(list(split_medians(name.tolist(), n.to_numpy(), t.to_numpy()))), "array<bigint>")
    key = F.concat_ws("|", F.lit(str(seed)), F.col("_t").cast("string"), F.col("_rep").cast("string"))
    at = trials.select("_t", "_rep", "obs_diff", F.posexplode(walk(key, F.col("_n"), F.col("_nt"))).alias("_i", "_pos"))
    side = at.join(placed, ["_t", "_pos"]).groupBy("_t", "_rep").agg(
        *[F.sum(F.when(F.expr(f"_i div 2 = {i}"), F.col("_x")) / 2).alias(n) for i, n in enumerate(("_a", "_b"))], F.first("obs_diff").alias("obs_diff"))
    drawn = side.withColumn("_d", F.abs(F.col("_a") - F.col("_b")))
    return drawn.groupBy(F.col("_t").alias(group)).agg(
        F.first("obs_diff").alias("obs_diff"),
        ((F.count_if(F.col("_d") >= F.col("obs_diff") - TOLERANCE) + 1) / F.lit(n_perm + 1.0)).alias("p_raw"))


def adjust_pvalues(df: DataFrame, family: Sequence[str], p: str, method: str = "holm", name: str = "p_adj") -> DataFrame:
    """Holm or Benjamini-Hochberg adjustment inside each family; NULL stays NULL and does not count."""
    if method not in ("holm", "bh", "fdr_bh"):
        raise ValueError(f"unknown adjustment {method!r}")
    family = list(family)
    df = cut_lineage(df)     # p-values are costly and small: compute them once, not once per scan
    tested = df.filter(F.col(p).isNotNull())
    if family:
        m = tested.groupBy(*family).agg(F.count(F.lit(1)).alias("_m"))
        tested = tested.join(m, family)
    else:
        tested = tested.withColumn("_m", df.agg(F.count(p).alias("_m")).scalar())
    # equal p-values are adjusted alike, so any order of them will do, as long as a range can cut between them
    ranked = row_numbers(tested, family, [p, F.xxhash64(*tested.columns)], "_r")
    if method == "holm":
        ranked = ranked.withColumn("_c", (F.col("_m") - F.col("_r") + 1) * F.col(p))
        done = running(ranked, family, [p, "_r"], {"_a": ("max", F.col("_c"))})
    else:
        ranked = ranked.withColumn("_c", F.col("_m") / F.col("_r") * F.col(p))
        done = running(ranked, family, [F.col(p).desc(), F.col("_r").desc()], {"_a": ("min", F.col("_c"))})
    value = F.when(F.col("_m") <= 1, F.col(p)).otherwise(F.least(F.col("_a"), F.lit(1.0)))
    done = done.withColumn(name, value).drop("_m", "_r", "_c", "_a")
    rest = df.filter(F.col(p).isNull()).withColumn(name, F.lit(None).cast("double"))
    return done.unionByName(rest)
