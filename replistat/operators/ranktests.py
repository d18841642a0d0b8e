"""Rank tests: Wilcoxon signed rank and Mann-Whitney, rank correlation.

Rank sums come from tie-averaged ranks over distinct values; only the final p-value of each group
(a handful of numbers) uses a vectorised Python function, because Spark has no error function.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.geometry import finite
from .scan import average_ranks, running

# Fixed rules for the exact distribution; the column ``p_method`` tells which one a p-value comes from.
SIGNED_EXACT_MAX = 50           # signed rank: no ties, no zeros, at most this many pairs
TWO_SAMPLE_EXACT_MAX = 8        # two samples: no ties, the smaller one has at most this many values
TWO_SAMPLE_TABLE_MAX = 20_000_000   # and the product of the sizes, the length of the table, is at most this


def _p_values(kind: str):
    def signed(n, w, ties, exact):
        import math
        if n == 0:
            return 1.0
        if exact:
            ways = np.zeros(n * (n + 1) // 2 + 1)
            ways[0] = 1.0
            for r in range(1, n + 1):
                ways[r:] += ways[:-r].copy()
            tail = float(ways[: int(w) + 1].sum()) / 2.0 ** n
            return min(1.0, 2.0 * tail)
        mean, var = n * (n + 1) / 4.0, n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0
        return math.erfc(abs(w - mean) / math.sqrt(var) / math.sqrt(2.0)) if var > 0 else 1.0

    def two_sample(n1, n2, u, ties, exact):
        import math
        big = max(u, n1 * n2 - u)
        if exact:
            # numbers of rank sets by statistic are the coefficients of a Gaussian binomial; the lower tail is enough
            top = int(n1 * n2 - big)
            k, n = sorted((n1, n2))
            ways = np.zeros(top + 1)
            ways[0] = 1.0
            for i in range(1, k + 1):
                if n + i <= top:
                    ways[n + i:] -= ways[:top + 1 - n - i].copy()
                for r in range(min(i, top + 1)):
                    ways[r::i] = np.cumsum(ways[r::i])
            return min(1.0, 2.0 * float(ways.sum()) / math.comb(n1 + n2, n1))
        n = n1 + n2
        var = n1 * n2 / 12.0 * (n + 1 - ties / (n * (n - 1.0)))
        if var <= 0:
            return 1.0
        z = (big - n1 * n2 / 2.0 - 0.5) / math.sqrt(var)
        return min(1.0, math.erfc(z / math.sqrt(2.0)))

    if kind == "signed":
        @F.pandas_udf("double")
        def run(n: pd.Series, w: pd.Series, ties: pd.Series, exact: pd.Series) -> pd.Series:
            return pd.Series([signed(int(a), b, c, bool(d)) for a, b, c, d in zip(n, w, ties, exact)], dtype="float64")
    else:
        @F.pandas_udf("double")
        def run(n1: pd.Series, n2: pd.Series, u: pd.Series, ties: pd.Series, exact: pd.Series) -> pd.Series:
            return pd.Series([two_sample(int(a), int(b), c, d, bool(e)) for a, b, c, d, e in zip(n1, n2, u, ties, exact)],
                             dtype="float64")
    return run


def _named(df: DataFrame, exact) -> DataFrame:
    return df.withColumn("p_method", F.when(F.col("p_value").isNull(), "untested").when(exact, "exact").otherwise("normal"))


def signed_rank_sums(df: DataFrame, keys: Sequence[str], before: str, after: str) -> DataFrame:
    """Per key: pairs with both values, non-zero pairs, W+ and W-, and the tie term."""
    rows = df.select(*keys, (finite(after) - finite(before)).alias("_d")).filter(F.col("_d").isNotNull())
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"))
    nz = rows.filter(F.col("_d") != 0).withColumn("_a", F.abs("_d"))
    ranks = average_ranks(nz, keys, "_a")
    # signed counts per distinct size, so that the join and the sums are over distinct values
    signs = nz.groupBy(*keys, "_a").agg(F.count_if(F.col("_d") > 0).alias("_plus"), F.count_if(F.col("_d") < 0).alias("_minus"))
    t = F.col("n_tied")
    sums = ranks.join(signs, [*keys, "_a"]).groupBy(*keys).agg(
        F.sum(F.col("avg_rank") * F.col("_plus")).alias("w_plus"), F.sum(F.col("avg_rank") * F.col("_minus")).alias("w_minus"),
        F.sum(t).alias("n_nonzero"), F.sum((t * t * t - t).cast("double")).alias("tie_term"))
    return n.join(sums, list(keys), "left").na.fill(0.0, ["w_plus", "w_minus", "tie_term"]).na.fill(0, ["n_nonzero"])


def signed_rank_test(df: DataFrame, keys: Sequence[str], before: str, after: str) -> DataFrame:
    s = signed_rank_sums(df, keys, before, after)
    exact = (F.col("n_nonzero") <= SIGNED_EXACT_MAX) & (F.col("tie_term") == 0) & (F.col("n_nonzero") == F.col("n_pairs"))
    p = _p_values("signed")(F.col("n_nonzero"), F.least("w_plus", "w_minus"), F.col("tie_term"), exact)
    return _named(s.withColumn("p_value", F.when(F.col("n_pairs") >= 3, p)), exact)


def rank_sums(df: DataFrame, group: str, value: str, control: str) -> DataFrame:
    """Each group against the control: sample sizes, U of the group, and the tie term."""
    counts = df.select(F.col(group).alias("_g"), finite(value).alias("_x")).filter(
        F.col("_x").isNotNull() & F.col("_g").isNotNull()).groupBy("_g", "_x").agg(F.count(F.lit(1)).alias("_n"))
    ctl = counts.filter(F.col("_g") == control)
    targets = counts.filter(F.col("_g") != control).select(F.col("_g").alias("_t")).distinct().withColumn("_ctl", F.lit(control))
    mine = counts.filter(F.col("_g") != control).select(F.col("_g").alias("_t"), "_x", F.col("_n").alias("_nt"), F.lit(0).cast("bigint").alias("_nc"))
    shared = targets.join(ctl, F.col("_ctl") == F.col("_g")).select("_t", "_x", F.lit(0).cast("bigint").alias("_nt"), F.col("_n").alias("_nc"))
    both = mine.unionByName(shared).groupBy("_t", "_x").agg(F.sum("_nt").alias("_nt"), F.sum("_nc").alias("_nc"))
    both = running(both, ["_t"], ["_x"], {"_end": ("sum", F.col("_nt") + F.col("_nc"))})
    tied = F.col("_nt") + F.col("_nc")
    rank = F.col("_end") - (tied - 1) / F.lit(2.0)
    s = both.groupBy(F.col("_t").alias(group)).agg(
        F.sum("_nt").alias("n_group"), F.sum("_nc").alias("n_control"), F.sum(rank * F.col("_nt")).alias("_r"),
        F.sum((tied * tied * tied - tied).cast("double")).alias("tie_term"))
    n = F.col("n_group")
    return s.withColumn("u_group", F.col("_r") - n * (n + 1) / F.lit(2.0)).drop("_r")


def rank_sum_test(df: DataFrame, group: str, value: str, control: str) -> DataFrame:
    s = rank_sums(df, group, value, control)
    small = (F.least("n_group", "n_control") <= TWO_SAMPLE_EXACT_MAX) & (F.col("n_group") * F.col("n_control") <= TWO_SAMPLE_TABLE_MAX)
    exact = small & (F.col("tie_term") == 0)
    p = _p_values("two")(F.col("n_group"), F.col("n_control"), F.col("u_group"), F.col("tie_term"), exact)
    return _named(s.withColumn("p_value", F.when((F.col("n_group") >= 2) & (F.col("n_control") >= 2), p)), exact)


def rank_correlation(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Spearman's rho per key: correlation of tie-averaged ranks."""
    rows = df.select(*keys, finite(x).alias("_x"), finite(y).alias("_y")).filter(
        F.col("_x").isNotNull() & F.col("_y").isNotNull())
    base = rows if keys else rows.withColumn("_all", F.lit(0))
    k = list(keys) or ["_all"]
    rx = average_ranks(base, k, "_x").select(*k, "_x", F.col("avg_rank").alias("_rx"))
    ry = average_ranks(base, k, "_y").select(*k, "_y", F.col("avg_rank").alias("_ry"))
    cells = base.groupBy(*k, "_x", "_y").agg(F.count(F.lit(1)).alias("_n"))
    j = cells.join(rx, [*k, "_x"]).join(ry, [*k, "_y"])
    n, a, b = F.col("_n"), F.col("_rx"), F.col("_ry")
    s = j.groupBy(*k).agg(F.sum(n).alias("n"), F.sum(n * a).alias("_a"), F.sum(n * b).alias("_b"),
                          F.sum(n * a * b).alias("_ab"), F.sum(n * a * a).alias("_aa"), F.sum(n * b * b).alias("_bb"))
    cov = F.col("n") * F.col("_ab") - F.col("_a") * F.col("_b")
    va = F.col("n") * F.col("_aa") - F.col("_a") * F.col("_a")
    vb = F.col("n") * F.col("_bb") - F.col("_b") * F.col("_b")
    out = s.select(*k, "n", F.when((va > 0) & (vb > 0), cov / (F.sqrt(va) * F.sqrt(vb))).alias("rho"))
    return out if keys else out.drop("_all")


def count_agreement(pairs: DataFrame, manual: str, auto: str) -> DataFrame:
    """Mean absolute relative bias and rank correlation of automatic against manual counts."""
    ok = pairs.filter(finite(manual).isNotNull() & finite(auto).isNotNull())
    bias = F.avg(F.when(F.col(manual) != 0, F.abs(F.col(auto) - F.col(manual)) / F.col(manual)))
    rho = rank_correlation(ok, [], manual, auto).select("rho").scalar()
    return ok.agg(F.count(F.lit(1)).alias("n"), bias.alias("mean_abs_relative_bias")).withColumn("spearman_rho", rho)

