"""Counts of random draws split down a tree of value positions.

To know the median of a resampled group one does not need its draws, only how many of them fall left and
right of a cut. Positions 0, 1, ... (by value) are the leaves of a binary tree; at a node that holds some draws the number that goes
left is binomial (with replacement) or hypergeometric (without). One such number per replicate and node on the way to the
median replaces one random number per replicate and observation.

Every number is the quantile of its distribution at a keyed uniform: a hash of seed, group, replicate, cluster and
node. So all paths through a node agree, and results do not depend on partitioning or retries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

STEP = 4            # binary levels worked on in one round
REACH = 8.0         # deviations around the mean beyond which a count has no weight that a double could show
CELLS = 1 << 22     # terms of distribution functions held at once


def uniform(keys: Iterable[str]) -> np.ndarray:
    """52 bits of the MD5 of each key as a number between 0 and 1, never 0 or 1."""
    return np.array([(int(hashlib.md5(k.encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52 for k in keys])


_SMALL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 64, dtype=np.float64)))])


def _stirling(x: np.ndarray) -> np.ndarray:
    """Logarithm of the factorial: the series, exact to rounding from 64 on; a table below."""
    big = np.maximum(x, 63.0)
    series = (big + 0.5) * np.log(big) - big + 0.9189385332046728 + 1 / (12 * big) - 1 / (360 * big**3) + 1 / (1260 * big**5)
    return np.where(x < 64, _SMALL[np.minimum(x, 63).astype(np.int64)], series)


@cache
def _table(bits: int) -> np.ndarray:
    return _stirling(np.arange(1 << bits, dtype=np.float64))


def log_factorial(x: np.ndarray) -> np.ndarray:
    """From a table (at most 8 MB) if all numbers are below 2 ** 20."""
    x = np.asarray(x, np.int64)
    bits = int(x.max(initial=0)).bit_length()
    return _table(max(12, bits))[x] if bits <= 20 else _stirling(x.astype(np.float64))


def _log_terms(n, left, right, replace):
    """Logarithm of the probability that ``k`` of ``n`` draws go left, as a function of (k, own), own being the row of n, left, right."""
    if replace:
        fixed, p, q = log_factorial(n), np.log(left / (left + right)), np.log(right / (left + right))
        return lambda k, own: fixed[own] - log_factorial(k) - log_factorial(n[own] - k) + k * p[own] + (n[own] - k) * q[own]
    fixed = log_factorial(left) + log_factorial(right) + log_factorial(n) + log_factorial(left + right - n) - log_factorial(left + right)
    return lambda k, own: fixed[own] - log_factorial(k) - log_factorial(left[own] - k) - log_factorial(n[own] - k) - log_factorial(right[own] - n[own] + k)


def went_left(n: np.ndarray, left: np.ndarray, right: np.ndarray, u: np.ndarray, replace: bool) -> np.ndarray:
    """How many of ``n`` draws fall among the ``left`` of ``left + right`` positions: the quantile at ``u``.

    Draws that share (n, left, right) share one table of the distribution function, which spans REACH
    deviations: work grows with the deviation, the root of ``n``, not with ``n``.
    """
    n, left, right = (np.asarray(x, np.int64) for x in (n, left, right))
    out = np.where(right == 0, n, 0)
    free = np.flatnonzero((n > 0) & (left > 0) & (right > 0))
    if not free.size:
        return out
    kinds, which = np.unique(np.stack([n[free], left[free], right[free]], axis=1), axis=0, return_inverse=True)
    which = which.ravel()
    m, a, b = (kinds[:, i].astype(np.float64) for i in range(3))
    p = a / (a + b)
    spread = np.sqrt(m * p * (1 - p) * (1.0 if replace else np.maximum((a + b - m) / np.maximum(a + b - 1, 1), 0)))
    first = np.maximum(np.floor(m * p - REACH * spread - REACH), 0 if replace else np.maximum(m - b, 0)).astype(np.int64)
    last = np.minimum(np.ceil(m * p + REACH * spread + REACH), m if replace else np.minimum(m, a)).astype(np.int64)
    width = last - first + 1
    order = np.argsort(which, kind="stable")
    bound = np.searchsorted(which[order], np.arange(len(kinds) + 1))
    log_p = _log_terms(kinds[:, 0], kinds[:, 1], kinds[:, 2], replace)
    at = 0
    while at < len(kinds):
        end = max(at + 1, int(np.searchsorted(np.cumsum(width[at:]), CELLS, side="right")) + at)
        w = width[at:end]
        start = np.concatenate([[0], np.cumsum(w)])
        own = np.repeat(np.arange(end - at), w)
        k = np.arange(start[-1]) - start[own] + first[at:end][own]
        term = np.exp(log_p(k, own + at))
        total = np.cumsum(term)
        total -= np.concatenate([[0.0], total])[start[:-1]][own]
        rows = order[bound[at]:bound[end]]
        mine = which[rows] - at
        hit = np.searchsorted(own + np.minimum(total, 1.0), mine + u[free[rows]])
        out[free[rows]] = k[np.minimum(hit, start[mine + 1] - 1)]
        at = end
    return out


def _children(name: pd.Series, node: pd.Series, n: pd.Series, weights: pd.Series, shift: int) -> pd.Series:
    """Draws of each of the 2 ** STEP descendants of a node, STEP levels of splits at once."""
    w = np.array(weights.tolist(), np.int64).reshape(len(n), 1 << STEP)
    counts, names, nodes = n.to_numpy(np.int64)[:, None], name.tolist(), node.to_numpy(np.int64)
    for level in range(STEP):
        down = shift - level - 1                     # what is below a child
        halves = w.reshape(len(n), 2 << level, -1).sum(2)
        here = nodes[:, None] * (1 << level) + np.arange(1 << level)
        flat, left, right = counts.ravel(), halves[:, ::2].ravel(), halves[:, 1::2].ravel()
        u = np.full(flat.size, 0.5)
        need = np.flatnonzero((flat > 0) & (left > 0) & (right > 0))
        ids = here.ravel()
        u[need] = uniform(f"{names[i >> level]}|{down}|{ids[i]}" for i in need.tolist())
        go = went_left(flat, left, right, u, True)
        counts = np.stack([go, flat - go], axis=1).reshape(len(n), -1)
    return pd.Series(list(counts))


def order_statistics(placed: DataFrame, draws: DataFrame, wanted: DataFrame, group: Sequence[str], seed: int) -> DataFrame:
    """Values at given ranks of resampled groups: ``wanted`` (group, _rep, _t, _k from 0) with ``_x``.

    ``placed``: group, _c, _x, _pos (0, 1, ... by value within the group); ``draws``: group, _rep, _c, _n, so
    many draws with replacement from the observations of cluster _c. Each round splits the draws of all clusters
    of a node over its 16 descendants, finds the descendant in which the rank lies, and goes on with that one.
    Rounds grow with the logarithm of the largest group; a round holds replicates x clusters rows.
    """
    group = list(group)
    top = placed.agg(F.max("_pos")).first()[0]
    if top is None:
        return wanted.withColumn("_x", F.lit(None).cast("double"))
    shift = -(-max(int(top).bit_length(), 1) // STEP) * STEP
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    here, node = [*group, "_rep"], F.lit(0).cast("bigint").alias("_node")
    state, targets = draws.filter("_n > 0").select(*here, "_c", "_n", node), wanted.select(*here, "_t", "_k", node)
    first = F.concat_ws("|", F.lit(str(seed)), *[F.col(g).cast("string") for g in group], F.col("_rep").cast("string"), "_c")
    while shift > 0:
        child = F.shiftright("_pos", shift - STEP).bitwiseAND(F.lit((1 << STEP) - 1))
        weights = placed.groupBy(*group, "_c", F.shiftright("_pos", shift).alias("_node")).agg(
            F.array(*[F.count_if(child == i) for i in range(1 << STEP)]).alias("_w"))
        split = F.pandas_udf(lambda a, b, c, d, s=shift: _children(a, b, c, d, s), "array<bigint>")
        # few bytes but much arithmetic: dealt by number, so that adaptive execution does not put the rows together
        fallen = state.join(weights, [*group, "_c", "_node"]).repartition(parts, *here, "_c", "_node").select(*here, "_c", "_node", split(first, F.col("_node"), F.col("_n"), F.col("_w")).alias("_s"))
        fallen = cut_lineage(fallen.select(*here, "_c", "_node", F.posexplode("_s").alias("_i", "_n")).filter("_n > 0"))
        sums = fallen.groupBy(*here, "_node", "_i").agg(F.sum("_n").alias("_n"))
        sums = sums.groupBy(*here, "_node").agg(F.sort_array(F.collect_list(F.struct("_i", "_n"))).alias("_all"))       # at most 16
        pick = F.aggregate("_all", F.struct(F.lit(-1).alias("i"), F.col("_k").alias("k")), lambda acc, s: F.when(acc["i"] >= 0, acc).when(
            acc["k"] < s["_n"], F.struct(s["_i"].alias("i"), acc["k"].alias("k"))).otherwise(F.struct(acc["i"], (acc["k"] - s["_n"]).alias("k"))))
        targets = targets.join(sums, [*here, "_node"]).withColumn("_p", pick).select(
            *here, "_t", F.col("_p.k").alias("_k"), (F.col("_node") * (1 << STEP) + F.col("_p.i")).alias("_node"))
        targets = cut_lineage(targets)
        state = fallen.withColumn("_node", F.col("_node") * (1 << STEP) + F.col("_i")).join(targets.select(*here, "_node").distinct(), [*here, "_node"]).select(*here, "_c", "_n", "_node")
        shift -= STEP
    return targets.join(placed.select(*group, F.col("_pos").alias("_node"), "_x"), [*group, "_node"]).select(*here, "_t", "_x")


def split_medians(name: Sequence[str], size: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Four positions per row: both middle ones of a random choice of ``chosen`` of ``size`` positions, and both of the rest.

    All rows walk down at once. A node with shift s covers positions from ``node << s`` on.
    """
    size, chosen = np.asarray(size, np.int64), np.asarray(chosen, np.int64)
    mine = np.tile([True, True, False, False], len(size))
    n, t = np.repeat(size, 4), np.repeat(chosen, 4)
    part = np.where(mine, t, n - t)
    k = np.where(np.tile([True, False], 2 * len(size)), (part - 1) // 2, part // 2)
    node, cache = np.zeros(len(n), np.int64), {}
    for down in range(max(int(size.max(initial=0)) - 1, 0).bit_length() - 1, -1, -1):
        start = node << (down + 1)
        left = np.clip(n - start, 0, 1 << down)
        right = np.clip(n - start - left, 0, 1 << down)
        u = np.full(len(n), 0.5)
        need = np.flatnonzero((t > 0) & (left > 0) & (right > 0))
        cache.clear()
        for i in need.tolist():
            key = f"{name[i >> 2]}|{down}|{node[i]}"
            if key not in cache:
                cache[key] = uniform([key])[0]
            u[i] = cache[key]
        go = went_left(t, left, right, u, False)
        ours = np.where(mine, go, left - go)
        up = k >= ours
        k = np.where(up, k - ours, k)
        t = np.where(up, t - go, go)
        node = node * 2 + up
    return node.reshape(-1, 4)
