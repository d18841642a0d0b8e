"""Optimal assignment on components too large for one task: exact reductions in rounds, then a small kernel.

What is maximised is a pair (number of matches, minus total distance), compared in this order. An edge carries a
table of the best value inside it for each of four cases: whether it uses up its first and its second end. A plain edge
uses both or none. Three reductions keep the optimum exactly:

* parallel edges become one edge;
* a node with one edge is folded into its neighbour, which may then use itself up for a gain;
* a node with two edges disappears, and its edges become one.

All leaves, and an independent set of the nodes with two edges, go in one round, so a tree or a chain of any length
needs a number of rounds that grows with its logarithm. What no reduction reaches is solved component by component.
The rounds are undone in reverse order, from decisions about reduced edges to decisions about their parts.
"""

from __future__ import annotations

from collections import deque
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage as written, unless_large
from .graph import connected_components

NEVER = -(1 << 40)
CASES = ((0, 0), (1, 0), (0, 1), (1, 1))
FLAGS = "e long, x int"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Written once; many rows are never broadcast, however small their files."""
    return unless_large(written(df))


def _add(*parts: Column) -> Column:
    return F.struct(*[reduce(lambda p, q: p + q, [w[f] for w in parts]).alias(f) for f in ("c", "d")])


def _choice(value: Column, first: Column | int, second: Column | int = 0, free: int = 0) -> Column:
    """A value with what it decides: the case of the first part, of the second, and whether the node between is free."""
    code = (F.lit(first) if isinstance(first, int) else first) * 8 + (F.lit(second) if isinstance(second, int) else second) * 2 + free
    return F.struct(value["c"].alias("c"), value["d"].alias("d"), code.cast("int").alias("k"))


def _table(best: dict[tuple[int, int], Column]) -> list[Column]:
    """Columns t (values) and k (decisions) of the best choice of each case."""
    t = F.struct(*[F.struct(best[i, j]["c"].alias("c"), best[i, j]["d"].alias("d")).alias(f"t{i}{j}") for i, j in CASES])
    return [t.alias("t"), F.array(*[best[c]["k"] for c in ((0, 0), (0, 1), (1, 0), (1, 1))]).alias("k")]


def _flipped(t: Column) -> Column:
    return F.struct(t["t00"].alias("t00"), t["t01"].alias("t10"), t["t10"].alias("t01"), t["t11"].alias("t11"))


def _halves(edges: DataFrame) -> DataFrame:
    """Each edge seen from both ends: n, the other end o, and the table with n first."""
    one = edges.select(F.col("u").alias("n"), F.col("v").alias("o"), "e", F.lit(True).alias("first"), "t")
    return one.unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("o"), "e", F.lit(False).alias("first"), _flipped(F.col("t")).alias("t")))


def _case(first: Column, own: Column | int, other: Column | int) -> Column:
    """Case of an edge from what it uses of the node seen (own) and of the other end."""
    own, other = (F.lit(x) if isinstance(x, int) else x for x in (own, other))
    return F.when(first, own * 2 + other).otherwise(other * 2 + own)


def _merge_parallel(edges: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Two of each bundle of parallel edges become one."""
    many = edges.groupBy("u", "v").agg(F.count(F.lit(1)).alias("m"), F.min("e").alias("e1")).filter("m > 1")
    many = cut_lineage(many)
    if many.isEmpty():
        return None
    rest = edges.join(many, ["u", "v"]).filter("e > e1")
    second = rest.groupBy("u", "v", "e1").agg(F.min_by(F.struct("e", "t"), "e").alias("b"))
    two = second.join(edges.select(F.col("e").alias("e1"), F.col("t").alias("a")), "e1")
    a, b = (lambda i, j: F.col(f"a.t{i}{j}")), (lambda i, j: F.col(f"b.t.t{i}{j}"))
    best = {(0, 0): _choice(_add(a(0, 0), b(0, 0)), 0, 0)}
    for i, j in ((1, 0), (0, 1)):
        x = i * 2 + j
        best[i, j] = F.greatest(_choice(_add(a(i, j), b(0, 0)), x, 0), _choice(_add(a(0, 0), b(i, j)), 0, x))
    best[1, 1] = F.greatest(_choice(_add(a(1, 1), b(0, 0)), 3, 0), _choice(_add(a(0, 0), b(1, 1)), 0, 3), _choice(_add(a(1, 0), b(0, 1)), 2, 1), _choice(_add(a(0, 1), b(1, 0)), 1, 2))
    made = cut_lineage(two.select(F.col("e1").alias("e"), "u", "v", F.col("b.e").alias("e2"), F.lit(None).cast("long").alias("opt"), *_table(best)))
    gone = made.select(F.explode(F.array("e", "e2")).alias("e"))
    return cut_lineage(edges.join(gone, "e", "left_anti").unionByName(made.select("e", "u", "v", "t"))), made.select("e", "e2", "opt", "k")


def _fold_leaves(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Nodes with one edge go into their neighbours; of two such ends of an edge the smaller goes."""
    half = _halves(edges)
    lone = half.groupBy("n").agg(F.count(F.lit(1)).alias("m"), F.first("e").alias("e")).filter("m = 1").groupBy("e").agg(F.min("n").alias("n"))
    leaf = half.join(lone, ["e", "n"]).join(nodes, "n")
    t = lambda i, j: F.col(f"t.t{i}{j}")
    for j in (0, 1):
        leaf = leaf.withColumn(f"g{j}", F.greatest(_choice(t(1, j), _case(F.col("first"), 1, j)), _choice(_add(t(0, j), F.col("s")), _case(F.col("first"), 0, j), 0, 1)))
    leaf = cut_lineage(leaf.select("e", "n", "o", "opt", F.array(F.col("g0.k"), F.col("g1.k")).alias("k"), (F.col("g1.c") - F.col("g0.c")).alias("c"), (F.col("g1.d") - F.col("g0.d")).alias("d")))
    if leaf.isEmpty():
        return None
    gain = leaf.groupBy(F.col("o").alias("n")).agg(F.max(F.struct("c", "d", "e")).alias("g"))
    better = F.struct(F.col("g.c").alias("c"), F.col("g.d").alias("d")) > F.col("s")
    left = nodes.join(leaf.select("n"), "n", "left_anti").join(gain, "n", "left").select(
        "n", F.when(better, F.struct(F.col("g.c").alias("c"), F.col("g.d").alias("d"))).otherwise(F.col("s")).alias("s"), F.when(better, F.col("g.e")).otherwise(F.col("opt")).alias("opt"))
    return cut_lineage(edges.join(leaf.select("e"), "e", "left_anti")), cut_lineage(left), leaf.select("e", F.lit(None).cast("long").alias("e2"), "opt", "k")


def _skip_middles(edges: DataFrame, nodes: DataFrame, turn: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Nodes with two edges to different ends go, unless such a neighbour has a smaller hash this turn."""
    half = _halves(edges)
    two = half.groupBy("n").agg(F.count(F.lit(1)).alias("m"), F.min_by(F.struct("e", "o", "first", "t"), "e").alias("x"), F.max_by(F.struct("e", "o", "first", "t"), "e").alias("y"))
    two = cut_lineage(two.filter("m = 2 AND x.o <> y.o").withColumn("h", F.xxhash64("n", F.lit(turn))))
    if two.isEmpty():
        return None
    rank = two.select(F.col("n").alias("o"), F.col("h").alias("ho"))
    beaten = two.select("n", "h", F.explode(F.array("x.o", "y.o")).alias("o")).join(rank, "o").filter("ho < h").select("n")
    go = two.join(beaten, "n", "left_anti").join(nodes, "n")
    x, y = (lambda i, j: F.col(f"x.t.t{i}{j}")), (lambda i, j: F.col(f"y.t.t{i}{j}"))
    ahead = F.col("x.o") < F.col("y.o")

    def best(a: int, b: int) -> Column:
        ways = [_choice(_add(x(i, a), y(j, b), *([F.col("s")] if i + j == 0 else [])), _case(F.col("x.first"), i, a), _case(F.col("y.first"), j, b), int(i + j == 0)) for i, j in ((1, 0), (0, 1), (0, 0))]
        return F.greatest(*ways)

    cases = {(i, j): F.when(ahead, best(i, j)).otherwise(best(j, i)) for i, j in CASES}
    made = cut_lineage(go.select("n", F.col("x.e").alias("e"), F.col("y.e").alias("e2"), F.least("x.o", "y.o").alias("u"), F.greatest("x.o", "y.o").alias("v"), "opt", *_table(cases)))
    gone = made.select(F.explode(F.array("e", "e2")).alias("e"))
    return (cut_lineage(edges.join(gone, "e", "left_anti").unionByName(made.select("e", "u", "v", "t"))),
            cut_lineage(nodes.join(made.select("n"), "n", "left_anti")), made.select("e", "e2", "opt", "k"))


def heaviest_matching(edges: list[tuple[object, object, float]]) -> set[tuple[object, object]]:
    """Heaviest matching of a small bipartite graph (left, right, weight): augmenting paths of greatest gain first."""
    right_of, left_of, out = {}, {}, {}
    for a, b, w in edges:
        out.setdefault(a, {})[b] = w
    scale = max((abs(w) for *_, w in edges), default=1.0)
    while True:
        gain, via, queue = {a: 0.0 for a in out if a not in right_of}, {}, deque(a for a in out if a not in right_of)
        top, end = 1e-12 * scale, None
        reach: dict = {}
        while queue:
            a = queue.popleft()
            for b, w in out[a].items():
                g = gain[a] + w
                if right_of.get(a) != b and g > reach.get(b, float("-inf")) + 1e-12 * scale:
                    reach[b], via[b] = g, a
                    if b in left_of:
                        back = left_of[b]
                        if g - out[back][b] > gain.get(back, float("-inf")) + 1e-12 * scale:
                            gain[back] = g - out[back][b]
                            queue.append(back)
        for b, g in reach.items():
            if b not in left_of and g > top:
                top, end = g, b
        if end is None:
            return set(right_of.items())
        while end is not None:
            a, b = via[end], end
            end = right_of.get(a)
            right_of[a], left_of[b] = b, a


def _solve_kernel(pdf: pd.DataFrame) -> pd.DataFrame:
    """Decisions about the edges of one component, whose tables are spelled out as short paths of plain edges."""
    many = 4.0 * (1.0 + sum(abs(t[f]["d"]) for t in pdf["t"] for f in t if t[f]["c"] > NEVER // 2) + sum(abs(s["d"]) for s in [*pdf["su"], *pdf["sv"]]))
    plain: list[tuple[object, object, float]] = []

    def link(p, q, w, p_side):
        plain.append((p, q, w) if p_side == 0 else (q, p, w))

    ends, options = {}, {}
    for e, u, v, t, su, sv, ou, ov in pdf[["e", "u", "v", "t", "su", "sv", "ou", "ov"]].itertuples(index=False):
        for n, s, o in ((u, su, ou), (v, sv, ov)):
            options[n] = (s["c"] * many + s["d"], o)
        base = t["t00"]
        p, q, r = (None if t[f]["c"] < NEVER // 2 else (t[f]["c"] - base["c"]) * many + t[f]["d"] - base["d"] for f in ("t10", "t01", "t11"))
        a, b, side = ("n", u), ("n", v), u & 1
        if (u ^ v) & 1:                              # the ends are on different sides
            if p is None:
                link(a, b, r, side)
                ends[e] = (a, b), (b, a)
                continue
            g = r - p - q
            link(a, ("x", e), p + g, side), link(("x", e), ("y", e), g, 1 - side), link(("y", e), b, q + g, side)
            ends[e] = (a, ("x", e)), (b, ("y", e))
        elif r is None:
            link(a, ("x", e), p, side), link(b, ("x", e), q, side)
            ends[e] = (a, ("x", e)), (b, ("x", e))
        else:
            g = p + q - r
            link(a, ("x", e), p, side), link(("x", e), ("y", e), g, 1 - side), link(("y", e), ("z", e), g, side), link(("z", e), b, q, 1 - side)
            ends[e] = (a, ("x", e)), (b, ("z", e))
    for n, (w, _) in options.items():
        if w > 0:
            link(("n", n), ("s", n), w, n & 1)
    chosen = heaviest_matching(plain)
    chosen |= {(q, p) for p, q in chosen}
    rows = [(int(e), 2 * int(one in chosen) + int(two in chosen)) for e, (one, two) in ends.items()]
    used = {n for e, (one, two) in ends.items() for n in (one, two) if n in chosen}
    taken = {n[1] for n, _ in used}
    rows += [(int(o), 1) for n, (_, o) in options.items() if n not in taken and o is not None and o == o]
    return pd.DataFrame(rows, columns=["e", "x"])


def best_matching(edges: DataFrame, kernel: int = 2000) -> DataFrame:
    """The edges (a_id, b_id, distance) of a matching with most pairs and, of those, the least total distance.

    Reductions go on until at most ``kernel`` edges are left or none applies. Equal optima are settled by ids
    given to edges in the first table written.
    """
    numbered = cut_lineage(edges.select("a_id", "b_id", "distance").withColumn("e", F.monotonically_increasing_id()))
    ids = [cut_lineage(numbered.select(c).distinct().withColumn("i", F.monotonically_increasing_id() * 2 + side).withColumnRenamed(c, f"_{c}")) for side, c in enumerate(("a_id", "b_id"))]
    ends = numbered.join(ids[0].withColumnRenamed("i", "p"), F.col("a_id") == F.col("_a_id")).join(ids[1].withColumnRenamed("i", "q"), F.col("b_id") == F.col("_b_id"))
    zero, never = (F.struct(F.lit(c).cast("long").alias("c"), F.lit(0.0).alias("d")) for c in (0, NEVER))
    full = F.struct(F.lit(1).cast("long").alias("c"), (-F.col("distance").cast("double")).alias("d"))
    now = cut_lineage(ends.select("e", F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v"), F.struct(zero.alias("t00"), never.alias("t10"), never.alias("t01"), full.alias("t11")).alias("t")))
    nodes = cut_lineage(ids[0].select("i").unionByName(ids[1].select("i")).select(F.col("i").alias("n"), zero.alias("s"), F.lit(None).cast("long").alias("opt")))
    steps, turn = [], 0
    while now.count() > kernel:
        turn, before = turn + 1, len(steps)
        if made := _merge_parallel(now):
            now = made[0]
            steps.append(made[1])
        if made := _fold_leaves(now, nodes):
            now, nodes = made[0], made[1]
            steps.append(made[2])
        if made := _skip_middles(now, nodes, turn):
            now, nodes = made[0], made[1]
            steps.append(made[2])
        if len(steps) == before:
            break
    flags = nodes.join(_halves(now).select("n").distinct(), "n", "left_anti").filter("opt IS NOT NULL").select(F.col("opt").alias("e"), F.lit(1).alias("x"))
    if not now.isEmpty():
        comp = connected_components(nodes.select("n"), now, "n", "u", "v").select(F.col("n").alias("u"), "component")
        kern = now.join(comp, "u").join(nodes.select(F.col("n").alias("u"), F.col("s").alias("su"), F.col("opt").alias("ou")), "u").join(
            nodes.select(F.col("n").alias("v"), F.col("s").alias("sv"), F.col("opt").alias("ov")), "v")
        flags = flags.unionByName(kern.groupBy("component").applyInPandas(_solve_kernel, FLAGS))
    flags = cut_lineage(flags)
    for rec in reversed(steps):
        told = rec.join(flags, "e", "left").withColumn("w", F.element_at("k", F.coalesce("x", F.lit(0)) + 1))
        parts = F.array(F.struct("e", F.expr("w div 8").cast("int").alias("x")), F.struct(F.col("e2").alias("e"), F.expr("(w div 2) % 4").cast("int").alias("x")),
                        F.struct(F.when(F.expr("w % 2 = 1"), F.col("opt")).alias("e"), F.lit(1).alias("x")))
        new = told.select(F.inline(parts)).filter("e IS NOT NULL AND x > 0")
        flags = cut_lineage(flags.join(rec.select("e"), "e", "left_anti").unionByName(new))
    return numbered.join(flags.filter("x = 3").select("e"), "e", "left_semi").select("a_id", "b_id", "distance")
