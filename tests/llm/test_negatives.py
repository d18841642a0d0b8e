"""Hard negatives against brute force."""

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from replistat.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, row string, tree int, p int"


def whole(v):
    return [math.floor(256 * x) for x in v]


def brute(rows, positives=5, k=10, low=30, high=90):
    """Sorted result rows; ties by id (null last), scores as Python whole numbers."""
    good = [(i, whole(v), l) for i, v, l in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for at, (a, va, la) in enumerate(good):
        if a is None or a % 10:
            continue
        scores = [(sum(x * y for x, y in zip(va, v)), i, l) for n, (i, v, l) in enumerate(good) if n != at]
        for ps, pid, _ in sorted((s for s in scores if s[2] == la), key=key)[:positives]:
            fits = sorted((s for s in scores if s[2] != la and low * ps <= 100 * s[0] <= high * ps), key=key)[:k]
            out += [(a, pid, r + 1, nid, ps, ns) for r, (ns, nid, _) in enumerate(fits)]
    return sorted(out, key=str)


def result(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    got = negatives.mine_negatives(df, F.col("vec_id") % 10 == 0, F.col("label"), **kw)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def clustered(n, seed, dim=8, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * spread
    return [(i, (v / np.linalg.norm(v)).tolist(), int(rng.integers(0, 3))) for i, v in enumerate(x)]


def test_many_trees_and_blocks_with_odd_rows(spark):
    rows = clustered(150, 1) + clustered(40, 1)[:20]                              # repeated ids and rows
    rows += [(None, rows[3][1], 1), (None, None, 1), (1000, rows[5][1], None), (1010, [math.nan] * 8, 1), (1020, [math.inf] + [0.0] * 7, 1), (1030, [None] + [0.0] * 7, 1)]
    rows += [(1040, [], 1), (1050, [0.5, 0.5], 2), (1060, rows[0][1], 0), (1061, rows[0][1], 1), (1062, rows[0][1], 1)]
    rows += [(-10, [-x for x in rows[7][1]], 2), (1070, [1.0] * 9, 0)]
    want = brute(rows)
    assert want and result(spark, rows, per_tree=4, block=32) == want
    assert result(spark, rows) == want


def test_scores_beyond_exact_floats(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) * 2.0 ** 21 + 2.0 ** 22).tolist(), i % 2) for i in range(40)]
    want = brute(rows)
    assert want and max(r[4] for r in want) > 2**53 and result(spark, rows, block=16) == want
    assert result(spark, [(0, [3e200, 1.0], 0), (1, [3e200, 1.0], 0), (2, [1e200, 1.0], 1), (3, [3e200, 1.0], 1)]) == []     # beyond any long


def test_empty_and_lonely(spark):
    assert result(spark, []) == []
    assert result(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []                    # no anchor
    assert result(spark, [(10, [1.0], 1), (2, [1.0], 2)]) == []                   # no positive


def test_tree_and_bounds_hold_and_spare_work():
    rng = np.random.default_rng(2)
    a = np.floor(np.repeat(rng.normal(size=(4, 16)), 30, axis=0) * 256 + rng.normal(size=(120, 16)) * 3)
    order, parent, edge, last = negatives.spanning_tree(a)
    assert sorted(order.tolist()) == list(range(120)) and (parent < 0).sum() == 1
    place = {n: i for i, n in enumerate(order.tolist())}
    children = defaultdict(list)
    for n in order.tolist():
        if parent[n] >= 0:
            assert place[parent[n]] < place[n] and edge[n] >= np.linalg.norm(a[n] - a[parent[n]])
            children[parent[n]].append(n)
    assert all([n for n in kids if last[n]] == kids[-1:] for kids in children.values())
    c = np.floor(rng.normal(size=(500, 16)) * 256)
    walk, held = negatives.Bounds(c, c), 0
    for n in order.tolist():
        walk.enter(int(parent[n]), float(edge[n]), bool(last[n]))
        s = c @ a[n]
        assert (walk.low <= s).all() and (s <= walk.high).all()
        if parent[n] < 0:
            walk.score(np.arange(500), a[n])
        walk.leave(n, n in children)
        held = max(held, len(walk.held))
    assert held <= 8                                                              # logarithm of 120 nodes
    near = pa.table({"seq": range(120), "row": range(1000, 1120), "id": range(120), "label": ["0"] * 120, "v": (a[order] / 256).tolist(), "tree": [0] * 120,
                     "parent": [place[parent[n]] if parent[n] >= 0 else -1 for n in order.tolist()], "edge": edge[order], "last": last[order],
                     "p": [[{"rank": 1, "id": 0, "score": 10**6}]] * 120})
    block = pa.table({"row": range(500), "id": range(500), "label": ["1"] * 500, "v": (c / 256).tolist()})
    seen = []
    score = negatives.Bounds.score
    negatives.Bounds.score = lambda self, at, anchor: (seen.append(at.size), score(self, at, anchor))[1]
    try:
        got = negatives.search(None, near, block, 10, 30, 90, True)
    finally:
        negatives.Bounds.score = score
    assert sum(seen) < 0.5 * 120 * 500
    want = {(1000 + i, j) for i, n in enumerate(order.tolist()) for j in sorted((j for j in range(500) if 300000 <= c[j] @ a[n] <= 900000), key=lambda j: (-(c[j] @ a[n]), j))[:10]}
    assert set(zip(got.column("arow").to_pylist(), got.column("row").to_pylist())) == want
