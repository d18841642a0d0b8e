"""Hard negatives: bounds carried along a spanning tree of the anchors decide which candidates are scored."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from replistat.llm.common import table, written

SCALE = 256
#: Slack for the rounding of distances and norms, relative to the values themselves.
SLACK = 1e-9
LONG = np.iinfo(np.int64)


# vectors inside one task ------------------------------------------------------------------------------------------

def matrix(column: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Whole numbers ``floor(256 x)`` as doubles, one row per vector; shorter vectors are padded with zeros."""
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = np.floor(np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.float64) * SCALE)
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def exact_type(a: np.ndarray, b: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Conversion to the cheapest type in which no partial sum of an inner product can round or overflow."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**24:
        return lambda x: x.astype(np.float32)
    if most < 2**53:
        return lambda x: x
    if most < 2**62:
        return lambda x: x.astype(np.int64)
    return lambda x: np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)


def as_floats(scores: np.ndarray) -> np.ndarray:
    if scores.dtype != object:
        return scores.astype(np.float64)
    return np.array([float(s) if abs(s) < 1 << 1000 else math.inf if s > 0 else -math.inf for s in scores])


def spanning_tree(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree of the rows: (order, parent, edge, last).

    ``order`` walks from the root; of several children the one with the largest subtree comes last,
    marked ``last``, so that a walk holds the bounds of few parents (the logarithm of the rows) at once.
    ``edge`` is at least the Euclidean distance to the parent.
    """
    n = len(a)
    with np.errstate(over="ignore", invalid="ignore"):
        squares = (a * a).sum(1)
        near, parent, seen, picked = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool), [0]
        seen[0] = True
        for _ in range(n - 1):
            i = picked[-1]
            d = squares + squares[i] - 2 * (a @ a[i])
            closer = ~seen & ((d < near) | (parent < 0))
            near[closer], parent[closer] = d[closer], i
            picked.append(int(np.argmin(np.where(seen, np.inf, np.nan_to_num(near, nan=1e300, posinf=1e300)))))
            seen[picked[-1]] = True
        size, children = np.ones(n, np.int64), [[] for _ in range(n)]
        for i in reversed(picked[1:]):
            size[parent[i]] += size[i]
            children[parent[i]].append(i)
        order, last, stack = [], np.zeros(n, bool), [0]
        while stack:
            i = stack.pop()
            order.append(i)
            kids = sorted(children[i], key=lambda c: (size[c], c))
            if kids:
                last[kids[-1]] = True
            stack.extend(reversed(kids))
        gap = np.sqrt(((a - a[np.maximum(parent, 0)]) ** 2).sum(1)) * (1 + SLACK)
    return np.array(order), parent, gap, last


class Bounds:
    """Walk of one tree over one block of candidates: intervals that hold each candidate's score.

    At the root every candidate is scored. At a child the interval of the parent widens by edge length
    times candidate norm (Cauchy-Schwarz), except where the candidate is scored again.
    """

    def __init__(self, block: np.ndarray, exact: np.ndarray):
        with np.errstate(over="ignore"):
            self.norm = np.sqrt((block * block).sum(1)) * (1 + SLACK)
        self.exact, self.held, self.scored = exact, {}, 0

    def enter(self, parent: int, edge: float, last: bool) -> None:
        if parent < 0:
            self.low, self.high = np.full(len(self.norm), -np.inf), np.full(len(self.norm), np.inf)
            return
        low, high = self.held.pop(parent) if last else self.held[parent]
        with np.errstate(over="ignore", invalid="ignore"):
            reach = edge * self.norm + SLACK * np.maximum(np.abs(low), np.abs(high))
            self.low, self.high = np.nan_to_num(low - reach, nan=-np.inf), np.nan_to_num(high + reach, nan=np.inf)

    def score(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact scores of the candidates ``at``; their intervals become points."""
        s = self.exact @ anchor if at.size == len(self.norm) else self.exact[at] @ anchor
        self.low[at] = self.high[at] = as_floats(s)
        self.scored += at.size
        return s

    def leave(self, node: int, has_children: bool) -> None:
        if has_children:
            self.held[node] = self.low, self.high


def first(k: int, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties by smaller id (``ids`` are sorted, so by position)."""
    if scores.size > k:
        floor = np.partition(scores, scores.size - k)[scores.size - k]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(scores.size)
    return at[np.argsort(-scores[at], kind="stable")][:k]


def kth_low(low: np.ndarray, k: int) -> float:
    return float(np.partition(low, low.size - k)[low.size - k]) if low.size >= k else -np.inf


def search(key, anchors: pa.Table, block: pa.Table, k: int, low: int, high: int, negatives: bool) -> pa.Table:
    """One tree against one block: the first ``k`` candidates of each anchor (or of each window of it).

    Without ``negatives`` candidates have the anchor's label. With it they have another, and each positive of
    the anchor (list ``p``) opens a window of scores. A candidate is scored if its interval meets an
    open window above the k-th best lower bound already certain there.
    """
    names = ["arow", "place", "row", "id", "score"]
    out: dict[str, list] = {n: [] for n in names}
    if anchors.num_rows and block.num_rows:
        anchors, block = anchors.sort_by("seq"), block.sort_by([("id", "ascending"), ("row", "ascending")])
        width = max(matrix(t.column("v")).shape[1] for t in (anchors, block))
        a, c = matrix(anchors.column("v"), width), matrix(block.column("v"), width)
        as_exact = exact_type(a, c)
        ea, walk = as_exact(a), Bounds(c, as_exact(c))
        labels = np.unique(np.array(anchors.column("label").to_pylist() + block.column("label").to_pylist(), dtype=object).astype(str), return_inverse=True)[1]
        mine, theirs = labels[:len(a)], labels[len(a):]
        rows, ids = block.column("row").to_numpy(), block.column("id").to_pylist()
        own, parent, edge, last = (anchors.column(n).to_numpy(zero_copy_only=False) for n in ("row", "parent", "edge", "last"))
        windows = anchors.column("p").to_pylist() if negatives else None
        has_children = np.zeros(len(a), bool)
        has_children[parent[parent >= 0]] = True
        for i in range(len(a)):
            walk.enter(int(parent[i]), edge[i], bool(last[i]))
            if negatives:
                fits = theirs != mine[i]
                spans = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in windows[i] or []]
            else:
                fits = (theirs == mine[i]) & (rows != own[i])
                spans = [(-np.inf, np.inf)]
            need = np.full(len(c), parent[i] < 0)      # all of them at the root
            for lo, hi in spans:
                sure = walk.low[fits & (walk.high <= hi)]
                need |= fits & (walk.high >= max(lo, kth_low(sure, k))) & (walk.low <= hi)
            if 2 * need.sum() > need.size:
                need[:] = True
            at = np.flatnonzero(need)
            if at.size:
                s = walk.score(at, ea[i])
                ok = fits[at]
                at, s = at[ok], s[ok]
                for place, (lo, hi) in enumerate(spans):
                    inside = np.flatnonzero((s >= lo) & (s <= hi)) if negatives else np.arange(s.size)
                    for j in inside[first(k, s[inside], at[inside])].tolist():
                        for n, x in zip(names, (int(own[i]), place, int(rows[at[j]]), ids[at[j]], max(LONG.min, min(LONG.max, int(s[j]))))):
                            out[n].append(x)
            walk.leave(i, bool(has_children[i]))
    return pa.table({n: pa.array(v, t) for (n, v), t in zip(out.items(), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))})


SEARCHED = "arow long, place int, row long, id long, score long"


def grow_tree(part: pa.Table) -> pa.Table:
    """The anchors of one tree in walking order, with position of the parent, edge and mark of the last child."""
    part = part.sort_by([("id", "ascending"), ("row", "ascending")])
    order, parent, edge, last = spanning_tree(matrix(part.column("v")))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    up = parent[order]
    part = part.take(pa.array(order))
    return pa.table({
        "tree": part.column("tree"), "seq": pa.array(np.arange(len(order))), "row": part.column("row"), "id": part.column("id"), "label": part.column("label"), "v": part.column("v"),
        "parent": pa.array(np.where(up < 0, -1, place[np.maximum(up, 0)])), "edge": pa.array(edge[order]), "last": pa.array(last[order])})


# the job ----------------------------------------------------------------------------------------------------------

def usable(vec: Column) -> Column:
    """The vector is there and every component is a number that stays finite when scaled."""
    return vec.isNotNull() & F.coalesce(F.forall(vec, lambda x: F.coalesce(F.abs(x.cast("double")) * SCALE < float("inf"), F.lit(False))), F.lit(False))


def mine_negatives(vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding", positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90, per_tree: int = 2048, block: int = 2048) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of the vectors after ``floor(256 x)``. An anchor's positives are its first
    ``positives`` other rows of the same label; of the rows of another label with a score between ``low`` and
    ``high`` per cent of the positive's, the first ``negatives`` are returned. Ties go to the smaller id.

    Anchors are dealt into trees of about ``per_tree``, candidates into blocks of about ``block`` rows, both by
    hash, and each tree meets each block in one task. Its root is scored against all of the block; further
    down the score at the parent, plus or minus edge length times candidate norm, bounds the score, and
    only candidates whose interval meets a window are scored. All windows are closed intervals of whole
    numbers, all scores exact at any size; a score that no long can hold counts as the nearest long.

    Rows without label or vector, or with a null or non-finite component, take no part. Vectors of unequal
    length are compared as if the shorter ended in zeros. A null ``is_anchor`` is no anchor. Null ids come
    last among ties and are returned as null. Rows that repeat an id are rows of their own; of an anchor
    that is repeated each row is an anchor with results of its own. An empty table, no anchors, or an
    anchor without positives or fitting negatives give no rows. Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(vec_col).alias("v"))
    rows = written(rows.filter(F.col("label").isNotNull() & usable(F.col("v"))).withColumn("row", F.monotonically_increasing_id()))
    total, asked = rows.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    trees, blocks = max(1, -(-asked // per_tree)), max(1, -(-total // block))
    deal = lambda n: F.pmod(F.xxhash64("row", F.lit(n)), F.lit(n)).cast("int")
    kind = dict(rows.dtypes)["v"]
    grown = written(rows.filter("anchor").select(deal(trees).alias("tree"), "row", "id", "label", "v").groupBy("tree").applyInArrow(
        grow_tree, f"tree int, seq long, row long, id long, label string, v {kind}, parent long, edge double, last boolean"))
    right = rows.select(deal(blocks).alias("block"), "row", "id", "label", "v").withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).groupBy("tree", "block")

    def meet(asking: DataFrame, k: int, wanted: bool) -> DataFrame:
        left = asking.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("tree", "block")
        found = left.cogroup(right).applyInArrow(partial(search, k=k, low=low, high=high, negatives=wanted), SEARCHED)
        best = Window.partitionBy("arow", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    near = meet(grown, positives, False)
    lists = written(near.groupBy("arow").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p")))     # at most ``positives`` each
    asking = grown.join(lists, grown.row == lists.arow, "left").drop("arow")       # anchors without positives stay in the walk, since others hang from them
    far = meet(asking, negatives, True)
    places = asking.select(F.col("row").alias("arow"), F.col("id").alias("anchor_id"), F.posexplode("p").alias("place", "p"))
    return far.join(places, ["arow", "place"]).select(
        "anchor_id", F.col("p.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(vectors, F.col("vec_id") % 100 == 0, label)


QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLE = {
    "op12_hard_negatives": """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) <= 5)
SELECT p.a_id AS anchor_id, p.b_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.b_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a_id = p.a_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.a_id, p.b_id ORDER BY n.score DESC, n.b_id) QUALIFY row_number() OVER w <= 10""",
}
