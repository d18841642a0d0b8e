"""Quality rules: an isolation forest over rule statistics, with a threshold calibrated from labelled rows."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replistat.llm.common import chosen_ids, table, written

#: Fixed by the result contract.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEAT = 50, 50
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "variety", "capitals", "digits", "stops", "marks", "single", "line_words", "longest", "words")
RESULT = (*BASE, "base_failed", "anomaly", "kept")
#: Scores are compared in steps of 1 / STEPS, so that the calibration reads a table of bounded size.
STEPS = 4096

WHITE_BYTES = np.array([9, 10, 11, 12, 13, 32])
STOP_BYTES = np.frombuffer(b".,;:!?", np.uint8)
MARK_BYTES = np.setdiff1d(np.r_[33:48, 58:65, 91:97, 123:127], STOP_BYTES)


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """The five base counts (BASE) and the thirteen rule statistics (FEATURES) of one whole text."""
    text = text or b""
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n, index = len(words), defaultdict(count().__next__)
    ids = np.fromiter(map(index.__getitem__, words), np.int64, n)
    used = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = len(text) - int(used[128:192].sum()) - int(used[WHITE_BYTES].sum())
    covered, distinct = np.zeros(n, bool), len(index)
    if n > 2:
        pair = ids[:-1] * distinct + ids[1:]
        if distinct >= 1 << 20:                      # three ids no longer fit a long: name the pairs first
            pair = np.unique(pair, return_inverse=True)[1]
        _, name, often = np.unique(pair[:-1] * distinct + ids[2:], return_inverse=True, return_counts=True)
        again = often[name] > 1
        for shift in range(3):
            covered[shift:n - 2 + shift] |= again
    base = [n, chars, int(used[np.frombuffer(SYMBOLS, np.uint8)].sum()), len(lines) - len(set(lines)), int(covered.sum())]
    upper, lower, one = int(used[65:91].sum()), int(used[97:123].sum()), max(n, 1)
    return base, [
        chars / one, base[2] / one, base[3] / max(len(lines), 1), base[4] / one, math.log(max(distinct, 1)) / math.log(n) if n > 1 else 1.0, upper / max(upper + lower, 1),
        int(used[48:58].sum()) / max(chars, 1), int(used[STOP_BYTES].sum()) / one, int(used[MARK_BYTES].sum()) / one, sum(len(w) == 1 for w in words) / one,
        math.log1p(n / max(len(lines), 1)), math.log1p(max(map(len, words), default=0)), math.log1p(n)]


def expected_path(n: float) -> float:
    """Mean depth at which a search in a random binary tree of ``n`` points ends without success."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


@dataclass
class Forest:
    """All trees in arrays: a node has a feature and a cut, or (feature -1) the path length of its leaf."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray        # left one; the right one is next to it
    depth: np.ndarray
    norm: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score from 0 to 1 per row: 2 to the minus mean path length over its expectation."""
        total, row = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots.tolist():
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.where(inner, self.child[at] + (x[row, np.maximum(f, 0)] >= self.cut[at]), at)
            total += self.depth[at]
        return np.exp2(-total / (max(len(self.roots), 1) * self.norm)) if self.norm > 0 else np.full(len(x), 0.5)


def grow(x: np.ndarray, trees: int, per_tree: int, seed: int) -> Forest:
    """Random cuts between the smallest and largest value of a random feature, until rows stand alone or the depth is that of a balanced tree."""
    rng = np.random.default_rng(seed)
    size = min(per_tree, len(x))
    deepest = max(1, math.ceil(math.log2(max(size, 2))))
    feature, cut, child, depth, roots = [], [], [], [], []

    def node() -> int:
        for values, empty in ((feature, -1), (cut, 0.0), (child, 0), (depth, 0.0)):
            values.append(empty)
        return len(feature) - 1

    for _ in range(trees):
        roots.append(node())
        stack = [(roots[-1], x[rng.choice(len(x), size, replace=False)], 0)]
        while stack:
            at, rows, level = stack.pop()
            low, high = rows.min(0), rows.max(0)
            open_ = np.flatnonzero(high > low)
            if level >= deepest or not open_.size:
                depth[at] = level + expected_path(len(rows))
                continue
            f = int(rng.choice(open_))
            c = min(max(float(rng.uniform(low[f], high[f])), float(np.nextafter(low[f], np.inf))), float(high[f]))
            left, right = node(), node()
            feature[at], cut[at], child[at] = f, c, left
            above = rows[:, f] >= c
            stack += [(left, rows[~above], level + 1), (right, rows[above], level + 1)]
    return Forest(np.array(roots), np.array(feature), np.array(cut), np.array(child), np.array(depth), expected_path(size))


def telling(x: np.ndarray, good: np.ndarray, share: float = 0.1) -> np.ndarray:
    """The statistics in which at least ``share`` of the bad rows lie outside 99 % of the good ones; all, where none does or one kind is absent."""
    every = np.arange(x.shape[1])
    if good.all() or not good.any():
        return every
    low, high = np.quantile(x[good], [0.005, 0.995], axis=0)
    use = every[((x[~good] < low) | (x[~good] > high)).mean(0) >= share]
    return use if use.size else every


def measured(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` without the text, with the base counts and a list ``__x`` of rule statistics; batches stay in tasks."""
    rest = [c for c in rows.columns if c != text_col]
    given = rows.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__row") if rest else F.struct(F.lit(0)).alias("__row"), F.col(f"`{text_col}`").cast("binary").alias("__t"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            found = [statistics(t.as_py()) for t in rb.column("__t")]
            cols = [pa.array([b[i] for b, _ in found], pa.int64()) for i in range(len(BASE))]
            yield pa.RecordBatch.from_arrays([rb.column("__row"), *cols, pa.array([x for _, x in found], pa.list_(pa.float64()))], names=["__row", *BASE, "__x"])

    return given.mapInArrow(read, f"__row {given.schema['__row'].dataType.simpleString()}, {', '.join(b + ' long' for b in BASE)}, __x array<double>")


def failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT * F.col("n_words"))


def best_step(good: dict[int, int], bad: dict[int, int], cost: float) -> int:
    """Highest step that is kept: most of (share of bad rows above) - cost x (share of good rows above); the middle of a tie."""
    if not bad or not good:
        return STEPS
    n_good, n_bad = sum(good.values()), sum(bad.values())
    lost = np.cumsum([good.get(s, 0) for s in range(STEPS, 0, -1)])[::-1] / n_good          # [t]: share of steps above t
    caught = np.cumsum([bad.get(s, 0) for s in range(STEPS, 0, -1)])[::-1] / n_bad
    gain = np.append(caught - cost * lost, 0.0)
    top = int(gain.argmax())
    if gain[top] <= 0:
        return STEPS
    end = top
    while end + 1 < len(gain) and gain[end + 1] == gain[top]:
        end += 1
    return (top + end) // 2


def tag_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 8192, trees: int = 100,
                per_tree: int = 256, cost: float = 20.0, seed: int = 42) -> DataFrame:
    """``docs`` without its text, with the base counts, base_failed, anomaly (score) and kept.

    Each text becomes thirteen rule statistics (FEATURES). Random trees cut them at random; rows that few
    cuts set apart are anomalous. The forest is fitted on at most ``sample`` labelled rows, chosen by hash of
    the id, and cuts only the statistics in which their bad rows leave the range of the good. The threshold comes from all labelled rows that pass the base rules: a table of scores in
    STEPS steps says how many good (label 1) and bad (label 0) rows lie above each; losing a share of the
    good ones must catch more than ``cost`` times that share of the bad ones.

    Null text counts as empty and fails the base rules, as does any text under 50 words. Without labels, or
    with labels of one kind only, nothing is rejected beyond the base rules (without labels anomaly is null). Null ids have no
    label; null labels are left out; of labels that repeat an id the lowest counts, and of rows that
    repeat an id each counts. An empty table gives an empty result. Columns named as the results are
    replaced, others pass through.
    """
    rows = docs.drop(*[c for c in RESULT if c not in (id_col, text_col)])
    rows = written(measured(rows, text_col).withColumn("__id", F.col(f"__row.`{id_col}`")))
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__good"))
    judged = written(rows.filter(~failed()).select("__id", "__x").join(known, "__id"))
    chosen = written(chosen_ids(judged, "__id", sample))
    picked = judged.join(chosen, "__id").groupBy("__id").agg(F.min("__x").alias("x"), F.min("__good").alias("good")).orderBy("__id").collect()        # at most ``sample`` rows
    if picked:
        x = np.array([r["x"] for r in picked])
        use = telling(x, np.array([r["good"] > 0 for r in picked]))
        forest = grow(x[:, use], trees, per_tree, seed)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                x = np.asarray(rb.column("__x").flatten()).reshape(-1, len(FEATURES))
                rest = rb.select([n for n in rb.schema.names if n != "__x"])
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(forest.scores(x[:, use]))], names=[*rest.schema.names, "anomaly"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__x")
        rows = rows.mapInArrow(score, f"{kinds}, anomaly double")
        seen = judged.mapInArrow(score, f"__id {dict(judged.dtypes)['__id']}, __good {dict(judged.dtypes)['__good']}, anomaly double")
        steps = seen.groupBy(F.round(F.col("anomaly") * STEPS).cast("int").alias("step"), (F.col("__good") > 0).alias("good")).count().collect()   # at most 2 STEPS rows
        good, bad = ({r["step"]: r["count"] for r in steps if r["good"] == g} for g in (True, False))
        fine = F.round(F.col("anomaly") * STEPS) <= best_step(good, bad, cost)
    else:
        rows, fine = rows.drop("__x").withColumn("anomaly", F.lit(None).cast("double")), F.lit(True)
    return rows.select("__row.*", *BASE, failed().alias("base_failed"), "anomaly", (~failed() & fine).alias("kept"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tag_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", *BASE, "base_failed", "kept", "anomaly")


QUERIES = {"op11_quality_rules": op11_quality_rules}
ORACLE: dict[str, str] = {}
