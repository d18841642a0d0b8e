"""Quality rules: base counts against brute force, the forest against a slow walk, held-out labels."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from replistat.llm import anomaly

SMALL = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = {w for w in windows if windows.count(w) > 1} if len(windows) < 300 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {i + j for i, w in enumerate(windows) if w in often for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines)) if len(lines) < 500 else len(lines) - len(set(lines))
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


@pytest.mark.parametrize("text", [None, "", " \t\n\r\x0b\x0c ", "a", "a a a a", "a b c a b c d", "x\n x\nx\n\n\n \nx\r\nx\r", "é ü#|<>&%$* é", "a\x1cb \x85   c", "one two three one two", "z " * 5000])
def test_base_counts(text):
    assert anomaly.statistics(None if text is None else text.encode())[0] == slow_base(text)


def test_very_many_distinct_words():
    words = [f"w{i}" for i in range(1_100_000)]
    text = " ".join([*words, *words[5:9]]).encode()
    assert anomaly.statistics(text)[0][4] == 8


def test_forest_matches_slow_walk_and_finds_outliers():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(500, 4)), rng.normal(size=(5, 4)) + 9, np.zeros((20, 4))])
    f = anomaly.grow(x, 50, 128, 1)

    def depth(row, root):
        at = root
        while f.feature[at] >= 0:
            at = f.child[at] + int(row[f.feature[at]] >= f.cut[at])
        return f.depth[at]

    slow = [2 ** -(sum(depth(r, root) for root in f.roots) / (50 * anomaly.expected_path(128))) for r in x]
    got = f.scores(x)
    assert np.allclose(got, slow) and got[500:505].min() > np.quantile(got[:500], 0.99)
    assert anomaly.grow(np.ones((10, 3)), 5, 8, 0).scores(np.zeros((2, 3))).tolist() == [pytest.approx(0.5)] * 2


def test_best_step_against_every_step():
    rng = np.random.default_rng(4)
    for _ in range(20):
        good, bad = ({int(k): int(n) for k, n in zip(rng.integers(1000, 3000, 30), rng.integers(1, 50, 30))} for _ in range(2))
        share = lambda d, t: sum(n for s, n in d.items() if s > t) / sum(d.values())
        gain = lambda t: share(bad, t) - 3 * share(good, t)
        assert gain(anomaly.best_step(good, bad, 3.0)) == pytest.approx(max(gain(t) for t in range(anomaly.STEPS + 1)))
    assert anomaly.best_step({}, {1: 1}, 1.0) == anomaly.best_step({1: 1}, {}, 1.0) == anomaly.STEPS


def test_whole_table_rejects_bad_and_keeps_good(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(None, "w " * 60), (10**9, None), (10**9 + 1, ""), (10**9 + 2, "Erin therble hendan of. " * 3 + "### $$$ *** " * 40)], "doc_id long, text string")
    docs = docs.select("doc_id", "text", "lang").unionByName(odd, allowMissingColumns=True).withColumns({"kept": F.lit("x"), "__id": F.lit(1), "n_words": F.lit(None)})
    half = labels.filter("doc_id % 2 = 0").unionByName(spark.createDataFrame([(None, 0, 0), (4, None, 0)], labels.schema))
    out = anomaly.tag_quality(docs, half)
    assert out.columns == ["doc_id", "lang", "__id", *anomaly.BASE, "base_failed", "anomaly", "kept"]
    rows = out.collect()
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        base = slow_base(texts[r["doc_id"]])
        assert [r[c] for c in anomaly.BASE] == base
        assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0]) and 0 < r["anomaly"] <= 1
        assert not (r["kept"] and r["base_failed"])
    verdict = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in rows}
    assert not verdict[10**9 + 2][1]
    unseen = [(*verdict[r["doc_id"]], r["quality"]) for r in labels.filter("doc_id % 2 = 1").collect()]
    passing = [(k, q) for b, k, q in unseen if not b]
    assert np.mean([k for k, q in passing if q == 1]) > 0.97 and np.mean([not k for k, q in passing if q == 0]) > 0.9
    again = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in anomaly.tag_quality(docs.repartition(7), half).collect()}
    assert again == verdict


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k " * 10), (2, " ".join(f"w{i}" for i in range(60)))], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["doc_id"]: (r["kept"], r["anomaly"]) for r in anomaly.tag_quality(docs, none).collect()} == {1: (False, None), 2: (True, None)}
    one = spark.createDataFrame([(2, 1)], "doc_id long, quality int")
    assert {r["doc_id"]: r["kept"] for r in anomaly.tag_quality(docs, one).collect()} == {1: False, 2: True}
    assert anomaly.tag_quality(docs.limit(0), one).collect() == []
    assert math.isclose(anomaly.expected_path(256), 10.2448, abs_tol=1e-3)
