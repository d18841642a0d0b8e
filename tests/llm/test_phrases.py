"""Phrase mining against brute force; the filters against exact round trips."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from replistat.llm import phrases


@pytest.mark.parametrize("bits", [2, 5, 17, 21, 22, 33, 42])
def test_keys_come_back_and_never_meet(bits):
    rng = np.random.default_rng(bits)
    ids = [rng.integers(0, 1 << bits, 5000) for _ in range(3)]
    keys = phrases.Keys(bits)
    q, r = keys.split(ids)
    assert all((x == y).all() for x, y in zip(keys.join(q, r), ids))
    assert int(q.max()) < 1 << keys.high and int(r.max()) < 1 << keys.low
    assert len(set(zip(q.tolist(), r.tolist()))) == len(set(zip(*(x.tolist() for x in ids))))


@pytest.mark.parametrize("bits", [4, 21, 40])
def test_filters_are_lossless_and_merge(bits):
    rng = np.random.default_rng(1)
    keys, want, parts = phrases.Keys(bits), Counter(), []
    for size in (0, 1, 4000, 3000):
        ids = [rng.integers(0, min(1 << bits, 12), size) for _ in range(3)]
        want.update(zip(*(x.tolist() for x in ids)))
        if size == 3000:
            ids = [np.concatenate([x, np.full(400, 3)]) for x in ids]           # a counter over a byte
            want[3, 3, 3] += 400
        q, r, n = phrases.merged(keys, *keys.split(ids))
        packed = phrases.pack(q, r, n)
        assert all((a == b).all() for a, b in zip(phrases.unpack(packed), (q, r, n)))
        parts.append(phrases.unpack(packed))
    q, r, n = phrases.merged(keys, *(np.concatenate(x) for x in zip(*parts)))
    assert dict(zip(zip(*(x.tolist() for x in keys.join(q, r))), n.tolist())) == dict(want)
    assert (np.diff(q.astype(object)) >= 0).all()


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return [w for w in (re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)) if w]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aAbÄ .,\t\n\r\x0b\x1c\x85", max_size=40), max_size=5), st.integers(1, 12))
def test_encoding(texts, slab):
    old, phrases.SLAB = phrases.SLAB, slab
    try:
        words, codes = phrases.encode(t.encode() for t in texts)
    finally:
        phrases.SLAB = old
    got, piece = [], []
    for c in [*codes.tolist(), 0]:
        if c:
            piece.append(words[c - 1].decode())
        elif piece:
            got.append(piece)
            piece = []
    assert got == [p for t in texts for p in tokens(t)]


def brute(rows, least, top, covered):
    out = []
    for lang in {r[1] or "und" for r in rows}:
        f, n = Counter(), 0
        for _, own, text in rows:
            if (own or "und") == lang:
                for p in tokens(text or ""):
                    n += len(p)
                    f.update(tuple(p[i:i + k]) for k in (1, 2, 3) for i in range(len(p) - k + 1))
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in cand.items():
            if len(p) == 2 and any(100 * b >= covered * a for q, b in cand.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            s, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows_.append((s, a, " ".join(p), l, r))
        rows_.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n, s) for i, (s, a, p, l, r) in enumerate(rows_[:top])]
    return sorted(out)


def test_mining_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    vocab = ["a", "B", "b", "the", "ä", "Ä", "z\x1c", "日本", "x-y", "#"]
    rows = [(i, ["en", "de", None, "und"][i % 4], "".join(str(rng.choice(vocab)) + str(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"])) for _ in range(300))) for i in range(24)]
    rows += [(None, "en", None), (1, "en", ""), (1, "en", "the b " * 2000), (2, "fr", "the b"), (3, "de", rows[1][2])]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, lang string, text string, a int, rank string")
    for kw in ({"least": 3, "top": 40}, {"least": 1, "top": 10**6, "covered": 90}):
        got = sorted(tuple(r) for r in phrases.mine_phrases(df, **kw).collect())
        assert got == brute(rows, kw["least"], kw["top"], kw.get("covered", 50)) and got
    pieces = [x for p in (16, 1000) for x in phrases.count_phrases(df.repartition(p), F.coalesce("lang", F.lit("und")), F.col("text"), least=2, chunk=700, per_shard=50)[1:2]]
    assert pieces[0].groupBy().sum("f").collect() == pieces[1].groupBy().sum("f").collect()


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 10**14 + 7, 10**14 + 9, 10**15 - 1
    sql = phrases.SCORE.replace("x.l", str(l)).replace("x.r", str(r)).replace("as decimal", "AS DECIMAL")
    got = spark.sql(f"SELECT {sql} AS s FROM (SELECT CAST({a} AS BIGINT) AS a)").first()[0]
    assert got == 10**6 * a * a // (l * r)
    near = spark.sql(f"SELECT {phrases.SCORE.replace('x.l', '999999999999998').replace('x.r', '999999999999999')} AS s FROM (SELECT CAST(999999999999998 AS BIGINT) AS a)").first()[0]
    assert near == 10**6 * 999999999999998 // 999999999999999


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert phrases.mine_phrases(empty).collect() == []
    assert phrases.mine_phrases(spark.createDataFrame([(1, None, "one two. "), (2, None, None)], empty.schema)).collect() == []
