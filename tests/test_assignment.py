"""Optimal assignment by reductions against enumeration and against the one-task solver."""

import random

import pytest

from replistat.operators import assignment, matching


def enumerate_best(edges):
    best = [(0, 0.0)]

    def go(i, used, c, d):
        best[0] = max(best[0], (c, -d))
        for j in range(i, len(edges)):
            a, b, w = edges[j]
            if (0, a) not in used and (1, b) not in used:
                go(j + 1, used | {(0, a), (1, b)}, c + 1, d + w)

    go(0, frozenset(), 0, 0.0)
    return best[0]


def components(seed, many=16):
    """Chains, rings, stars, dense and random small graphs, with ties."""
    rnd, out = random.Random(seed), []
    for i in range(many):
        n, es, kind = rnd.randrange(2, 6), {}, i % 5
        if kind == 0:
            es = {((k + 1) // 2, k // 2): rnd.randrange(1, 30) / 4 for k in range(11)}
        elif kind == 1:
            for k in range(n):
                es[k, k], es[k, (k + 1) % n] = rnd.random(), rnd.choice([0.5, 0.25])
        elif kind == 2:
            es = {(0, k): rnd.random() for k in range(5)} | {(k, 0): rnd.random() for k in range(4)}
        elif kind == 3:
            es = {(a, b): rnd.randrange(1, 6) / 2 for a in range(3) for b in range(4)}
        else:
            es = {(rnd.randrange(n), rnd.randrange(n)): rnd.choice([1.0, 2.0, 2.5, rnd.random() * 5]) for _ in range(12)}
        out.append([((i, a), (i, b), w) for (a, b), w in es.items()])
    return out


def check(got, parts):
    assert len({r["a_id"] for r in got}) == len({r["b_id"] for r in got}) == len(got)
    weight = {(str(a), str(b)): w for es in parts for a, b, w in es}
    assert all(weight[r["a_id"], r["b_id"]] == r["distance"] for r in got)
    for i, es in enumerate(parts):
        mine = [r["distance"] for r in got if r["a_id"].startswith(f"({i},")]
        count, total = enumerate_best(es)
        assert len(mine) == count and sum(mine) == pytest.approx(-total)


def frame(spark, parts):
    return spark.createDataFrame([(str(a), str(b), w) for es in parts for a, b, w in es], "a_id string, b_id string, distance double")


@pytest.mark.parametrize("seed,kernel", [(1, 0), (2, 60)])
def test_reductions_keep_the_optimum(spark, seed, kernel):
    parts = components(seed)
    check(assignment.best_matching(frame(spark, parts), kernel).collect(), parts)


def test_large_components_take_the_rounds(spark):
    parts = components(3, 8)
    edges = frame(spark, parts)
    check(matching.optimal_matching(edges, "a_id", "b_id", one_task=9).collect(), parts)
    check(matching.optimal_matching(edges, "a_id", "b_id").collect(), parts)
    assert assignment.best_matching(edges.limit(0)).collect() == []


def test_small_solver_by_enumeration():
    for seed in range(400):
        rnd = random.Random(seed)
        es = {(rnd.randrange(5), rnd.randrange(5)): rnd.choice([1, 2, -1, 500 - rnd.random(), 497.5, 1000.0]) for _ in range(rnd.randrange(1, 12))}
        best = [0.0]

        def go(i, ua, ub, w, items=list(es.items()), best=best):
            best[0] = max(best[0], w)
            for j in range(i, len(items)):
                (a, b), x = items[j]
                if a not in ua and b not in ub:
                    go(j + 1, ua | {a}, ub | {b}, w + x)

        go(0, frozenset(), frozenset(), 0.0)
        chosen = assignment.heaviest_matching([(a, b, w) for (a, b), w in es.items()])
        assert len({a for a, _ in chosen}) == len({b for _, b in chosen}) == len(chosen)
        assert sum(es[k] for k in chosen) == pytest.approx(best[0])


def test_components_that_share_one_end_need_no_solver(spark, monkeypatch):
    """Stars, with ties settled by ids, never reach the grouped function."""
    monkeypatch.setattr(matching, "_assignment", lambda: lambda pdf: 1 / 0)
    rows = [(1, 10, 2.0), (1, 11, 1.0), (1, 12, 1.0), (2, 20, 3.0), (3, 20, 3.0), (4, 20, 5.0), (5, 30, 1.0)]
    edges = spark.createDataFrame(rows, "a_id long, b_id long, distance double")
    got = {(r["a_id"], r["b_id"]) for r in matching.optimal_matching(edges, "a_id", "b_id").collect()}
    assert got == {(1, 11), (2, 20), (5, 30)}


def test_many_rows_are_never_broadcast(spark, monkeypatch):
    """Stored tables of the rounds stay small files but may hold many rows: none goes through the driver."""
    from replistat import session
    from replistat.operators import graph

    seen = []
    write = session.cut_lineage

    def watched(df, slot=None):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, slot)

    for module in (matching, graph):
        monkeypatch.setattr(module, "cut_lineage", watched)
        monkeypatch.setattr(module, "unless_large", lambda df: session.unless_large(df, rows=50))
    ids = spark.range(2000)
    edges = ids.selectExpr("id div 2 a_id", "(id + 1) div 2 b_id", "cast(id % 7 as double) distance").filter("a_id % 3 > 0 OR b_id % 3 > 0")
    got = matching.optimal_matching(edges, "a_id", "b_id")
    seen.append(got._jdf.queryExecution().executedPlan().toString())
    assert got.count() == edges.select("a_id").distinct().count()
    assert len(seen) > 5 and not any("BroadcastHashJoin" in p for p in seen)
