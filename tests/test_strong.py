"""Strong components and longest paths in rounds, against plain searches."""

from __future__ import annotations

import random

import pytest

from peakmill.functions import kernels
from peakmill.operators import strong


def digraph(seed):
    rng = random.Random(seed)
    n = rng.randint(2, 40)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * rng.choice([0.8, 1.2, 2.0])))]


def test_strong_components(spark):
    # many graphs at once, side by side
    edges = [(100 * part + a, 100 * part + b) for part in range(40) for a, b in digraph(part)]
    got = {r.node: r.component for r in strong.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    nodes = sorted({v for e in edges for v in e})
    nexts = {v: sorted({b for a, b in edges if a == v and b != v}) for v in nodes}
    want = {v: min(p) for p in kernels.strong_components(nodes, nexts) for v in p}
    assert got == want


def test_long_ring_and_odd_edges(spark):
    n = 30
    ring = [((i * 7) % n, ((i + 1) * 7) % n) for i in range(n)]
    rows = [*ring, *ring, (3, 3), (1000, 1000), (None, 5), (5, None), (0, 500), (500, 501)]
    got = {r.node: r.component for r in strong.strong_components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 500: 500, 501: 501, 1000: 1000}
    none = spark.createDataFrame([], "src long, dst long")
    assert strong.strong_components(none).count() == 0


def brute_longest(cost, edges):
    into = {}
    for a, b in set(edges):
        into.setdefault(b, []).append(a)
    dist, before = {}, {}

    def at(v):
        if v not in dist:
            reach = [(at(u) + cost[v], u) for u in into.get(v, [])]
            dist[v] = max((d for d, _ in reach), default=0)
            before[v] = sorted((u for d, u in reach if d == dist[v]), key=lambda u: (-cost[u], u))
        return dist[v]

    for v in cost:
        at(v)
    return dist, before


def test_longest_paths(spark):
    rng = random.Random(5)
    cost = {v: rng.randint(0, 4) for v in range(150)}
    edges = [(a, b) for a, b in ((rng.randrange(150), rng.randrange(150)) for _ in range(260)) if a < b and a // 40 <= b // 40]
    found = strong.longest_paths(spark.createDataFrame(list(cost.items()), "node long, cost long"), spark.createDataFrame(edges, "src long, dst long"))
    rows = {r.node: (r.dist, list(r.before)) for r in found.collect()}
    dist, before = brute_longest(cost, edges)
    assert rows == {v: (dist[v], before[v]) for v in cost}
    ends = [v for v in cost if not any(a == v for a, _ in edges)][:20]
    for r in strong.walks(found, spark.createDataFrame([(v,) for v in ends], "end long")).collect():
        want = [r.end]
        while before[want[0]]:
            want.insert(0, before[want[0]][0])
        assert list(r.walk) == want


def test_longest_paths_refuse_cycles(spark):
    with pytest.raises(ValueError):
        strong.longest_paths(spark.createDataFrame([(1, 1), (2, 1)], "node long, cost long"), spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long"))


def test_condensed_edges(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (1, 3)], "src long, dst long")
    assert [tuple(r) for r in strong.condensed(e, strong.strong_components(e)).collect()] == [(1, 3)]


def test_rounds_send_nothing_through_the_driver(spark, monkeypatch):
    plans = []
    for name in ("materialize", "materialize_while"):
        real = getattr(strong, name)
        monkeypatch.setattr(strong, name, lambda df, *a, real=real: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, *a))[1])
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6)], "src bigint, dst bigint")
    found = strong.strong_components(edges)
    assert {(r.node, r.component) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)}
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
