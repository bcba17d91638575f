"""Cores by decrements and shortest paths by distance."""

import heapq
import math
import random
from collections import Counter

import pytest

from graphloom import projections
from graphloom.graph import Graph
from graphloom.operators import cohesion, traversal


def graph(spark, n, edges, directed=False):
    return Graph(spark.range(n), spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src long, dst long, weight double"), directed)


def cores(n, edges):
    core = dict.fromkeys(range(n), 0)
    for k in range(1, 60):
        left = list(edges)
        while True:
            deg = Counter(x for a, b, _ in left for x in (a, b))
            stay = [e for e in left if deg[e[0]] >= k and deg[e[1]] >= k]
            if len(stay) == len(left):
                break
            left = stay
        for x in {x for a, b, _ in left for x in (a, b)}:
            core[x] = k
        yield k, {x: d for x, d in Counter(x for a, b, _ in left for x in (a, b)).items()}
    yield 0, core


@pytest.mark.parametrize("whole", [0.0, 0.25, 2.0])
def test_cores(spark, whole):
    r = random.Random(9)
    edges = [(int(r.random() ** 2 * 40), r.randrange(40), 1) for _ in range(190)] + [(5, 5, 1), (5, 6, 1), (5, 6, 1)]
    g = graph(spark, 42, edges)
    want = dict(cores(42, edges))
    steps = []
    assert {x["id"]: x["coreness"] for x in cohesion.coreness(g, whole=min(whole, 1.0) if whole < 2 else -1.0, steps=steps).collect()} == want[0]
    assert {how for how, _ in steps} <= {"all", "some"}
    for k in (1, 4, 7):
        assert {x["id"]: x["core_degree"] for x in cohesion.kcore(g, k).collect()} == want[k]


def test_only_what_changes_is_looked_at(spark):
    """Along a path two vertices fall in each round, and nobody else looks at its neighbours."""
    steps = []
    found = {x["id"]: x["coreness"] for x in cohesion.coreness(graph(spark, 17, [(i, i + 1, 1) for i in range(15)]), steps=steps).collect()}
    assert found == dict.fromkeys(range(16), 1) | {16: 0}
    assert steps[0][0] == "all" and {how for how, _ in steps[1:]} == {"some"} and all(n <= 2 for _, n in steps)


@pytest.mark.parametrize("width", [0.0, 1.0, 7.5, None])
def test_near_and_far(spark, width):
    r = random.Random(11)
    edges = [(r.randrange(60), r.randrange(60), r.choice([0, 1, 2, 9, 30])) for _ in range(400)]
    dist, heap = {}, [(0.0, 0)]
    while heap:
        d, x = heapq.heappop(heap)
        if x not in dist:
            dist[x] = d
            for a, b, w in edges:
                if a == x:
                    heapq.heappush(heap, (d + w, b))
    found = traversal.sssp(graph(spark, 62, edges, True), 0, split=0, width=width)
    assert {x["id"]: x["dist"] for x in found.collect()} == {i: dist.get(i, math.inf) for i in range(62)}


def test_fewer_relaxations(spark):
    g = projections.dense(spark, "/root/testdata/sf0.001").fixed()
    plain, split = [], []
    a = {x["id"]: x["dist"] for x in traversal.sssp(g, 0, relaxed=plain).collect()}
    assert a == {x["id"]: x["dist"] for x in traversal.sssp(g, 0, split=0, relaxed=split).collect()}
    assert sum(split) < 0.6 * sum(plain), (plain, split)
