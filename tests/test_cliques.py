"""Cliques counted by bitmaps of several words."""

import random
from itertools import combinations
from math import comb

from graphloom.graph import Graph
from graphloom.operators import cohesion


def cliques(g, k):
    return cohesion.kclique(g, k).first()["cliques"]


def test_more_neighbours_than_a_word_has_bits(spark):
    whole = spark.createDataFrame([*combinations(range(70), 2), (69, 70)], "src long, dst long")
    g = Graph(spark.range(71), whole, False)
    assert [cliques(g, k) for k in (2, 3, 4)] == [comb(70, 2) + 1, comb(70, 3), comb(70, 4)]


def test_sparse_cliques(spark):
    """A hub of 150 neighbours, among which are a few small cliques, parallel edges and self-loops."""
    r = random.Random(6)
    edges = [(0, i) for i in range(1, 151)] + [p for c in ((1, 60, 130, 149), (2, 3, 4, 5, 6), (140, 141, 142)) for p in combinations(c, 2)] + [(r.randrange(151), r.randrange(151)) for _ in range(60)] + [(7, 7), (1, 0)]
    simple = {frozenset(e) for e in edges if e[0] != e[1]}
    near = {i: {j for j in range(151) if frozenset((i, j)) in simple} for i in range(151)}

    def plain(k, members=(), allowed=None):
        allowed = set(range(151)) if allowed is None else allowed
        return 1 if not k else sum(plain(k - 1, (*members, i), {j for j in allowed & near[i] if j > i}) for i in allowed)

    g = Graph(spark.range(151), spark.createDataFrame(edges, "src long, dst long"), False)
    assert [cliques(g, k) for k in (3, 4, 5, 6, 7)] == [plain(k) for k in (3, 4, 5, 6, 7)]


def test_triangles_are_looked_for_once(spark):
    """One join makes the triangles, whose three corners come from its rows; the other meets the vertices."""
    edges = spark.createDataFrame([*combinations(range(9), 2), (8, 9)], "src long, dst long")
    g = Graph(spark.range(10), edges, False)
    counts = cohesion.triangle_counts(g)
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    assert {r["id"]: r["triangles"] for r in counts.collect()} == {i: comb(8, 2) if i < 9 else 0 for i in range(10)}
    directed = cohesion.lcc_directed(Graph(spark.range(10), edges.unionAll(edges.where("src = 0")), True))
    assert directed._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 4
