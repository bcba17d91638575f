"""Hand graphs with answers worked out by hand, and small random graphs against plain Python."""

import heapq
import math
import random
from collections import Counter, deque
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from graphloom.functions import compare
from graphloom.graph import Graph
from graphloom.operators import access, cohesion, community, components, mutate, partition, ranking, sampling, traversal
from graphloom.queries import bfs_program, wcc_program

FAR = traversal.UNREACHED


def graph(spark, ids, edges, directed=False):
    rows = [(a, b, float(w)) for a, b, w in edges]
    return Graph(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(rows, "src long, dst long, weight double"), directed)


def plain(edges):
    return [(a, b, 1) for a, b in edges]


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def some_graph(seed, n=14, m=26):
    r = random.Random(seed)
    return list(range(n)), [(r.randrange(n), r.randrange(n), r.randrange(1, 9)) for _ in range(m)]


def test_empty_and_isolated(spark):
    for ids in ([], [5]):
        g = graph(spark, ids, [])
        far = dict.fromkeys(ids, FAR)
        assert as_dict(traversal.bfs(g, 1)) == far
        assert as_dict(traversal.sssp(g, 1)) == dict.fromkeys(ids, math.inf)
        assert as_dict(components.wcc(g)) == {i: i for i in ids}
        assert as_dict(community.cdlp(g, 2)) == {i: i for i in ids}
        assert as_dict(ranking.pagerank(g, rounds=2)) == pytest.approx({i: 1.0 for i in ids})
        assert as_dict(cohesion.lcc(g)) == dict.fromkeys(ids, 0.0)
        assert as_dict(cohesion.coreness(g)) == dict.fromkeys(ids, 0)
        assert cohesion.kcore(g, 1).count() == 0
        assert cohesion.kcore(g, 0).count() == len(ids)
        assert cohesion.kclique(g, 3).first()["cliques"] == 0


def test_path_and_triangles(spark):
    g = graph(spark, range(10), plain([(0, 1), (1, 2), (2, 3), (4, 5), (5, 6), (6, 4)]))
    assert as_dict(traversal.bfs(g, 0)) == {0: 0, 1: 1, 2: 2, 3: 3} | dict.fromkeys(range(4, 10), FAR)
    assert as_dict(components.wcc(g)) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8, 9: 9}
    assert as_dict(cohesion.lcc(g))[5] == 1.0
    assert as_dict(cohesion.coreness(g)) == {0: 1, 1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2, 7: 0, 8: 0, 9: 0}


def test_clique_with_a_pendant(spark):
    g = graph(spark, range(6), plain([*combinations(range(5), 2), (4, 5)]))
    assert [cohesion.kclique(g, k).first()["cliques"] for k in (1, 2, 3, 4, 5, 6)] == [6, 11, 10, 5, 1, 0]
    assert as_dict(cohesion.coreness(g)) == {0: 4, 1: 4, 2: 4, 3: 4, 4: 4, 5: 1}
    assert as_dict(cohesion.kcore(g, 2)) == dict.fromkeys(range(5), 4)
    with pytest.raises(ValueError):
        cohesion.kclique(g, 0)


def test_parallel_edges_and_self_loops(spark):
    g = graph(spark, range(3), plain([(0, 0), (0, 1), (0, 1), (1, 2)]))
    assert as_dict(access.out_degree(g)) == {0: 4, 1: 3, 2: 1}
    assert as_dict(cohesion.lcc(g)) == {0: 0.0, 1: 0.0, 2: 0.0}
    assert cohesion.kcore_size(g, 2).first()["vertices"] == 2
    assert cohesion.kcore_size(g, 3).first()["vertices"] == 0
    d = Graph(g.vertices, g.edges, True)
    assert as_dict(access.out_degree(d)) == {0: 3, 1: 1, 2: 0}
    assert as_dict(access.in_degree(d)) == {0: 1, 1: 2, 2: 1}


def test_diamond_betweenness(spark):
    g = graph(spark, range(5), plain([(0, 1), (0, 2), (1, 3), (2, 3)]))
    rows = {r["id"]: (r["delta"], r["sigma"], r["depth"]) for r in traversal.betweenness(g, 0).collect()}
    assert rows == {0: (3.0, 1.0, 0), 1: (0.5, 1.0, 1), 2: (0.5, 1.0, 1), 3: (0.0, 2.0, 2), 4: (0.0, 0.0, FAR)}


def test_sink_rules(spark):
    """0 -> 2, 1 -> 2, and 2 has no out-edge."""
    g = graph(spark, range(3), plain([(0, 2), (1, 2)]), True)
    n, d = 3, 0.85
    own = 0.15 / n + d * (1 / n) / n
    got = own + d * 2 / n
    first = {s: as_dict(ranking.pagerank(g, rounds=1, sinks=s)) for s in ranking.SINKS}
    assert first["ldbc"] == pytest.approx({0: own, 1: own, 2: got})
    assert first["push"] == pytest.approx({0: own, 1: own, 2: got})
    assert first["drop"] == pytest.approx({0: own, 1: own, 2: own})
    assert sum(as_dict(ranking.pagerank(g, rounds=7)).values()) == pytest.approx(1.0)
    second = as_dict(ranking.pagerank(g, rounds=2, sinks="push"))
    assert second[0] == pytest.approx(0.15 / n + d * own / n)
    assert as_dict(ranking.pagerank(g, rounds=0)) == pytest.approx(dict.fromkeys(range(3), 1 / 3))
    with pytest.raises(ValueError):
        ranking.pagerank(g, sinks="other")


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    ids, edges = some_graph(seed)
    g = graph(spark, ids, edges)
    adj = {i: [] for i in ids}
    for a, b, w in edges:
        adj[a].append((b, w))
        adj[b].append((a, w))
    depth = {0: 0}
    queue = deque([0])
    while queue:
        x = queue.popleft()
        for y, _ in adj[x]:
            if y not in depth:
                depth[y] = depth[x] + 1
                queue.append(y)
    assert as_dict(traversal.bfs(g, 0)) == {i: depth.get(i, FAR) for i in ids}
    assert as_dict(bfs_program(0).run(g)) == {i: depth.get(i, FAR) for i in ids}
    dist, heap = {}, [(0.0, 0)]
    while heap:
        d, x = heapq.heappop(heap)
        if x not in dist:
            dist[x] = d
            for y, w in adj[x]:
                heapq.heappush(heap, (d + w, y))
    assert as_dict(traversal.sssp(g, 0)) == {i: dist.get(i, math.inf) for i in ids}
    comp = {i: i for i in ids}
    for _ in ids:
        for a, b, _ in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert as_dict(components.wcc(g)) == comp
    assert as_dict(wcc_program().run(g)) == comp
    label = {i: i for i in ids}
    for _ in range(3):
        label = {i: min(Counter(label[y] for y, _ in adj[i]).items(), key=lambda x: (-x[1], x[0]))[0] if adj[i] else label[i] for i in ids}
    assert as_dict(community.cdlp(g, 3)) == label
    simple = {frozenset((a, b)) for a, b, _ in edges if a != b}
    for k in (3, 4):
        assert cohesion.kclique(g, k).first()["cliques"] == sum(all(frozenset(p) in simple for p in combinations(c, 2)) for c in combinations(ids, k))
    multi = Counter()
    for a, b, _ in edges:
        multi[a] += 1
        multi[b] += 1
    core = {i: 0 for i in ids}
    for k in range(1, 30):
        left = list(edges)
        while True:
            deg = Counter(x for a, b, _ in left for x in (a, b))
            stay = [e for e in left if deg[e[0]] >= k and deg[e[1]] >= k]
            if len(stay) == len(left):
                break
            left = stay
        for x in {x for a, b, _ in left for x in (a, b)}:
            core[x] = k
    assert as_dict(cohesion.coreness(g)) == core


def test_partitions_dont_change_results(spark):
    ids, edges = some_graph(5)
    g = graph(spark, ids, edges)
    h = Graph(g.vertices.repartition(3), g.edges.repartition(7), False)
    assert as_dict(traversal.sssp(g, 0)) == as_dict(traversal.sssp(h, 0))
    both = Graph(g.vertices, g.symmetrised(), True)
    assert as_dict(traversal.bfs(g, 0)) == as_dict(traversal.bfs(both, 0))


def test_mutation_order(spark):
    g = graph(spark, range(4), [(0, 1, 1), (0, 1, 2), (1, 2, 3), (2, 3, 4)], True)
    ops = spark.createDataFrame([("d", 0, 1, None), ("a", 0, 1, 9.0), ("u", 1, 2, 8.0), ("u", 3, 0, 7.0), ("a", 0, 77, 5.0), ("a", 4, 0, 6.0)], "op string, src long, dst long, weight double")
    moved = spark.createDataFrame([("d", 3), ("a", 4)], "op string, id long")
    new = mutate.apply_changes(g, ops, moved)
    assert sorted(map(tuple, new.edges.collect())) == [(0, 1, 9.0), (1, 2, 8.0), (4, 0, 6.0)]
    assert sorted(r["id"] for r in new.vertices.collect()) == [0, 1, 2, 3, 4]
    und = mutate.apply_changes(Graph(g.vertices, g.edges, False), spark.createDataFrame([("d", 1, 0, None), ("u", 2, 1, 5.0)], ops.schema))
    assert sorted(map(tuple, und.edges.collect())) == [(1, 2, 5.0), (2, 3, 4.0)]
    grown = mutate.append_edges(g, spark.createDataFrame([(9, 0, 1.0)], "src long, dst long, weight double"))
    assert grown.vertices.count() == 5


def test_base_and_changes_equal_the_whole(spark):
    ids, edges = some_graph(8)
    half, rest = edges[:13], edges[13:]
    ops = spark.createDataFrame([("a", a, b, float(w)) for a, b, w in rest], "op string, src long, dst long, weight double")
    changed = mutate.apply_changes(graph(spark, ids, half), ops)
    assert compare.exact(traversal.sssp(changed, 0), traversal.sssp(graph(spark, ids, edges), 0))


def test_unknown_ends(spark):
    edges = spark.createDataFrame([(1, 2), (2, 9), (None, 1)], "src long, dst long")
    ids = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id long")
    assert Graph.of(edges, ids).edges.count() == 1
    assert sorted(r[0] for r in Graph.of(edges, ids).vertices.collect()) == [1, 2]
    assert Graph.of(edges, ids, unknown="add").vertices.count() == 3
    assert Graph.of(edges).vertices.count() == 3


def test_string_ids(spark):
    g = Graph.of(spark.createDataFrame([("a", "b"), ("c", "d")], "src string, dst string"))
    assert as_dict(components.wcc(g)) == {"a": "a", "b": "a", "c": "c", "d": "c"}
    assert as_dict(traversal.bfs(g, "a"))["b"] == 1


def test_partitioners(spark):
    ids = spark.createDataFrame([(i * 10,) for i in range(11)], "id long")
    want = {i * 10: i // 4 for i in range(11)}
    assert as_dict(partition.by_map(ids, 3)) == want
    assert as_dict(partition.by_segment(ids, partition.boundaries(ids, 3))) == want
    assert {r["part"] for r in partition.by_hash(ids, 3).collect()} <= {0, 1, 2}
    edges = spark.createDataFrame([(0, 3), (3, 0), (2, 2)], "src long, dst long")
    assert [r["block"] for r in partition.vertex_cut(edges, 4, 4).orderBy("src", "dst").collect()] == [1, 3, 2]
    with pytest.raises(ValueError):
        partition.vertex_cut(edges, 4, 3)


def greedy(scores, parts, inclusive):
    mean, out, part, held = -(-sum(scores.values()) // parts), {}, 0, 0
    for i in sorted(scores):
        out[i] = part
        held += scores[i]
        if (held >= mean if inclusive else held > mean) and part < parts - 1:
            part, held = part + 1, 0
    return out


@pytest.mark.parametrize("inclusive", [False, True])
def test_rebalance(spark, inclusive):
    ids, edges = some_graph(3)
    deg = Counter(a for a, _, _ in edges)
    want = greedy({i: deg[i] + 1 for i in ids}, 4, inclusive)
    assert as_dict(partition.rebalance(graph(spark, ids, edges, True), 4, 1, inclusive)) == want


def test_sampling(spark):
    g = graph(spark, range(5), [(0, 1, 3), (0, 2, 3), (0, 3, 1), (1, 4, 1)], True)
    roots = spark.createDataFrame([(0,), (4,), (0,)], "id long")
    top = {r["root"]: r["nbrs"] for r in sampling.rows(sampling.sample(g.adjacency, roots, [4, 1], "top_k")).collect()}
    assert top == {0: [2, 1, 3, 2, None, 4, None, None], 4: [None] * 8}
    assert sampling.parse_hops("4-1") == [4, 1]
    for strategy in ("random", "edge_weight"):
        a = sampling.sample(g.adjacency, roots, [200], strategy, seed=3).collect()
        b = sampling.sample(g.adjacency.repartition(5), roots, [200], strategy, seed=3).collect()
        assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)
        share = Counter(r["nbr"] for r in a if r["root"] == 0)
        expected = {1: 1 / 3, 2: 1 / 3, 3: 1 / 3} if strategy == "random" else {1: 3 / 7, 2: 3 / 7, 3: 1 / 7}
        assert all(abs(share[k] / 200 - p) < 0.13 for k, p in expected.items())
    with pytest.raises(ValueError):
        sampling.sample(g.adjacency, roots, [1], "other")


def test_comparisons(spark):
    a = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 7.0)], "id long, value double")
    b = spark.createDataFrame([(1, 9.0), (2, 9.0), (3, 1.0)], "id long, value double")
    near = a.withColumn("value", F.col("value") * 1.00001)
    assert compare.isomorphic(a, b) and not compare.exact(a, b) and compare.exact(a, a)
    assert compare.within(a, near) and not compare.within(a, b) and not compare.within(a, a.where("id < 3"))
    assert not compare.isomorphic(a, a.withColumn("value", F.lit(1.0)))


def test_sampling_queries_answer_every_vertex(spark):
    from graphloom import projections, queries

    d = "/root/testdata/sf0.001"
    every = {x["id"] for x in projections.vertices(spark, d).collect()}
    for name in ("sample_random_dense", "sample_edge_weight_dense"):
        assert {x["root"] for x in queries.QUERIES[name](spark, d).select("root").distinct().collect()} == every
