"""Searches over long paths and both directions."""

import random
import time
from collections import deque

import pytest
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import traversal
from graphloom.plans.rounds import Levels

FAR = traversal.UNREACHED


def path(spark, n, directed):
    edges = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return Graph(spark.range(n + 1), edges, directed)


@pytest.mark.parametrize("directed", [True, False])
def test_time_follows_the_levels(spark, directed):
    """Sixty levels take no more than in proportion what twenty do, with room for noise."""
    seconds = {}
    for n in (20, 60):
        start = time.time()
        found = {r["id"]: r["depth"] for r in traversal.bfs(path(spark, n, directed), 0).collect()}
        seconds[n] = time.time() - start
        assert found == {i: i for i in range(n)} | {n: FAR}
    assert seconds[60] < 3 * seconds[20] + 10, seconds


def test_betweenness_of_a_path(spark):
    rows = {r["id"]: (r["delta"], r["sigma"], r["depth"]) for r in traversal.betweenness(path(spark, 20, False), 0).collect()}
    assert rows == {i: (19.0 - i, 1.0, i) for i in range(20)} | {20: (0.0, 0.0, FAR)}


@pytest.mark.parametrize("directed", [True, False])
def test_both_directions(spark, directed):
    """A frontier larger than what is left pulls; the depths are the same with either direction alone."""
    r = random.Random(4)
    ids = range(200)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(700)] + [(198, 199), (0, 3)]
    g = Graph(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "src long, dst long"), directed)
    adj = {i: [] for i in ids}
    for a, b in edges:
        adj[a].append(b)
        if not directed:
            adj[b].append(a)
    want, queue = {0: 0}, deque([0])
    while queue:
        x = queue.popleft()
        for y in adj[x]:
            if y not in want:
                want[y] = want[x] + 1
                queue.append(y)
    for pull, taken in ((1.0, {"push", "pull"}), (1e9, {"push"}), (0.0, {"pull"}), (0.2, {"push", "pull"})):
        search = traversal.Search(g, 0, pull=pull)
        found = {x["id"]: x["depth"] for x in search.run().all(name="depth").collect()}
        assert found == want and set(search.directions) == taken, pull
        search.release()


def test_levels_stay_readable(spark):
    levels = Levels(together=3)
    for k in range(8):
        assert levels.keep(spark.range(k)) == k
    assert [levels.level(k).count() for k in range(8)] == list(range(8)) and levels.level(-2).count() == 6 and levels.since(6).count() == 13
    for _ in range(4):
        levels.keep(spark.range(1))
    assert len(levels.tiers) == 3 and levels.all("k").where("k = 5").count() == 5 and levels.all().count() == sum(range(8)) + 4
