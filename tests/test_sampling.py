"""Draws against plain Python, and what a hop reads."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import sampling
from graphloom.operators.neighbour_index import NeighbourIndex

EDGES = "src long, dst long, weight double"


def plain_top(edges, roots, hops):
    """The slots of each root: its heaviest neighbours first, again from the first when they run out."""
    least = {}
    for s, d, w in edges:
        least[s, d] = min(w, least.get((s, d), w))
    of = {}
    for (s, d), w in least.items():
        of.setdefault(s, []).append((w, d))
    out = {}
    for r in roots:
        level, slots = [r], []
        for n in hops:
            level = [sorted(of[v], reverse=True)[i % len(of[v])][1] if v in of else None for v in level for i in range(n)]
            slots += level
        out[r] = slots
    return out


def test_heaviest_against_plain_python(spark):
    """Parallel edges, ties, a hub, sinks, fewer neighbours than draws, and later hops with more draws than the first."""
    r = random.Random(4)
    edges = [(r.randrange(40), r.randrange(60), float(r.randrange(6))) for _ in range(300)] + [(7, d, float(d % 5)) for d in range(500)]
    frame = spark.createDataFrame(edges, EDGES).repartition(5)
    for hops, ids in (([4, 3], range(60)), ([2, 5, 3], [0, 7, 55, 1000])):
        want = plain_top(edges, ids, hops)
        roots = spark.createDataFrame([(i,) for i in ids], "id long")
        found = {x["root"]: x["nbrs"] for x in sampling.rows(sampling.sample(frame, roots, hops, "top_k")).collect()}
        assert found == want


@pytest.mark.parametrize("strategy", sampling.STRATEGIES)
def test_each_vertex_is_asked_for_once(spark, strategy):
    """A hop reads the edges of no vertex that a hop before it has read, and the draws are those of one index of all."""
    r = random.Random(5)
    edges = spark.createDataFrame([(r.randrange(30), r.randrange(30), float(r.randrange(1, 9))) for _ in range(150)], EDGES)
    asked = []

    def own(wanted):
        asked.append([x["at"] for x in wanted.collect()])
        return edges.join(wanted, edges["src"] == wanted["at"], "left_semi")

    roots = spark.range(0, 30, 6)
    found = sorted(map(tuple, sampling.sample(own, roots, [3, 2, 2], strategy, seed=3).collect()), key=str)
    every = [v for ids in asked for v in ids]
    assert len(every) == len(set(every)) and len(asked) > 1
    assert found == sorted(map(tuple, sampling.sample(edges, roots, [3, 2, 2], strategy, seed=3).collect()), key=str)
    asked.clear()
    sampling.sample(own, spark.range(30), [3, 2], strategy, seed=3).collect()
    assert len(asked) == 1


def test_a_hub_leaves_what_is_drawn(spark):
    """No task passes on more of a vertex than is drawn."""
    edges = spark.range(10_000).selectExpr("id % 2 as src", "id as dst", "cast(id % 7 as double) as weight")
    top = sampling.heaviest(edges, 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert {x["src"]: x["nbrs"] for x in top.collect()} == {0: [9_988, 9_974, 9_960], 1: [9_995, 9_981, 9_967]}


def test_a_batch_is_shuffled_once(spark, tmp_path):
    """Edges and their ends go to their buckets in one exchange."""
    index = NeighbourIndex(spark, str(tmp_path / "i"), buckets=2)
    edges = spark.createDataFrame([(1, d, 1.0) for d in range(2, 400)], EDGES)
    dealt = index._dealt(edges, F.struct(F.max("weight").alias("weight"), F.lit(0).alias("batch")))
    assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert dealt.select("bucket").distinct().count() == 1
    index.append(edges, 0)
    rows = spark.read.parquet(f"{tmp_path}/i/rows/part=b0")
    assert rows.where("dst is not null").count() == 398 and rows.where("dst is null").count() == 398
    assert {x["at"] for x in index.known(spark.range(500).withColumnRenamed("id", "at")).collect()} == set(range(1, 400))
