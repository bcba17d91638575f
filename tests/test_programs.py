"""Vertex programs with totals, states of several fields and several kinds of messages."""

import pytest
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import programs, ranking
from graphloom.plans.superstep import Aborted, Message, VertexProgram


def graph(spark, n, edges, directed=True):
    return Graph(spark.range(n), spark.createDataFrame(edges, "src long, dst long"), directed)


def test_pagerank_as_a_program(spark):
    """Two sinks, an isolated vertex, parallel edges and a self-loop: the same ranks as the operator's."""
    g = graph(spark, 7, [(0, 1), (0, 1), (1, 2), (2, 2), (2, 3), (3, 4), (0, 5)])
    for rounds in (0, 1, 6):
        own = {r["id"]: r["rank"] for r in programs.fields(programs.pagerank(rounds=rounds).run(programs.with_degree(g))).collect()}
        want = {r["id"]: r["rank"] for r in ranking.pagerank(g, rounds=rounds).collect()}
        assert {i: 1 / 7 if x is None else x for i, x in own.items()} == pytest.approx(want)
    empty = Graph(spark.range(0), g.edges.limit(0), True)
    assert programs.pagerank().run(programs.with_degree(empty)).count() == 0


def test_hubs_and_authorities(spark):
    g = graph(spark, 4, [(0, 2), (1, 2), (1, 3)])
    found = {r["id"]: (r["hub"], r["authority"]) for r in programs.fields(programs.hits(2).run(g)).collect()}
    hub, authority = dict.fromkeys(range(4), 1.0), dict.fromkeys(range(4), 1.0)
    for _ in range(2):
        h, a = (sum(x * x for x in d.values()) ** 0.5 for d in (hub, authority))
        hub, authority = {0: authority[2] / a, 1: (authority[2] + authority[3]) / a, 2: 0.0, 3: 0.0}, {0: 0.0, 1: 0.0, 2: (hub[0] + hub[1]) / h, 3: hub[1] / h}
    assert {i: v[0] for i, v in found.items()} == pytest.approx(hub) and {i: v[1] for i, v in found.items()} == pytest.approx(authority)


def test_tree(spark):
    g = graph(spark, 6, [(0, 2), (0, 1), (2, 3), (1, 3), (3, 4)])
    found = {r["id"]: (r["depth"], r["parent"]) for r in programs.fields(programs.tree(0).run(g)).collect()}
    assert found == {0: (0, 0), 1: (1, 0), 2: (1, 0), 3: (2, 1), 4: (3, 3), 5: (None, None)}


def test_kinds_with_conditions(spark):
    """A vertex hears the weights of light and of heavy edges apart, from either end."""
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 5.0), (2, 0, 7.0), (2, 0, 2.0)], "src long, dst long, weight double")
    program = VertexProgram(
        init=F.struct(F.lit(0.0).alias("light"), F.lit(0).cast("long").alias("heavy")),
        messages={"a": Message(F.col("weight"), F.sum, "both", F.col("weight") < 4), "b": Message(F.col("id"), F.count, "both", F.col("weight") > 4)},
        update=F.struct(F.coalesce("a", F.lit(0.0)).alias("light"), F.coalesce("b", F.lit(0)).alias("heavy")),
        rounds=1,
    )
    found = {r["id"]: (r["light"], r["heavy"]) for r in programs.fields(program.run(Graph(spark.range(4), edges, True))).collect()}
    assert found == {0: (3.0, 1), 1: (1.0, 1), 2: (2.0, 2), 3: (0.0, 0)}


def halving(**how):
    return VertexProgram(init=F.col("id").cast("double"), message=F.col("value"), combine=F.max, update=F.col("value") / 2, always=True, totals={"most": F.max("value"), "moved": F.sum(F.abs(F.col("value") - F.col("before")))}, rounds=50, **how)


def test_stop_and_abort(spark):
    g = graph(spark, 5, [(0, 1)])
    told = []
    done = halving(stop=lambda step, totals: told.append((step, totals)) or totals["moved"] < 1).run(g)
    assert {r["id"]: r["value"] for r in done.collect()} == {i: i / 16 for i in range(5)}
    assert told == [(0, {"most": 2.0, "moved": 5.0}), (1, {"most": 1.0, "moved": 2.5}), (2, {"most": 0.5, "moved": 1.25}), (3, {"most": 0.25, "moved": 0.625})]
    with pytest.raises(Aborted, match="round 1: 1.0 is too little") as e:
        halving(abort=lambda step, totals: f"{totals['most']} is too little" if totals["most"] < 2 else None).run(g)
    assert e.value.step == 1 and e.value.totals["moved"] == 2.5
    with pytest.raises(ValueError, match="kind"):
        VertexProgram(init=F.lit(1), messages={"value": Message(F.lit(1), F.sum)}, update=F.col("value")).run(g)
