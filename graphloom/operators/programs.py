"""Algorithms written as vertex programs, by what they need of them: totals, states of several fields, several kinds of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.superstep import Message, VertexProgram
from .access import out_degree


def with_degree(g: Graph) -> Graph:
    """The graph with each vertex's number of out-edges as ``deg``."""
    degree = out_degree(g).select(F.col("id").alias("__of"), F.col("degree").alias("deg"))
    met = g.vertices.join(degree, F.col("id") == F.col("__of"), "left")
    return Graph(met.select(*g.vertices.columns, F.coalesce("deg", F.lit(0)).alias("deg")), g.edges, g.directed)


def pagerank(damping: float = 0.85, rounds: int = 10) -> VertexProgram:
    """PageRank over vertices with ``deg``; a state is its rank and degree, and the sinks' rank goes to all.

    The totals of a round are the number of vertices and what its sinks hold.
    """
    rank, deg, n = F.col("value.rank"), F.col("value.deg"), F.greatest("total_n", F.lit(1))
    state = lambda r, d: F.struct(r.cast("double").alias("rank"), d.cast("long").alias("deg"))
    first = lambda c: F.coalesce(c, 1.0 / n)  # noqa: E731  nobody knows the number of vertices before the first round
    held = F.coalesce(F.col("total_held"), F.when(F.col("total_fresh") > 0, F.col("total_sinks") / n), F.lit(0.0))
    return VertexProgram(
        init=state(F.lit(None), F.col("deg")),
        messages={"got": Message(first(rank) / deg, F.sum, when=deg > 0)},
        totals={
            "n": F.count(F.lit(1)), "sinks": F.count(F.when(deg == 0, 1)), "fresh": F.count(F.when(rank.isNull(), 1)),
            "held": F.sum(F.when(deg == 0, rank)),
        },
        update=state((1 - damping) / n + damping * held / n + damping * F.coalesce("got", F.lit(0.0)), deg),
        always=True,
        rounds=rounds,
    )


def hits(rounds: int = 10) -> VertexProgram:
    """Hubs and authorities: two fields, a kind of message for each way, and each round divided by the norms of the last."""
    hub, authority = F.col("value.hub"), F.col("value.authority")
    norm = lambda c: F.sqrt(F.sum(c * c))
    share = lambda c, n: F.when(F.col(n) > 0, c / F.col(n)).otherwise(F.lit(0.0))
    return VertexProgram(
        init=F.struct(F.lit(1.0).alias("hub"), F.lit(1.0).alias("authority")),
        messages={
            "pointed": Message(share(hub, "total_hubs"), F.sum, "out"),
            "points": Message(share(authority, "total_authorities"), F.sum, "in"),
        },
        totals={"hubs": norm(hub), "authorities": norm(authority)},
        update=F.struct(F.coalesce("points", F.lit(0.0)).alias("hub"), F.coalesce("pointed", F.lit(0.0)).alias("authority")),
        always=True,
        rounds=rounds,
    )


def tree(source) -> VertexProgram:
    """A breadth-first tree: a vertex's depth and, of its possible parents, the smallest; null where it isn't reached."""
    offered = F.struct((F.col("value.depth") + 1).alias("depth"), F.col("id").alias("parent"))
    return VertexProgram(
        init=F.when(F.col("id") == source, F.struct(F.lit(0).cast("long").alias("depth"), F.col("id").alias("parent"))),
        active=F.col("id") == source,
        message=offered,
        combine=F.min,
        update=F.coalesce("value", "heard"),
    )


def fields(result: DataFrame) -> DataFrame:
    """(id, ...): the result of a program with a column for each field."""
    return result.select("id", "value.*")
