"""PageRank with the sink rules that differ between engines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.lineage import cut, cut_observed
from ..plans.rounds import Dealt, Rounds

SINKS = ("ldbc", "drop", "push")


def pagerank(g: Graph, damping: float = 0.85, rounds: int = 10, sinks: str = "ldbc", normalized: bool = True, divide: str = "always") -> DataFrame:
    """(id, rank) after exactly ``rounds`` rounds.

    ``sinks`` tells what happens to the mass of vertices without out-edges:
    ``ldbc`` spreads their true rank over all vertices; ``drop`` discards what they
    receive and spreads their base rank; ``push`` lets them keep what they receive
    but spreads their base rank.  On undirected graphs the three agree, except for
    isolated vertices under ``drop`` and ``push``.

    Not ``normalized``: ranks begin at 1, the base is 1 - damping, and the mass of
    sinks is lost.  ``divide='first'`` divides by the degree in the first round
    only, a variant that some engines compute under that name.
    """
    if sinks not in SINKS:
        raise ValueError(f"sinks is one of {SINKS}")
    edges, kept = Dealt(g.adjacency.select("src", "dst"), dealt=g.dealt is not None), Rounds()
    degree = edges.rows.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    state = g.vertices.select("id").join(degree, F.col("id") == F.col("src"), "left").select("id", F.coalesce("deg", F.lit(0)).alias("deg"))
    on_sinks = {"sinks": F.count(F.when(F.col("deg") == 0, 1)), "held": F.sum(F.when(F.col("deg") == 0, F.col("rank"))), "n": F.count(F.lit(1))}
    state, met = cut_observed(state.withColumn("rank", F.lit(1.0)), **on_sinks)
    n = met["n"]
    if not n:
        edges.release()
        return g.vertices.select("id", F.lit(0.0).alias("rank"))
    start, base = (1.0 / n, (1 - damping) / n) if normalized else (1.0, 1 - damping)
    state = state.withColumn("rank", F.lit(start))
    n_sinks = met["sinks"] if normalized else 0
    held = n_sinks * start  # mass on the sinks
    for step in range(rounds):
        if n_sinks and sinks == "ldbc" and step:
            held = met["held"]
        own = base + damping * held / n
        held = own * n_sinks
        given = F.col("rank") / F.col("deg") if divide == "always" or step == 0 else F.col("rank")
        sent = state.where("deg > 0").select("id", given.alias("given"))
        into = edges.meet(sent).groupBy("dst").agg(F.sum("given").alias("got")).hint("shuffle_hash")
        received = F.lit(damping) * F.coalesce("got", F.lit(0.0))
        if normalized and sinks == "drop":
            received = F.when(F.col("deg") > 0, received).otherwise(0.0)
        state, met = kept.keep(state.join(into, F.col("id") == F.col("dst"), "left").select("id", "deg", (F.lit(own) + received).alias("rank")), **on_sinks)
    state = cut(state.select("id", "rank"))
    edges.release()
    kept.release()
    return state
