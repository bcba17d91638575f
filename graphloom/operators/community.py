"""Communities by synchronous label propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType

from ..graph import Graph
from ..plans.lineage import cut
from ..plans.rounds import Dealt, Rounds


def _best(kind: DataType, low: int | None, high: int | None, adjacency: Dealt) -> tuple[Column, Column]:
    """An aggregate for the most frequent and then smallest label, and the label in it.

    Where a count and a label fit into one long together, the aggregate is its maximum,
    which takes no sort.
    """
    if isinstance(kind, LongType) and low is not None:
        width = high - low + 1
        if (adjacency.rows.count() + 1) * width < 1 << 62:
            return F.max(F.col("n") * width + (F.lit(high) - F.col("label"))), F.lit(high) - F.col("best") % width
    return F.min(F.struct((-F.col("n")).alias("n"), "label")), F.col("best.label")


def cdlp(g: Graph, rounds: int = 10) -> DataFrame:
    """(id, label): each of exactly ``rounds`` rounds takes the most frequent label of the neighbours.

    Neighbours count with multiplicity and, in a directed graph too, from both
    ends of an edge; ties go to the smallest label, and vertices without
    neighbours keep their own id.  What a vertex hears is dealt by the vertex at once;
    with hubs it is dealt by label first, so no task hears all of a hub's neighbours.
    """
    adjacency = Dealt(g.symmetrised().select("src", "dst"), "dst", "src")
    kept = Rounds()
    start = g.vertices.select("id", F.col("id").alias("label"))
    state, met = kept.keep(start, low=F.min("id"), high=F.max("id"))
    best, picked = _best(start.schema["id"].dataType, met["low"], met["high"], adjacency)
    for _ in range(rounds):
        heard = adjacency.dealt(adjacency.meet(state).select("src", "label"), "src").groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
        top = heard.groupBy("src").agg(best.alias("best")).select("src", picked.alias("next")).hint("shuffle_hash")
        state, _ = kept.keep(state.join(top, F.col("id") == F.col("src"), "left").select("id", F.coalesce("next", "label").alias("label")))
    state = cut(state)
    adjacency.release()
    kept.release()
    return state
