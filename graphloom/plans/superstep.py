"""User-defined vertex programs: each round is one join and one aggregation for each direction, and one update."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, swapped
from .lineage import cut
from .rounds import Dealt, Rounds


@dataclass
class Message:
    """One kind of message.

    value      what goes along an edge, a column over id, value, the edge's columns and the totals
    combine    aggregates it at the receiver, whose column has the kind's name
    direction  out, in or both
    when       which edges and senders it goes along; all without it
    """

    value: Column
    combine: Callable[[Column], Column]
    direction: str = "out"
    when: Column | None = None


class Aborted(RuntimeError):
    """A program that gave up: why, in which round, and the totals by then."""

    def __init__(self, why: str, step: int, totals: dict):
        super().__init__(f"round {step}: {why}")
        self.why, self.step, self.totals = why, step, totals


@dataclass
class VertexProgram:
    """What a vertex starts with, sends, hears and becomes.

    init      the first value, a column over the vertices; a struct for a state of several fields
    active    which vertices send in the first round, a column over (id, value)
    message   what goes along an edge, a column over value and the edge's columns
    combine   aggregates ``message`` at the receiver
    messages  several kinds of messages by name, in place of ``message`` and ``combine``
    update    the new value, a column over (id, value, heard) or, with ``messages``, over (id, value)
              and a column for each kind; null without messages of that kind
    totals    named aggregates over the states of a round, columns over (id, value, before), where
              before is the value of the round before, null at first.  In the next round every
              column above can read the total ``x`` as ``total_x``
    changed   whether a vertex sends in the next round, over (value, next)
    direction out, in or both
    rounds    at most so many; the program also ends when nobody sends
    always    every vertex sends in every round
    stop      ends the program by the totals after a round, stop(round, totals) -> bool
    abort     gives it up with a diagnostic, abort(round, totals) -> str or None; ``run`` raises ``Aborted``
    mutate    may give a changed graph after a round, mutate(graph, state, round) -> Graph or None:
              its new vertices start with ``init`` and send, those that it lacks go, and ``woken``
              of the graph's vertices send again.  The program goes on while the graph changes
    woken     which vertices send after a change besides those that would, a column over (id, value)
    """

    init: Column
    message: Column | None = None
    combine: Callable[[Column], Column] | None = None
    update: Column | None = None
    active: Column | None = None
    changed: Column | None = None
    direction: str = "out"
    rounds: int = 1_000_000
    always: bool = False
    mutate: Callable[[Graph, DataFrame, int], Graph | None] | None = None
    woken: Column | None = None
    messages: dict[str, Message] | None = None
    totals: dict[str, Column] = field(default_factory=dict)
    stop: Callable[[int, dict], bool] | None = None
    abort: Callable[[int, dict], str | None] | None = None

    def _kinds(self) -> dict[str, dict[str, Message]]:
        """The kinds of messages by direction."""
        kinds = self.messages or {"heard": Message(self.message, self.combine, self.direction)}
        if bad := {"id", "value", "before", "sends", "next"} & kinds.keys() or {d.direction for d in kinds.values()} - {"out", "in", "both"}:
            raise ValueError(f"no kind or direction of messages: {sorted(bad)}")
        return {d: {k: m for k, m in kinds.items() if m.direction == d} for d in ("out", "in", "both") if any(m.direction == d for m in kinds.values())}

    def _edges(self, g: Graph) -> dict[str, Dealt]:
        ways = {"out": lambda: g.adjacency, "in": lambda: swapped(g.adjacency), "both": g.symmetrised}
        return {d: Dealt(ways[d]()) for d in self._kinds()}

    def run(self, g: Graph) -> DataFrame:
        """(id, value) after the last round."""
        active = F.lit(True) if self.active is None else self.active
        senders_left, kept, kinds = F.count(F.when(F.col("sends"), 1)), Rounds(), self._kinds()
        carried = ["before"] if self.totals else []
        start = g.vertices.withColumn("value", self.init)
        start = start.withColumn("before", F.when(F.lit(False), F.col("value"))).select("id", "value", *carried, active.alias("sends"))
        types = start.agg(*[c.alias(k) for k, c in self.totals.items()]).schema if self.totals else []
        metrics = {"sends": senders_left} | {f"total_{k}": c for k, c in self.totals.items()}

        def seen(state: DataFrame) -> DataFrame:
            return state.withColumns({f"total_{t.name}": F.lit(met[f"total_{t.name}"]).cast(t.dataType) for t in types})

        def told() -> dict:
            return {k: met[f"total_{k}"] for k in self.totals}

        state, met = kept.keep(start, **metrics)
        edges = self._edges(g)
        try:
            for step in range(self.rounds):
                if not self.always and not met["sends"]:
                    break
                known = seen(state)
                senders = known.drop("before") if self.always else known.where("sends").drop("before")
                joined = known.drop("before")
                for d, own in kinds.items():
                    joined = joined.join(self._heard(edges[d], senders, own).hint("shuffle_hash"), F.col("id") == F.col("__to"), "left").drop("__to")
                joined = joined.withColumn("next", self.update)
                changed = ~F.col("next").eqNullSafe(F.col("value")) if self.changed is None else self.changed
                state, met = kept.keep(joined.select("id", F.col("next").alias("value"), *[F.col("value").alias(c) for c in carried], changed.alias("sends")), **metrics)
                if self.abort is not None and (why := self.abort(step, told())) is not None:
                    raise Aborted(why, step, told())
                if self.stop is not None and self.stop(step, told()):
                    break
                if self.mutate is not None and (new := self.mutate(g, state.select("id", "value"), step)) is not None:
                    g = new.fixed()
                    for d in edges.values():
                        d.release()
                    edges = self._edges(g)
                    woken = F.lit(False) if self.woken is None else self.woken
                    old = state.select("id", F.col("value").alias("__old"), *carried, "sends")
                    entered = g.vertices.withColumn("value", self.init).join(old, "id", "left").select("id", F.coalesce("__old", "value").alias("value"), *carried, "sends")
                    state, met = kept.keep(entered.select("id", "value", *carried, (F.coalesce("sends", F.lit(True)) | woken).alias("sends")), **metrics)
            return cut(state.select("id", "value"))
        finally:
            for d in edges.values():
                d.release()
            kept.release()

    def _heard(self, edges: Dealt, senders: DataFrame, kinds: dict[str, Message]) -> DataFrame:
        """(__to, a column for each kind): what goes one way, in one pass over the edges of the senders."""
        met = edges.meet(senders)
        if all(m.when is not None for m in kinds.values()):
            met = met.where(reduce(Column.__or__, [m.when for m in kinds.values()]))
        sent = met.select(F.col("dst").alias("__to"), *[(m.value if m.when is None else F.when(m.when, m.value)).alias(k) for k, m in kinds.items()])
        return sent.groupBy("__to").agg(*[m.combine(F.col(k)).alias(k) for k, m in kinds.items()])
