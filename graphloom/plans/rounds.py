"""What loops of rounds have in common: edges that stay, and states that follow one another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut, cut_observed

#: Edges of one source that a task may have; a source of more is a hub and is dealt to several.
HUB = 500_000
#: Hubs that are broadcast, 16 bytes each; more are joined by a shuffle.
HUBS_SENT = 500_000
#: Every so many rounds the state is written to the shared folder; more would nest the plans of kept states, whose text Spark prints.
EVERY = 2
#: Frames of a loop that are written as one table.
TOGETHER = 8


class Dealt:
    """Edges dealt by one end and kept by executors, for loops that join them in every round.

    The edges of a hub are dealt by a salt of the other end as well, and a state that
    meets them is copied once for each salt.  So no task gets more than about ``hub``
    edges of one vertex, and no join copies a state that isn't a hub's.  Edges that are
    stored ``dealt`` by that end stay where they are.  The state is what waits in memory
    for its edges, which are not sorted.
    """

    def __init__(self, edges: DataFrame, end: str = "src", other: str = "dst", hub: int | None = None, dealt: bool = False):
        hub = HUB if hub is None else hub
        self.end = end
        rows = (edges if dealt else edges.repartition(end)).persist()
        found = rows.groupBy(end).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hub)  # dealt by the end already: no shuffle
        found = found.select(F.col(end).alias("__hub"), F.ceil(F.col("n") / hub).cast("int").alias("__parts")).persist()
        self.hubs: DataFrame | None = None
        n = found.count()
        if n:
            hubs = cut(found)
            self.hubs = F.broadcast(hubs) if n <= HUBS_SENT else hubs
            salt = F.pmod(F.xxhash64(other), F.coalesce("__parts", F.lit(1))).cast("int")
            salted = rows.join(self.hubs, F.col(end) == F.col("__hub"), "left").withColumn("__salt", salt).drop("__hub", "__parts")
            self.rows = salted.repartition(end, "__salt").persist()
            self.rows.count()
            rows.unpersist()
        else:
            self.rows = rows
        found.unpersist()

    def meet(self, state: DataFrame, key: str = "id") -> DataFrame:
        """``state`` with the edges of its ``key``."""
        if self.hubs is None:
            return state.hint("shuffle_hash").join(self.rows, F.col(key) == F.col(self.end))
        copied = state.join(self.hubs, F.col(key) == F.col("__hub"), "left").withColumn("__copy", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
        return copied.hint("shuffle_hash").join(self.rows, (F.col(key) == F.col(self.end)) & (F.col("__copy") == F.col("__salt"))).drop("__hub", "__parts", "__copy", "__salt")

    def dealt(self, told: DataFrame, to: str) -> DataFrame:
        """What vertices are told, dealt by vertex ``to`` before it is grouped by that and more; with hubs it is left to the grouping, so no task gets all that one is told."""
        return told.repartition(to) if self.hubs is None else told

    def release(self) -> None:
        self.rows.unpersist()


class Rounds:
    """The states of a loop, each of which takes the place of the one before.

    Executors keep each state, and every EVERY-th is written to the shared folder,
    which ends its lineage: a lost executor costs so many rounds at most.  Kept states
    are let go then, so a loop that reads more than the last one needs ``Levels``.
    """

    def __init__(self, every: int | None = None):
        self.every = EVERY if every is None else every
        self.held: list[DataFrame] = []
        self.n = 0

    def keep(self, df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
        """``df``, computed once, and aggregates over its rows."""
        self.n += 1
        named = metrics or {"rows": F.count(F.lit(1))}
        if self.n % self.every == 0:
            out, met = cut_observed(df, **named)
            self.release()
            return out, met
        out = df.persist()
        met = out.agg(*[c.alias(name) for name, c in named.items()]).first().asDict()
        self.held.append(out)
        return out, met

    def release(self) -> None:
        """Let the kept states go; what is read again is computed from the last written one."""
        for df in self.held:
            df.unpersist()
        self.held = []


class Levels:
    """Frames of a loop that are all read again, such as the frontiers of a search.

    Each is written to the shared folder, so what is read again never reaches behind it.
    TOGETHER frames are also written as one table, and as many tables as a larger one,
    so that all of them are a union of few parts however many there are.
    """

    def __init__(self, together: int | None = None):
        self.together = TOGETHER if together is None else together
        self.frames: list[DataFrame] = []
        self.counts: list[int] = []
        self.tiers: list[list[DataFrame]] = [[]]

    def keep(self, df: DataFrame) -> int:
        """Adds ``df``, computed once, as the next frame; its number of rows."""
        out, met = cut_observed(df, n=F.count(F.lit(1)))
        self.frames.append(out)
        self.counts.append(met["n"])
        self.tiers[0].append(out.withColumn("__level", F.lit(len(self.frames) - 1)))
        for k in range(len(self.tiers)):
            if len(self.tiers[k]) == self.together:
                if k + 1 == len(self.tiers):
                    self.tiers.append([])
                self.tiers[k + 1].append(cut(reduce(DataFrame.unionByName, self.tiers[k])))
                self.tiers[k] = []
        return met["n"]

    def __len__(self) -> int:
        return len(self.frames)

    def level(self, k: int) -> DataFrame:
        """The ``k``-th frame, from the end if negative."""
        return self.frames[k]

    def since(self, k: int) -> DataFrame:
        """The frames from the ``k``-th on, of which there are few, as one."""
        return reduce(DataFrame.unionByName, self.frames[k:])

    def all(self, name: str = "level") -> DataFrame:
        """Every frame, with its number as ``name``."""
        return reduce(DataFrame.unionByName, [df for tier in self.tiers for df in tier]).withColumnRenamed("__level", name)
