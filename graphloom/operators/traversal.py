"""Breadth-first search, shortest paths and betweenness from one source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.lineage import cut
from ..plans.rounds import Dealt, Levels, Rounds

UNREACHED = 9223372036854775807
#: Vertices of a frontier that are broadcast, 8 bytes each for numbers; more are joined by a shuffle.
FRONTIER_SENT = 2_000_000
#: The frontier pulls from the unvisited vertices, rather than pushing, if it is larger than so many times their number.
PULL = 1.0
#: Levels that are put into the table of what has been met at a time.
MERGED = 8
#: Waiting vertices from which on shortest paths are split into near and far ones.
SPLIT = 1_000_000
#: Of the mean weight over the mean degree, the width of what is near.
NEAR = 8


class Search:
    """A search by levels from one source.

    A level is found in one of two directions, by the numbers of vertices counted so
    far: ``push`` follows the edges of the frontier and takes out what has been met,
    ``pull`` goes through the edges into the unvisited vertices, where fewer are left,
    and keeps those that the frontier has.  The unvisited vertices are one table dealt
    by id, made when the direction first turns.

    What has been met is one table dealt by id, to which the levels are added in groups;
    a round meets that table where it lies, and the few levels since.  Where every edge goes both ways, a neighbour of a level is in it, in the one
    before or in the next, so only two levels are taken out and there is no such table.
    """

    def __init__(self, g: Graph, source, adjacency: Dealt | None = None, symmetric: bool | None = None, pull: float | None = None):
        self.g, self.pull = g, PULL if pull is None else pull
        self.symmetric = not g.directed if symmetric is None else symmetric
        self.adjacency = g.prepared() if adjacency is None else adjacency
        self.into: Dealt | None = self.adjacency if self.symmetric else None
        self.levels = Levels()
        self.met: DataFrame | None = None
        self.merged = 0
        self.unvisited: DataFrame | None = None
        self.left = g.vertices.count() - self.levels.keep(g.vertices.where(F.col("id") == F.lit(source)).select("id").distinct())
        self.directions: list[str] = []

    def run(self) -> Levels:
        """All levels; the last one is empty."""
        while self.levels.counts[-1] and self.left > 0:
            pulls = self.levels.counts[-1] > self.pull * self.left
            self.directions.append("pull" if pulls else "push")
            self.left -= self.levels.keep(self._pulled() if pulls else self._pushed())
        return self.levels

    def _pushed(self) -> DataFrame:
        reached = self.adjacency.meet(self.levels.level(-1)).select(F.col("dst").alias("id")).distinct()
        if self.unvisited is not None:
            return self._unvisited().join(reached, "id", "left_semi")
        if self.symmetric:
            seen = self.levels.level(-1) if len(self.levels) == 1 else self.levels.level(-1).unionAll(self.levels.level(-2))
            return reached.join(seen, "id", "left_anti")
        if len(self.levels) - self.merged > MERGED:
            new = self.levels.since(self.merged)
            met = cut(new if self.met is None else self.met.unionAll(new)).repartition("id").persist()
            met.count()
            if self.met is not None:
                self.met.unpersist()
            self.met, self.merged = met, len(self.levels)
        if self.met is not None:
            reached = reached.join(self.met, "id", "left_anti")
        return reached if self.merged == len(self.levels) else reached.join(self.levels.since(self.merged), "id", "left_anti")

    def _pulled(self) -> DataFrame:
        if self.into is None:
            self.into = Dealt(self.g.adjacency.select("src", "dst"), "dst", "src")
        near, far = ("src", "dst") if self.into.end == "src" else ("dst", "src")
        frontier = self.levels.level(-1).select(F.col("id").alias("__from"))
        frontier = F.broadcast(frontier) if self.levels.counts[-1] <= FRONTIER_SENT else frontier
        return self.into.meet(self._unvisited()).join(frontier, F.col(far) == F.col("__from"), "left_semi").select(F.col(near).alias("id")).distinct()

    def _unvisited(self) -> DataFrame:
        """The vertices of no level; of the table made before, what the levels since have not taken."""
        made = self.unvisited
        if made is None:
            left = self.g.vertices.select("id").join(self.levels.all().select("id"), "id", "left_anti")
        else:
            if self.made_at == len(self.levels):
                return made
            left = made.join(self.levels.since(self.made_at), "id", "left_anti")
        self.unvisited, self.made_at = cut(left).repartition("id").persist(), len(self.levels)
        self.unvisited.count()
        if made is not None:
            made.unpersist()
        return self.unvisited

    def release(self) -> None:
        for df in (self.met, self.unvisited):
            if df is not None:
                df.unpersist()
        self.adjacency.release()
        if self.into is not None and self.into is not self.adjacency:
            self.into.release()


def bfs(g: Graph, source) -> DataFrame:
    """(id, depth): hops along the edges; UNREACHED where there is no path or no such source."""
    search = Search(g, source)
    found = cut(search.run().all(name="depth").select("id", F.col("depth").cast("long").alias("depth")))
    search.release()
    return g.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("depth", F.lit(UNREACHED)).alias("depth"))


def sssp(g: Graph, source, weight: str = "weight", split: int = SPLIT, width: float | None = None, relaxed: list[int] | None = None) -> DataFrame:
    """(id, dist): the least sum of weights from the source; infinity where there is no path.

    Weights must not be negative.  Vertices whose distance has fallen wait, and each
    round relaxes the edges of those that wait.  If they are more than ``split``, only
    the near ones are relaxed: those within ``width`` of the nearest, by default NEAR
    times the mean weight over the mean degree.  What is far may fall again before its
    edges are followed, so fewer edges go through the shuffle, in more rounds.
    ``relaxed`` gathers how many vertices each round relaxed.
    """
    adjacency, rounds = g.prepared(weight), Rounds()
    waits = F.col("waits")
    limit = float("inf")
    metrics = lambda: {"n": F.count(F.when(waits, 1)), "near": F.count(F.when(waits & (F.col("dist") < limit), 1)), "least": F.min(F.when(waits, F.col("dist")))}
    state, met = rounds.keep(g.vertices.where(F.col("id") == F.lit(source)).select("id", F.lit(0.0).alias("dist"), F.lit(True).alias("waits")).distinct(), **metrics())
    while met["n"]:
        if met["n"] <= split:
            limit = float("inf")
        elif limit == float("inf") or not met["near"]:
            if width is None:
                mean = adjacency.rows.agg(F.avg(weight).alias("w"), F.count(F.lit(1)).alias("n"), F.approx_count_distinct("src").alias("v")).first()
                width = NEAR * mean["w"] * max(1, mean["v"]) / max(1, mean["n"])
            limit = met["least"] + width
            if limit <= met["least"]:  # weights of zero, or a width that is lost in the distance
                limit = float("inf")
        now = waits & (F.col("dist") < limit) if limit < float("inf") else waits
        if relaxed is not None:
            relaxed.append(state.where(now).count())
        offers = adjacency.meet(state.where(now).select("id", "dist")).groupBy(F.col("dst").alias("to")).agg(F.min(F.col("dist") + F.col(weight)).alias("offer"))
        fell = F.col("dist").isNull() | F.coalesce(F.col("offer") < F.col("dist"), F.lit(False))
        still = F.coalesce(waits & ~now, F.lit(False))
        state, met = rounds.keep(state.join(offers, F.col("id") == F.col("to"), "full").select(F.coalesce("id", "to").alias("id"), F.least("dist", "offer").alias("dist"), (fell | still).alias("waits")), **metrics())
    found = cut(state.select("id", "dist"))
    adjacency.release()
    rounds.release()
    return g.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("dist", F.lit(float("inf"))).alias("dist"))


def betweenness(g: Graph, source) -> DataFrame:
    """(id, delta, sigma, depth): dependency of the source on each vertex, number of shortest paths, hops.

    On the simple undirected graph.  The source has its own delta and sigma 1;
    unreached vertices have 0, 0 and UNREACHED.
    """
    pairs = g.simple_edges()
    adjacency = Dealt(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionAll(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"))))
    search = Search(g, source, adjacency, True)
    found, paths, scores = search.run(), Levels(), Levels()
    n = len([c for c in found.counts if c])
    for k in range(n):
        if k == 0:
            paths.keep(found.level(0).select("id", F.lit(1.0).alias("sigma")))
            continue
        into = adjacency.meet(paths.level(-1)).groupBy(F.col("dst").alias("to")).agg(F.sum("sigma").alias("sigma"))
        paths.keep(found.level(k).join(into, F.col("id") == F.col("to")).select("id", "sigma"))
    for k in range(n - 1, -1, -1):
        level = paths.level(k)
        if k == n - 1:
            scores.keep(level.withColumn("delta", F.lit(0.0)))
            continue
        share = scores.level(-1).select(F.col("id").alias("v"), ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
        up = adjacency.meet(share, "v").groupBy(F.col("dst").alias("to")).agg(F.sum("share").alias("share"))
        scores.keep(level.join(up, F.col("id") == F.col("to"), "left").select("id", "sigma", (F.col("sigma") * F.coalesce("share", F.lit(0.0))).alias("delta")))
    if not n:
        search.release()
        return g.vertices.select("id", F.lit(0.0).alias("delta"), F.lit(0.0).alias("sigma"), F.lit(UNREACHED).alias("depth"))
    done = cut(scores.all(name="back").select("id", "sigma", "delta", (n - 1 - F.col("back")).cast("long").alias("depth")))
    search.release()
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return g.vertices.select("id").join(done, "id", "left").select("id", zero("delta"), zero("sigma"), F.coalesce("depth", F.lit(UNREACHED)).alias("depth"))
