"""Multi-hop neighbour sampling for graph learning.

A hop ranks the neighbours of the vertices that the frontier holds and no hop
before it has ranked, and of no others, by (weight, id).  A draw is a rank, so it
meets its neighbour in a join on (vertex, rank): the draws from a hub are spread over
all of its neighbours.  Where the heaviest are asked for, these are all that is kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import cut

STRATEGIES = ("random", "edge_weight", "top_k")


def parse_hops(text: str) -> list[int]:
    """``"4-3-2"``: draws of each hop."""
    counts = [int(x) for x in text.split("-")]
    if not counts or min(counts) < 1:
        raise ValueError("draws are positive numbers joined by hyphens")
    return counts


def _once(adjacency: DataFrame, order: str | None) -> DataFrame:
    """Distinct edges; of parallel ones the smallest weight counts, or with ``order`` that of the row with the largest value of it."""
    weight = F.min("weight") if order is None else F.max(F.struct(order, "weight"))["weight"]
    return adjacency.groupBy("src", "dst").agg(weight.alias("weight"))


def heaviest(adjacency: DataFrame, n: int, order: str | None = None) -> DataFrame:
    """(src, nbrs): the ``n`` heaviest distinct neighbours, the first of them the heaviest (ties: the larger id).

    Each task leaves no more than ``n`` of a vertex before they meet, so no hub is gathered.
    """
    own = Window.partitionBy("src").orderBy(F.desc("weight"), F.desc("dst"))
    first = _once(adjacency, order).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= n)
    ranked = F.array_sort(F.collect_list(F.struct("rank", "dst")))
    return first.groupBy("src").agg(F.transform(ranked, lambda x: x["dst"]).alias("nbrs"))


def weight_index(adjacency: DataFrame, order: str | None = None) -> DataFrame:
    """(src, rank, nbr, low, high, n, total): distinct neighbours by (weight, id), with running sums of weights.

    The neighbours are dealt by range of (src, weight, id), ranked in their range and
    shifted by what the ranges before hold of the same vertex, so a hub is split.
    """
    dealt = cut(_once(adjacency, order).repartitionByRange("src", "weight", "dst").withColumn("p", F.spark_partition_id()))
    own = Window.partitionBy("src", "p").orderBy("weight", "dst")
    upto = F.sum("weight").over(own.rowsBetween(Window.unboundedPreceding, 0))
    ranked = dealt.select("src", "p", F.col("dst").alias("nbr"), F.row_number().over(own).alias("r"), upto.alias("upto")).withColumn("under", F.coalesce(F.lag("upto").over(Window.partitionBy("src", "p").orderBy("r")), F.lit(0.0)))
    ranges = dealt.groupBy("src", "p").agg(F.count(F.lit(1)).alias("k"), F.sum("weight").alias("w"))
    every = Window.partitionBy("src")
    before = every.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranges.select(F.col("src").alias("of"), F.col("p").alias("q"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k0"), F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w0"), F.sum("k").over(every).alias("n"), F.sum("w").over(every).alias("total"))
    placed = ranked.join(parts, (F.col("src") == F.col("of")) & (F.col("p") == F.col("q")))
    return placed.select("src", (F.col("r") + F.col("k0")).alias("rank"), "nbr", (F.col("under") + F.col("w0")).alias("low"), (F.col("upto") + F.col("w0")).alias("high"), "n", "total")


def _bucket(x: F.Column, size: str, total: str) -> F.Column:
    """Of ``size`` equal parts of the weights' sum, the one of ``x``."""
    return F.when(F.col(total) > 0, F.greatest(F.lit(0), F.least(F.floor(x / F.col(total) * F.col(size)), F.col(size) - 1))).otherwise(F.lit(0))


def _unit(seed: int, *columns: str) -> F.Column:
    """A number in [0, 1) that depends on the seed and the columns only."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _draws(frontier: DataFrame, index: DataFrame, n: int, strategy: str, seed: int, offset: int) -> DataFrame:
    """(root, place, nbr): ``n`` draws for each row of the frontier."""
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = (F.col("parent") * n + F.col("i")).alias("place")
    if strategy == "top_k":  # an index of fewer than n neighbours holds all of a vertex
        met = frontier.join(index, F.col("at") == F.col("src"), "left").select("root", "parent", "nbrs", every.alias("i"))
        return met.select("root", place, F.get("nbrs", F.col("i") % F.size("nbrs")).alias("nbr"))
    draws = frontier.select("root", "at", "parent", every.alias("i")).select("root", "at", place)
    sizes = index.where("rank = 1").select(F.col("src").alias("v"), F.col("n").alias("size"), F.col("total").alias("sum"))
    sized = draws.join(sizes, F.col("at") == F.col("v"), "left").withColumn("u", _unit(seed, "root", "place", F.lit(offset)))
    if strategy == "edge_weight":
        x = F.col("u") * F.col("sum")
        drawn = sized.withColumn("x", x).withColumn("b", _bucket(F.col("x"), "size", "sum"))
        last = F.col("rank") == F.col("n")
        until = F.when(last, F.col("n") - 1).otherwise(_bucket(F.col("high"), "n", "total"))
        index = index.withColumn("part", F.explode(F.sequence(_bucket(F.col("low"), "n", "total"), F.greatest(until, _bucket(F.col("low"), "n", "total")))))
        met = (F.col("at") == F.col("src")) & (F.col("b") == F.col("part")) & (F.col("x") >= F.col("low")) & ((F.col("x") < F.col("high")) | last)
    else:
        drawn = sized.withColumn("r", F.floor(F.col("u") * F.col("size")) + 1)
        met = (F.col("at") == F.col("src")) & (F.col("r") == F.col("rank"))
    return drawn.join(index, met, "left").select("root", "place", "nbr")


def sample(adjacency: DataFrame | Callable[[DataFrame], DataFrame], roots: DataFrame | None, hops: list[int], strategy: str = "random", seed: int = 0, order: str | None = None) -> DataFrame:
    """(root, slot, nbr): every slot of every root; null where there was no neighbour to draw.

    The slots of hop h follow those of hop h-1, and the draws of one parent are
    next to each other.  ``random`` draws distinct neighbours evenly and with
    replacement, ``edge_weight`` in proportion to the weights, ``top_k`` takes the
    heaviest first (ties: the larger id) and begins anew when they run out.  Draws
    depend on the seed, root and slot, not on partitions.  Without ``roots`` every
    end of an edge is one.  A draw by weight meets the neighbours that share its
    part of the vertex's weights, and as many parts as neighbours are made.
    ``adjacency`` may be a function that gives the edges of the vertices (at) of a hop;
    it needs roots.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"the strategy is one of {STRATEGIES}")
    if roots is None:
        roots = adjacency.select(F.col("src").alias("id")).unionAll(adjacency.select(F.col("dst").alias("id")))
    frontier = cut(roots.select(F.col("id").alias("root"), F.col("id").alias("at"), F.lit(0).alias("parent")).where("root is not null").distinct())
    out, offset = [], 0
    index = asked = None
    for hop, n in enumerate(hops):
        wanted = frontier.select("at").where("at is not null").distinct()
        new = wanted if asked is None else cut(wanted.join(asked, "at", "left_anti"))
        if asked is None or not new.isEmpty():
            own = adjacency.join(new, adjacency["src"] == new["at"], "left_semi") if isinstance(adjacency, DataFrame) else adjacency(new)
            more = cut(heaviest(own, max(hops), order) if strategy == "top_k" else weight_index(own, order))
            index = more if index is None else index.unionAll(more)
            asked = new if asked is None else asked.unionAll(new)
        found = _draws(frontier, index, n, strategy, seed, offset)
        found = cut(found) if hop + 1 < len(hops) else found
        out.append(found.select("root", (F.col("place") + offset).alias("slot"), "nbr"))
        offset += reduce(lambda a, b: a * b, hops[: len(out)])
        frontier = found.select("root", F.col("nbr").alias("at"), F.col("place").alias("parent"))
    return reduce(DataFrame.unionAll, out)


def rows(samples: DataFrame) -> DataFrame:
    """(root, nbrs): one row for each root, an array in slot order; its length is fixed by the hops."""
    by = samples.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("slot", "nbr"))).alias("s"))
    return by.select("root", F.transform("s", lambda x: x["nbr"]).alias("nbrs"))


def lines(samples: DataFrame) -> DataFrame:
    """(value): ``root nbr nbr ...``, an empty slot as a hyphen."""
    shown = F.transform("nbrs", lambda x: F.coalesce(x.cast("string"), F.lit("-")))
    return rows(samples).select(F.concat_ws(" ", F.col("root").cast("string"), F.array_join(shown, " ")).alias("value"))
