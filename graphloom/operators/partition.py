"""Where vertices and edges would go under each partitioner, as diagnostic tables."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import Graph
from ..plans.lineage import cut


def by_hash(ids: DataFrame, parts: int) -> DataFrame:
    """(id, part): a hash of the id modulo ``parts``."""
    return ids.select("id", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))


def _running(ids: DataFrame, score: str) -> DataFrame:
    """``ids`` and upto: the sum of ``score`` over all ids up to each, in ascending order.

    Ids are dealt by range, summed in their range, and shifted by the sums of the
    ranges before, one number for each task: no task gets all ids.
    """
    spark = ids.sparkSession
    dealt = cut(ids.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").withColumn("__p", F.spark_partition_id()))
    before, total = [], 0
    for r in dealt.groupBy("__p").agg(F.sum(score).alias("n")).orderBy("__p").collect():
        before.append((r["__p"], total))
        total += r["n"]
    shift = spark.createDataFrame(before, "__p int, __before long")
    own = F.sum(score).over(Window.partitionBy("__p").orderBy("id"))
    return dealt.withColumn("__own", own).join(F.broadcast(shift), "__p").withColumn("upto", F.col("__own") + F.col("__before")).drop("__p", "__own", "__before")


def by_map(ids: DataFrame, parts: int) -> DataFrame:
    """(id, part): ascending ids in runs of ceil(V / parts)."""
    ranked = _running(ids.select("id").distinct().withColumn("one", F.lit(1)), "one")
    size = -(-(ranked.agg(F.max("upto")).first()[0] or 0) // parts) or 1
    return ranked.select("id", F.floor((F.col("upto") - 1) / size).cast("int").alias("part"))


def boundaries(ids: DataFrame, parts: int) -> list:
    """The first id of every part but the first, for ``by_segment``; ``parts`` values at most."""
    placed = by_map(ids, parts)
    rows = placed.groupBy("part").agg(F.min("id").alias("first")).orderBy("part").collect()
    return [r["first"] for r in rows][1:]


def by_segment(ids: DataFrame, bounds: list) -> DataFrame:
    """(id, part): the number of boundaries up to the id."""
    below = F.lit(0)
    for b in bounds:
        below = below + (F.col("id") >= F.lit(b)).cast("int")
    return ids.select("id", below.alias("part"))


def vertex_cut(edges: DataFrame, n: int, parts: int) -> DataFrame:
    """The edges and their block in a square grid: ``parts`` must be a square, and ids 0 .. n-1."""
    side = isqrt(parts)
    if side * side != parts:
        raise ValueError("the number of parts is a square")
    chunk = -(-n // side) or 1
    return edges.withColumn("block", (F.floor(F.col("src") / chunk) * side + F.floor(F.col("dst") / chunk)).cast("int"))


def rebalance(g: Graph, parts: int, vertex_factor: int = 1, inclusive: bool = False) -> DataFrame:
    """(id, part): ascending ids, a new part once the score of the last passes the mean (``inclusive``: reaches it).

    The score of a vertex is its stored edges (from either end in an undirected
    graph) plus ``vertex_factor``; the mean is rounded up.  Running scores are
    summed range by range, and each boundary is one aggregation over them.
    """
    ends = g.edges.select(F.col("src").alias("v")) if g.directed else g.edges.select(F.col("src").alias("v")).unionAll(g.edges.select(F.col("dst").alias("v")))
    degree = ends.groupBy("v").agg(F.count(F.lit(1)).alias("deg"))
    scored = g.vertices.select("id").join(degree, F.col("id") == F.col("v"), "left").select("id", (F.coalesce("deg", F.lit(0)) + vertex_factor).alias("score"))
    running = cut(_running(scored, "score"))
    total = running.agg(F.max("upto")).first()[0] or 0
    mean, start, part = -(-total // parts), 0, F.lit(0)
    for _ in range(parts - 1):
        past = F.col("upto") >= start + mean if inclusive else F.col("upto") > start + mean
        start = running.where(past).agg(F.min("upto")).first()[0]
        if start is None:
            break
        part = part + (F.col("upto") > start).cast("int")
    return running.select("id", part.alias("part"))


def sizes(placed: DataFrame) -> DataFrame:
    """(part, vertices)."""
    return placed.groupBy("part").agg(F.count(F.lit(1)).alias("vertices"))
