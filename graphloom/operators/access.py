"""Degrees, neighbours, counts and frontier sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, swapped


def out_degree(g: Graph) -> DataFrame:
    """(id, degree): adjacency entries of each vertex, 0 for one without."""
    found = g.adjacency.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    return g.vertices.select("id").join(found, F.col("id") == F.col("src"), "left").select("id", F.coalesce("n", F.lit(0)).alias("degree"))


def in_degree(g: Graph) -> DataFrame:
    return out_degree(Graph(g.vertices, swapped(g.adjacency), True))


def neighbours(g: Graph, frontier: DataFrame, direction: str = "out", where: Column | None = None) -> DataFrame:
    """(id, neighbour, ...) of the frontier's ids: out, in or both; ``where`` filters the edges."""
    own = g.adjacency if direction == "out" else swapped(g.adjacency) if direction == "in" else g.symmetrised()
    if where is not None:
        own = own.where(where)
    ids = frontier.select("id").distinct()
    return ids.join(own, ids["id"] == own["src"]).drop("src").withColumnRenamed("dst", "neighbour")


def has_edges(g: Graph, direction: str = "out") -> DataFrame:
    """(id) of the vertices with a child (out) or a parent (in)."""
    side = "src" if direction == "out" else "dst"
    return g.vertices.select("id").join(g.adjacency.select(F.col(side).alias("id")), "id", "left_semi")


def counts(g: Graph) -> DataFrame:
    """One row (vertices, edges): as stored, an undirected edge once."""
    return g.vertices.agg(F.count(F.lit(1)).alias("vertices")).join(g.edges.agg(F.count(F.lit(1)).alias("edges")), how="cross")  # one row each


def insert(frontier: DataFrame, ids: DataFrame) -> DataFrame:
    return frontier.select("id").unionAll(ids.select("id")).distinct()


def erase(frontier: DataFrame, ids: DataFrame) -> DataFrame:
    return frontier.join(ids.select("id"), "id", "left_anti")


def border(g: Graph, part: Column, other: Column) -> DataFrame:
    """(id) of the vertices with an edge into another part; ``part`` is over src and ``other`` over dst."""
    return g.adjacency.where(part != other).select(F.col("src").alias("id")).distinct()


def destinations(g: Graph, other: Column) -> DataFrame:
    """(id, parts): the sorted parts that a vertex's edges lead to; ``other`` is over dst."""
    return g.adjacency.select(F.col("src").alias("id"), other.alias("part")).distinct().groupBy("id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
