"""Batched insert, update and delete of vertices and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, swapped


def apply_changes(g: Graph, edges: DataFrame | None = None, vertices: DataFrame | None = None, weight: str | None = "weight", data: str | None = None, order: str | None = None) -> Graph:
    """The graph after one batch.

    ``edges`` has op (a, d, u), src, dst and the weight; ``vertices`` has op, id
    and the datum.  The order is fixed: vertices and edges are deleted, edges are
    updated, vertices and edges are added, vertex data are set.

    Deleting or updating an edge concerns all of its parallel copies, in an
    undirected graph those of either direction.  Deleting a vertex takes its edges
    away and leaves it isolated.  Deletes and updates of what isn't there, and
    added edges with an unknown end, are ignored.  Of several updates of one edge
    or vertex the last by the column ``order`` holds; without one the order of the
    rows doesn't matter, and the largest value holds.
    """
    last = (lambda c: F.max(c)) if order is None else (lambda c: F.max_by(c, "__order"))
    placed = [] if order is None else [F.col(order).alias("__order")]
    ids, own = g.vertices, g.edges
    if vertices is not None:
        gone = vertices.where("op = 'd'").select("id").distinct()
        own = own.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select(own.columns)
    if edges is not None:
        both = lambda e: e if g.directed else e.unionByName(swapped(e))
        gone = both(edges.where("op = 'd'").select("src", "dst")).distinct()
        own = own.join(gone, ["src", "dst"], "left_anti").select(g.edges.columns)
        if weight is not None:
            new = both(edges.where("op = 'u'").select("src", "dst", F.col(weight).alias("__new"), *placed)).groupBy("src", "dst").agg(last("__new").alias("__new"))
            own = own.join(new, ["src", "dst"], "left").withColumn(weight, F.coalesce("__new", weight)).select(g.edges.columns)
    if vertices is not None:
        given = vertices.where("op in ('a', 'u')").select("*", *placed)
        if data is not None:
            latest = given.groupBy("id").agg(last(data).alias("__new"), F.max((F.col("op") == "a").cast("int")).alias("__added"))
            joined = ids.withColumn("__known", F.lit(1)).join(latest, "id", "full").where("__known = 1 or __added = 1")
            ids = joined.withColumn(data, F.coalesce("__new", data)).select(g.vertices.columns)
        else:
            added = given.where("op = 'a'").select("id").distinct().join(ids, "id", "left_anti")
            ids = ids.unionByName(added, allowMissingColumns=True)
    if edges is not None:
        added = edges.where("op = 'a'").select(*[c for c in g.edges.columns if c in edges.columns])
        known = ids.select("id")
        added = added.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
        own = own.unionByName(added.select(*[c for c in g.edges.columns if c in added.columns]), allowMissingColumns=True)
    return Graph(ids, own, g.directed)


def append_edges(g: Graph, edges: DataFrame) -> Graph:
    """The graph with more edges, whose ends become vertices."""
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).distinct()
    new = ends.join(g.vertices.select("id"), "id", "left_anti")
    return Graph(g.vertices.unionByName(new, allowMissingColumns=True), g.edges.unionByName(edges.select(g.edges.columns)), g.directed)
