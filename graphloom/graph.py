"""A property graph as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plans.lineage import cut
from .plans.rounds import Dealt


def swapped(edges: DataFrame) -> DataFrame:
    """Every edge the other way round."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


@dataclass
class Graph:
    """Vertices (id, ...) and edges (src, dst, ...), a multigraph.

    Parallel edges and self-loops are kept.  In an undirected graph each edge is
    one row and stands for both directions; a self-loop then counts twice.
    """

    vertices: DataFrame
    edges: DataFrame
    directed: bool = False
    #: The adjacency dealt by ``src`` as it is stored, where there is one.
    dealt: DataFrame | None = None
    #: Whether the edges are distinct pairs with src < dst already.
    simple: bool = False

    @classmethod
    def of(cls, edges: DataFrame, vertices: DataFrame | None = None, directed: bool = False, unknown: str = "drop") -> Graph:
        """A graph whose edges have both ends among the vertices.

        Without ``vertices``, the vertices are the ends of the edges.  With them,
        edges with an unknown end are dropped, or with ``unknown='add'`` their ends
        become vertices.  Rows with a null id or end are dropped, and repeated
        vertices become one (the first by the order of their columns).
        """
        edges = edges.where("src is not null and dst is not null")
        ends = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).distinct()
        if vertices is None:
            return cls(ends, edges, directed)
        data = [c for c in vertices.columns if c != "id"]
        vertices = vertices.where("id is not null")
        vertices = vertices.groupBy("id").agg(F.min(F.struct(*data)).alias("d")).select("id", "d.*") if data else vertices.distinct()
        if unknown == "add":
            return cls(vertices.join(ends, "id", "full"), edges, directed)
        ids = vertices.select("id")
        known = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return cls(vertices, known.select(edges.columns), directed)

    @cached_property
    def adjacency(self) -> DataFrame:
        """Rows (src, dst, ...) along which messages go: the edges, and in an undirected graph also their reverses."""
        if self.dealt is not None:
            return self.dealt
        return self.edges if self.directed else self.symmetrised()

    def symmetrised(self) -> DataFrame:
        """Every edge in both directions, multiplicities kept; the edges are computed once for both."""
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
        both = self.edges.select(*rest, F.explode(F.array(way("src", "dst"), way("dst", "src"))).alias("__way"))
        return both.select(*[f"__way.{c}" if c in ("src", "dst") else c for c in self.edges.columns])

    def undirected(self) -> Graph:
        return Graph(self.vertices, self.edges, False)

    def simple_edges(self) -> DataFrame:
        """Distinct unordered pairs (a, b) with a < b; no self-loops."""
        if self.simple:
            return self.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
        return self.edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()

    def prepared(self, *columns: str) -> Dealt:
        """The adjacency with the named columns, for loops that read it often."""
        return Dealt(self.adjacency.select("src", "dst", *columns), dealt=self.dealt is not None)

    def fixed(self) -> Graph:
        """The same graph, computed once and read again from the shared folder."""
        return Graph(cut(self.vertices), cut(self.edges), self.directed)
