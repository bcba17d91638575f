"""White-space separated text: vertices, edges, change records and results.

Lines that are empty, begin with # or don't parse are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.mutate import apply_changes


def words(spark: SparkSession, path: str, placed: bool = False) -> DataFrame:
    """(w): the words of each line that is neither empty nor a comment; with ``placed`` also ``place``, by which lines compare as they stand.

    A place is the file's name, where its split begins and the row there.
    """
    line = F.trim(F.regexp_replace("value", r"[\t\r]", " "))
    place = [F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")).alias("place")] if placed else []
    return spark.read.text(path).select(line.alias("value"), *place).where("value <> '' and not startswith(value, '#')").select(F.split("value", r"\s+").alias("w"), *(["place"] if placed else []))


def _word(i: int, kind: str) -> Column:
    return F.get("w", F.lit(i)).try_cast(kind)


def read_vertices(spark: SparkSession, path: str, id_type: str = "long", data_type: str | None = None) -> DataFrame:
    """(id[, data])."""
    data = [_word(1, data_type).alias("data")] if data_type else []
    return words(spark, path).select(_word(0, id_type).alias("id"), *data).where("id is not null")


def read_edges(spark: SparkSession, path: str, id_type: str = "long", weight_type: str | None = "double") -> DataFrame:
    """(src, dst[, weight]); with a weight type, lines without a weight are left out."""
    weight = [_word(2, weight_type).alias("weight")] if weight_type else []
    found = words(spark, path).select(_word(0, id_type).alias("src"), _word(1, id_type).alias("dst"), *weight).where("src is not null and dst is not null")
    return found.where("weight is not null") if weight_type else found


def read_edge_changes(spark: SparkSession, path: str, id_type: str = "long", weight_type: str = "double") -> DataFrame:
    """(op, src, dst, weight, place): added (a), deleted (d) and updated (u) edges, and where they stand."""
    found = words(spark, path, True).select(F.get("w", F.lit(0)).alias("op"), _word(1, id_type).alias("src"), _word(2, id_type).alias("dst"), _word(3, weight_type).alias("weight"), "place")
    return found.where("src is not null and dst is not null and (op = 'd' or (op in ('a', 'u') and weight is not null))")


def read_vertex_changes(spark: SparkSession, path: str, id_type: str = "long", data_type: str = "string") -> DataFrame:
    """(op, id, data, place)."""
    found = words(spark, path, True).select(F.get("w", F.lit(0)).alias("op"), _word(1, id_type).alias("id"), _word(2, data_type).alias("data"), "place")
    return found.where("id is not null and op in ('a', 'd', 'u')")


def load(spark: SparkSession, edges: str, vertices: str | None = None, directed: bool = False, id_type: str = "long", weight_type: str | None = "double", data_type: str | None = None, unknown: str = "drop", parser: Callable[[DataFrame], DataFrame] | None = None) -> Graph:
    """The graph of an edge file and maybe a vertex file; ``parser`` maps (w) to edges in place of the usual columns."""
    found = parser(words(spark, edges)) if parser else read_edges(spark, edges, id_type, weight_type)
    return Graph.of(found, read_vertices(spark, vertices, id_type, data_type) if vertices else None, directed, unknown)


def load_changed(spark: SparkSession, edges: str, vertices: str | None = None, edge_changes: str | None = None, vertex_changes: str | None = None, directed: bool = False, id_type: str = "long", weight_type: str | None = "double", data_type: str | None = None) -> Graph:
    """The graph of the files after one batch of changes; of several updates of one thing the last line holds."""
    g = load(spark, edges, vertices, directed, id_type, weight_type, data_type)
    changed = read_edge_changes(spark, edge_changes, id_type, weight_type or "double") if edge_changes else None
    moved = read_vertex_changes(spark, vertex_changes, id_type, data_type or "string") if vertex_changes else None
    return apply_changes(g, changed, moved, "weight" if weight_type else None, "data" if data_type else None, "place")


def load_numbered(spark: SparkSession, edges: str, n: int, weight_type: str | None = None) -> Graph:
    """An undirected graph whose vertices are 0 .. n-1; ends are compared with n, not looked up."""
    known = read_edges(spark, edges, "long", weight_type).where((F.least("src", "dst") >= 0) & (F.greatest("src", "dst") < n))
    return Graph(spark.range(n), known, False)


def shown(value: str, kind: str) -> Column:
    """A value as results print it: doubles with 15 decimals in scientific form, infinity by name."""
    if kind in ("double", "float"):
        return F.when(F.col(value) == float("inf"), F.lit("infinity")).otherwise(F.format_string("%.15e", F.col(value).cast("double")))
    return F.col(value).cast("string")


def write_result(result: DataFrame, path: str) -> None:
    """One line ``id value ...`` for each row, one file for each partition."""
    kinds = dict(result.dtypes)
    result.select(F.concat_ws(" ", *[shown(c, kinds[c]) for c in result.columns]).alias("value")).write.text(path)


def read_result(spark: SparkSession, path: str, value_type: str = "double", id_type: str = "long") -> DataFrame:
    """(id, value) as written; the name infinity is the number."""
    text = F.get("w", F.lit(1))
    value = F.when(text == "infinity", F.lit("Infinity")).otherwise(text).try_cast(value_type)
    return words(spark, path).select(_word(0, id_type).alias("id"), value.alias("value")).where("id is not null")
