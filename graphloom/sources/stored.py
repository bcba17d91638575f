"""Graphs as Parquet with a signature of what they were made from.

The vertices are bucketed by id and the adjacency by its first end, both sorted, so a
loop over a loaded graph joins and counts without a shuffle of the edges.  Buckets are
read through a table of the session's catalog over the stored files; a session that has
none of that name makes it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..graph import Graph
from ..plans.lineage import remove

#: Buckets of a stored graph; a bucket is a task, so some for each core of the cluster.
BUCKETS = 64


def signature(**made_from: object) -> str:
    return hashlib.sha256(json.dumps(made_from, sort_keys=True, default=str).encode()).hexdigest()


def _table(path: str, part: str) -> str:
    return f"graphloom_{hashlib.sha256(f'{path}/{part}'.encode()).hexdigest()[:24]}"


def _write(df: DataFrame, path: str, part: str, by: str, buckets: int) -> None:
    spark, name = df.sparkSession, _table(path, part)
    spark.sql(f"drop table if exists {name}")
    remove(spark, f"{path}/{part}")
    df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", f"{path}/{part}").format("parquet").saveAsTable(name)


def _read(spark: SparkSession, path: str, part: str, by: str, buckets: int) -> DataFrame:
    name = _table(path, part)
    if not spark.catalog.tableExists(name):
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/{part}").schema)
        spark.sql(f"create table {name} ({fields}) using parquet clustered by ({by}) sorted by ({by}) into {buckets} buckets location '{path}/{part}'")
    return spark.table(name)


def save(g: Graph, path: str, sign: str, buckets: int = BUCKETS) -> None:
    """The old signature goes first and the new one comes last, so no signature ever stands by half a graph or another one."""
    spark = g.vertices.sparkSession
    remove(spark, f"{path}/signature")
    _write(g.vertices, path, "vertices", "id", buckets)
    _write(g.edges, path, "edges", "src", buckets)
    if not g.directed:
        _write(g.symmetrised(), path, "adjacency", "src", buckets)
    spark.createDataFrame([(sign, g.directed, buckets)], "sign string, directed boolean, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/signature")


def load(spark: SparkSession, path: str, sign: str) -> Graph | None:
    """The stored graph, or None if there is none of that signature."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.parquet(f"{path}/signature").first()
    except AnalysisException:
        return None
    if row is None or row["sign"] != sign:
        return None
    part = lambda name, by: _read(spark, path, name, by, row["buckets"])
    edges = part("edges", "src")
    return Graph(part("vertices", "id"), edges, row["directed"], edges if row["directed"] else part("adjacency", "src"))


def cached(spark: SparkSession, path: str, sign: str, make: Callable[[], Graph]) -> Graph:
    """The stored graph of that signature; made and stored where there is none."""
    found = load(spark, path, sign)
    if found is None:
        save(make(), path, sign)
        found = load(spark, path, sign)
    return found
