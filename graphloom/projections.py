"""Graphs over the star-schema tables: parts that follow each other in an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import Graph


#: Lines for each shuffle partition of a session that reads them, what adaptive execution puts together of these for one task, and what a task reads of files.
LINES, TASK_BYTES, READ_BYTES = 500_000, "8m", "16m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> part of consecutive lines of an order; weight: the later line's quantity.

    One shuffle by order: the next line comes from a window, not from a join.  The
    session's shuffle partitions are raised to the table, and adaptive execution is kept
    from making as few of them as there are cores, so that no task grows with the table.
    Beyond 200 partitions a task sorts all that it reads, so it reads less of a file.
    """
    lines = table(spark, sf_dir, "lineitem")
    wanted = lines.count() // LINES  # from the files' footers
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", wanted)
    if wanted > 1:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES)
        spark.conf.set("spark.sql.files.maxPartitionBytes", READ_BYTES)
    lines = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    following = lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), F.lead("l_quantity").over(order).alias("weight"))
    return following.where("dst is not null and src <> dst")


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))


def dense(spark: SparkSession, sf_dir: str, directed: bool = True) -> Graph:
    return Graph(vertices(spark, sf_dir), dense_edges(spark, sf_dir), directed)


def sparse(spark: SparkSession, sf_dir: str, directed: bool = True) -> Graph:
    """The dense graph's edges of weight 49 and more: sinks, isolated vertices, many components."""
    return Graph(vertices(spark, sf_dir), dense_edges(spark, sf_dir).where("weight >= 49"), directed)


def simple(spark: SparkSession, sf_dir: str) -> Graph:
    """Distinct unordered pairs of the dense graph."""
    pairs = dense_edges(spark, sf_dir).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return Graph(vertices(spark, sf_dir), pairs, False, simple=True)


def halved(spark: SparkSession, sf_dir: str) -> Graph:
    """The simple graph with every two vertices made one: dense enough for larger cliques."""
    half = lambda c: F.floor(F.col(c) / 2)
    pairs = simple(spark, sf_dir).edges.select(half("src").alias("a"), half("dst").alias("b")).where("a <> b")
    pairs = pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    return Graph(vertices(spark, sf_dir).select(half("id").alias("id")).distinct(), pairs, False, simple=True)
