"""Reliable lineage cuts.

Iterative operators grow their plan with every round.  ``cut`` writes the rows to
the folder named by ``spark.checkpoint.dir``, which driver and executors share,
so a lost executor costs a re-read and not a recomputation of all rounds.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is taken from ``spark.checkpoint.dir``.  Where that is unset, a local
    master gets a temporary folder; any other master raises, since a machine-local
    folder would be lost with its executor.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to
    sc = spark.sparkContext
    if (known := sc.getCheckpointDir()) is not None:
        return known
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="graphloom-")
    sc.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing exists there yet."""
    base = shared_dir(spark)
    return os.path.join(base, f"graphloom-{uuid.uuid4().hex}", name)


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and read again from the shared folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def cut_observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """``cut``, and aggregates over its rows that the same job gathers."""
    seen = Observation()
    out = cut(df.observe(seen, *[c.alias(name) for name, c in metrics.items()]))
    return out, seen.get


#: Spark's setting that drops a query's shuffle files when the query ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Like ``cut``, but as compressed Parquet, for tables that are wide or large.

    The shuffle files of the write are dropped at its end: the table replaces them.
    A caller that names the ``path`` can ``remove`` it when nothing reads it any more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name) if path is None else path
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
