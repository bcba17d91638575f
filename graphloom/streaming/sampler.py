"""The neighbour sampler as a micro-batch job.

Each batch of text lines holds edges, ``e src dst weight``, and queries, ``q id``.
All edges of a batch are added before its queries are answered.  The edges are an index
by vertex that a batch adds to (``operators.neighbour_index``): it writes its own, and a
hop reads the buckets of the vertices that it draws for.  Results are one folder for
each batch id; both are overwritten when a batch runs again, so a restart neither loses
nor repeats anything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.neighbour_index import BUCKETS, NeighbourIndex
from ..operators.sampling import lines, sample
from ..plans.lineage import cut


def parse(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, weight) and queries (id) of text lines; comments and anything else are left out."""
    words = values.select(F.split(F.trim("value"), r"\s+").alias("w"))
    number = lambda i, kind: F.get("w", F.lit(i)).try_cast(kind)
    edges = words.where("w[0] = 'e'").select(number(1, "long").alias("src"), number(2, "long").alias("dst"), number(3, "double").alias("weight")).where("src is not null and dst is not null and weight is not null")
    queries = words.where("w[0] = 'q'").select(number(1, "long").alias("id")).where("id is not null")
    return edges, queries


def handler(state: str, results: str | Callable[[DataFrame, int], None], hops: list[int], strategy: str = "top_k", seed: int = 0, directed: bool = True, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """The function of a batch, for ``foreachBatch``; ``results`` is a folder or takes the lines (value) of a batch."""

    def write(answers: DataFrame, batch_id: int) -> None:
        answers.write.mode("overwrite").text(f"{results}/batch={batch_id}")

    sink = write if isinstance(results, str) else results

    def handle(batch: DataFrame, batch_id: int) -> None:
        index = NeighbourIndex(batch.sparkSession, state, buckets)
        edges, queries = parse(batch)
        index.append(edges if directed else edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")), batch_id)
        asked = cut(queries.distinct())
        known = index.known(asked.withColumnRenamed("id", "at")).withColumnRenamed("at", "id")
        sink(lines(sample(index.edges, known, hops, strategy, seed, order="batch")), batch_id)

    return handle


def run(spark: SparkSession, source: str | DataFrame, state: str, results: str | Callable[[DataFrame, int], None], checkpoint: str, hops: list[int], strategy: str = "top_k", seed: int = 0, directed: bool = True, files_a_batch: int = 1, interval: str | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Start the job over a folder of text files or any stream of lines (value), such as ``kafka_source``.

    Without an interval it ends when all that is there is read.
    """
    stream = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(source) if isinstance(source, str) else source
    writer = stream.writeStream.foreachBatch(handler(state, results, hops, strategy, seed, directed, buckets)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def kafka_source(spark: SparkSession, servers: str, topic: str, batch: int) -> DataFrame:
    """The lines of a Kafka topic, from its beginning, ``batch`` at most at a time; needs Spark's Kafka connector on the class path."""
    read = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", batch)
    return read.load().select(F.col("value").cast("string").alias("value"))


def kafka_sink(servers: str, topic: str) -> Callable[[DataFrame, int], None]:
    """Answers as messages of a Kafka topic; a batch that runs again repeats its messages."""

    def write(answers: DataFrame, batch_id: int) -> None:
        answers.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()

    return write
