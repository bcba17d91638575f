"""Neighbours of vertices as a table that batches add to, for samplers.

Vertices are dealt into buckets by hash, and a bucket is a folder for each batch that
wrote to it.  A batch writes only its own edges; a reader of some vertices opens the
folders of their buckets and no others.  A bucket with more than ``deltas`` folders is
written anew with the latest weight of each edge, by the batch that found it so.  What
is alive after a batch is a small table of its own, written last, so a batch that runs
again begins where the one before it ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import remove

#: Buckets, and folders of a bucket before they become one.
BUCKETS, DELTAS = 1024, 8
#: Vertices that are broadcast to the edges of their buckets, 8 bytes each for numbers; more are joined by a shuffle.
WANTED_SENT = 1_000_000
SCHEMA = "src long, dst long, weight double, batch long, bucket int"


class NeighbourIndex:
    """Edges (src, dst, weight, batch) by their first end; of an edge that comes again the latest batch counts.

    A row without a second end says that a vertex is known that may have no edges of its own.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, deltas: int = DELTAS):
        self.spark, self.path, self.buckets, self.deltas = spark, path, buckets, deltas
        self.live: dict[int, list[str]] = {}
        self.opened: list[str] = []

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _manifest(self, batch: int) -> dict[int, list[str]]:
        """The folders of each bucket after a batch; none before the first."""
        out: dict[int, list[str]] = {}
        if batch >= 0:
            for r in self.spark.read.schema("bucket int, place int, part string").parquet(f"{self.path}/manifest/batch={batch}").orderBy("bucket", "place").collect():
                out.setdefault(r["bucket"], []).append(r["part"])
        return out

    def _paths(self, buckets: list[int]) -> list[str]:
        return [f"{self.path}/rows/{part}/bucket={b}" for b in sorted(buckets) for part in self.live.get(b, [])]

    def _read(self, buckets: list[int]) -> DataFrame:
        self.opened = self._paths(buckets)
        if not self.opened:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("basePath", f"{self.path}/rows").parquet(*self.opened).select("src", "dst", "weight", "batch", "bucket")

    def _dealt(self, rows: DataFrame, last: Column) -> DataFrame:
        """The ``last`` (weight, batch) of each edge of ``rows`` by bucket, in one shuffle: a bucket goes to so many tasks that they are about the session's shuffle partitions."""
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets + 1
        cell = self._bucket("src") * tasks + F.pmod(F.xxhash64("dst"), F.lit(tasks)).cast("int")
        once = rows.withColumn("cell", cell).repartition("cell").groupBy("cell", "src", "dst").agg(last.alias("last"))
        return once.select("src", "dst", "last.weight", "last.batch", F.floor(F.col("cell") / tasks).cast("int").alias("bucket"))

    def _write(self, rows: DataFrame, last: Column, part: str) -> None:
        dealt = self._dealt(rows, last).sortWithinPartitions("bucket", "src")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/{part}")

    def append(self, edges: DataFrame, batch: int) -> None:
        """Add the edges (src, dst, weight) of a batch, the largest weight of equal ones; batches are numbered from 0 without gaps."""
        self.live = self._manifest(batch - 1)
        second = F.struct(F.col("dst").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(None).cast("double").alias("weight"))
        rows = edges.select(F.explode(F.array(F.struct("src", "dst", "weight"), second)).alias("e")).select("e.*")
        part = f"part=b{batch}"
        self._write(rows, F.struct(F.max("weight").alias("weight"), F.lit(batch).cast("long").alias("batch")), part)
        touched = [r["bucket"] for r in self._written(part)]
        for b in touched:
            self.live.setdefault(b, []).append(part)
        full = [b for b in touched if len(self.live[b]) > self.deltas]
        if full:
            whole = f"part=w{batch}"
            self._write(self._read(full), F.max_by(F.struct("weight", "batch"), "batch"), whole)
            for b in full:
                self.live[b] = [whole]
        rows = [(b, i, p) for b, parts in self.live.items() for i, p in enumerate(parts)]
        self.spark.createDataFrame(rows, "bucket int, place int, part string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch}")
        self._sweep(batch)

    def _written(self, part: str) -> list:
        """The buckets of a part that has just been written."""
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/rows/{part}").select("bucket").distinct().collect()

    def _sweep(self, batch: int) -> None:
        """Delete what batch ``batch - 1`` no longer had; the one before it can't run again."""
        if batch >= 2:
            before, after = self._manifest(batch - 2), self._manifest(batch - 1)
            for b, parts in before.items():
                for part in set(parts) - set(after.get(b, [])):
                    remove(self.spark, f"{self.path}/rows/{part}/bucket={b}")
            remove(self.spark, f"{self.path}/manifest/batch={batch - 3}")

    def _opened(self, asked: DataFrame) -> tuple[DataFrame, int]:
        """All rows of the buckets of distinct vertices (__at), and how many vertices these are."""
        counts = asked.groupBy(self._bucket("__at").alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
        return self._read([r["b"] for r in counts]).drop("bucket"), sum(r["n"] for r in counts)

    def of(self, wanted: DataFrame) -> DataFrame:
        """The rows of the vertices ``wanted`` (at)."""
        asked = wanted.select(F.col("at").alias("__at")).distinct()
        rows, n = self._opened(asked)
        asked = F.broadcast(asked) if n <= WANTED_SENT else asked
        return rows.join(asked, F.col("src") == F.col("__at"), "left_semi")

    def known(self, wanted: DataFrame) -> DataFrame:
        """(at): the vertices ``wanted`` that have rows; each is sent once by a task that reads some, not all of its rows."""
        asked = wanted.select(F.col("at").alias("__at")).distinct()
        rows, _ = self._opened(asked)
        return asked.join(rows.select("src").distinct(), F.col("__at") == F.col("src"), "left_semi").select(F.col("__at").alias("at"))

    def edges(self, wanted: DataFrame) -> DataFrame:
        """The edges of the vertices ``wanted`` (at), every batch's."""
        return self.of(wanted).where("dst is not null")
