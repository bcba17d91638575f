"""What a round of a loop costs: no sorts of the edges, one shuffle of what is told, and tasks that don't grow with the tables."""

from pyspark.sql import functions as F

from graphloom import projections
from graphloom.graph import Graph
from graphloom.operators import community
from graphloom.plans.rounds import Dealt
from graphloom.sources import text


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_wait_unsorted_for_a_state(spark):
    edges = spark.range(400).select((F.col("id") % 20).alias("src"), (F.col("id") % 7).alias("dst"))
    for hub in (None, 5):
        dealt = Dealt(edges, hub=hub)
        met = dealt.meet(spark.range(20))
        assert "SortMergeJoin" not in plan(met)
        assert met.count() == 400
        dealt.release()


def test_told_is_shuffled_once(spark):
    dealt = Dealt(spark.range(400).select((F.col("id") % 20).alias("src"), (F.col("id") % 7).alias("dst")), "dst", "src")
    told = dealt.dealt(dealt.meet(spark.range(7).withColumn("label", F.col("id"))).select("src", "label"), "src")
    heard = told.groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
    best, picked = community._best(heard.schema["label"].dataType, 0, 6, dealt)
    once, before = plan(heard.groupBy("src").agg(best.alias("best"))), plan(told)
    assert once.count("Exchange hashpartitioning(src") == before.count("Exchange hashpartitioning(src") and "SortAggregate" not in once
    dealt.release()


def test_labels_that_dont_fit_beside_a_count(spark):
    """Ids near the ends of a long, and the same graph with small ones."""
    pairs = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5), (6, 6)]
    labels = {}
    for far in (1, 1 << 60):
        names = [(i - 4) * far for i in range(8)]
        g = Graph(spark.createDataFrame([(n,) for n in names], "id long"), spark.createDataFrame([(names[a], names[b]) for a, b in pairs], "src long, dst long"), False)
        labels[far] = {r["id"] // far: r["label"] // far for r in community.cdlp(g, 3).collect()}
    assert labels[1] == labels[1 << 60] and labels[1][3] == 3


def test_partitions_follow_the_lines(spark, tmp_path, monkeypatch):
    rows = [(o, n, (o + n) % 9, 0, float(n), 1.0) for o in range(50) for n in range(4)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(projections, "LINES", 20)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert projections.dense_edges(spark, str(tmp_path)).count() == 150
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == 10
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_tasks_are_not_put_together_by_cores(spark, tmp_path, monkeypatch):
    """With four cores the partitions of the lines stay as small as asked for, not a fourth of the table each."""
    rows = spark.range(60_000).select((F.col("id") / 4).cast("long").alias("l_orderkey"), (F.col("id") % 4).cast("int").alias("l_linenumber"), F.xxhash64("id").alias("l_partkey"), F.xxhash64("id").alias("l_suppkey"), F.lit(1.0).alias("l_quantity"), F.rand(1).alias("l_extendedprice"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(projections, "LINES", 3_000)
    monkeypatch.setattr(projections, "TASK_BYTES", "100k")
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize", "spark.sql.files.maxPartitionBytes")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set(keys[2], "50k")
        tasks = projections.dense_edges(spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks >= 10
        assert spark.conf.get(keys[3]) == projections.READ_BYTES
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_numbered_ends_are_not_looked_up(spark, tmp_path):
    (tmp_path / "e").write_text("0 1\n1 2\n-1 2\n2 3\n# 0 0\n")
    edges = text.load_numbered(spark, str(tmp_path / "e"), 3).edges
    assert "Join" not in plan(edges) and sorted(map(tuple, edges.collect())) == [(0, 1), (1, 2)]
