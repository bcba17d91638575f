"""Graphs stored by buckets, and changes in the order of their lines."""

import pytest
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import access, mutate, traversal
from graphloom.plans.rounds import Dealt
from graphloom.sources import stored, text


def exchanges(df):
    """The shuffles of a plan, each with the columns that it shuffles."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "Exchange hash" in line]


@pytest.mark.parametrize("directed", [True, False])
def test_no_shuffle_of_stored_edges(spark, tmp_path, directed):
    edges = spark.range(500).select((F.col("id") % 90).alias("src"), (F.col("id") * 7 % 90).alias("dst"), F.col("id").cast("double").alias("weight"))
    g = Graph(spark.range(95), edges, directed)
    stored.save(g, str(tmp_path / "g"), "s", buckets=6)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        h = stored.load(spark, str(tmp_path / "g"), "s")
        degree = h.adjacency.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
        assert not exchanges(degree)
        frontier = spark.range(5)
        adjacency = Dealt(h.adjacency.select("src", "dst"), dealt=True)
        assert not [x for x in exchanges(adjacency.meet(frontier)) if "src" in x]
        assert [x for x in exchanges(Dealt(g.adjacency.select("src", "dst")).rows) if "src" in x]
        spark.sql(f"drop table {stored._table(str(tmp_path / 'g'), 'edges')}")  # as another session would find it
        h = stored.load(spark, str(tmp_path / "g"), "s")
        assert sorted(map(tuple, h.edges.collect())) == sorted(map(tuple, g.edges.collect()))
        assert sorted(map(tuple, traversal.bfs(h, 0).collect())) == sorted(map(tuple, traversal.bfs(g, 0).collect()))
        assert sorted(map(tuple, access.out_degree(h).collect())) == sorted(map(tuple, access.out_degree(g).collect()))
        adjacency.release()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_another_graph_under_the_same_path(spark, tmp_path):
    path = str(tmp_path / "g")
    small = Graph(spark.range(2), spark.createDataFrame([(0, 1)], "src long, dst long"), True)
    large = Graph(spark.range(3), spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"), True)
    stored.save(small, path, "a", 2)
    stored.save(large, path, "b", 3)
    assert stored.load(spark, path, "a") is None
    assert stored.load(spark, path, "b").edges.count() == 2


def test_half_a_graph_has_no_signature(spark, tmp_path):
    path = str(tmp_path / "g")
    stored.save(Graph(spark.range(2), spark.createDataFrame([(0, 1)], "src long, dst long"), True), path, "a", 2)
    broken = Graph(spark.range(2), spark.range(3).select(F.col("id").alias("src"), F.raise_error(F.lit("broken")).cast("long").alias("dst")), True)
    with pytest.raises(Exception, match="broken"):
        stored.save(broken, path, "a", 2)
    assert stored.load(spark, path, "a") is None


def test_the_last_line_holds(spark, tmp_path):
    (tmp_path / "e").write_text("1 2 1\n2 3 1\n")
    (tmp_path / "v").write_text("1 7\n2 8\n3 9\n")
    (tmp_path / "ec").mkdir()
    (tmp_path / "ec" / "a").write_text("u 1 2 9\nu 1 2 4\nu 2 3 5\n")
    (tmp_path / "ec" / "b").write_text("# later\nu 2 3 2\n")
    (tmp_path / "vc").write_text("u 1 50\nu 1 3\na 4 6\na 4 5\nu 2 1\n")
    g = text.load_changed(spark, str(tmp_path / "e"), str(tmp_path / "v"), str(tmp_path / "ec"), str(tmp_path / "vc"), directed=True, data_type="long")
    assert sorted(map(tuple, g.edges.collect())) == [(1, 2, 4.0), (2, 3, 2.0)]
    assert {r["id"]: r["data"] for r in g.vertices.collect()} == {1: 3, 2: 1, 3: 9, 4: 5}
    both = text.load_changed(spark, str(tmp_path / "e"), str(tmp_path / "v"), str(tmp_path / "ec"), directed=False)
    assert sorted(map(tuple, both.edges.collect())) == [(1, 2, 4.0), (2, 3, 2.0)]
    rows = spark.createDataFrame([("u", 1, 2, 9.0), ("u", 1, 2, 4.0)], "op string, src long, dst long, weight double")
    assert mutate.apply_changes(g, rows).edges.where("src = 1").first()["weight"] == 9.0


def test_lines_of_a_split_file(spark, tmp_path):
    """A file that several tasks read: the last of 5,000 lines holds."""
    (tmp_path / "e").write_text("1 2 1\n")
    (tmp_path / "c").write_text("".join(f"u 1 2 {i * 7919 % 5000}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert spark.read.text(str(tmp_path / "c")).rdd.getNumPartitions() > 3
        g = text.load_changed(spark, str(tmp_path / "e"), edge_changes=str(tmp_path / "c"), directed=True)
        assert g.edges.first()["weight"] == 4999 * 7919 % 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
