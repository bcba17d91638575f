"""The registered queries of the graph operators, over graphs of the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import projections as P
from .functions import compare
from .graph import Graph
from .operators import access, cohesion, community, components, mutate, partition, programs, ranking, sampling, traversal
from .plans.lineage import cut_table, scratch_path
from .plans.superstep import VertexProgram
from .sources import stored, text
from .streaming import batches, sampler

Query = Callable[[SparkSession, str], DataFrame]
SOURCE = 0
HOPS = [4, 3]


def _rounded(df: DataFrame, column: str, digits: int) -> DataFrame:
    return df.withColumn(column, F.round(column, digits))


def _pagerank(graph: Callable, digits: int = 10, **how) -> Query:
    return lambda spark, d: _rounded(ranking.pagerank(graph(spark, d), **how), "rank", digits)


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """Of the sparse graph: delete ends that sum to 0 modulo 10, add one to the weights where it is 1, add edges of weight 48."""
    edges = P.dense_edges(spark, d)
    small = edges.where("weight >= 49")
    gone = small.where("(src + dst) % 10 = 0").select(F.lit("d").alias("op"), "src", "dst", F.lit(None).cast("double").alias("weight"))
    moved = small.where("(src + dst) % 10 = 1").groupBy("src", "dst").agg((F.max("weight") + 1).alias("weight")).select(F.lit("u").alias("op"), "src", "dst", "weight")
    new = edges.where("weight = 48").select(F.lit("a").alias("op"), "src", "dst", "weight")
    return gone.unionAll(moved).unionAll(new)


def _changed(spark: SparkSession, d: str) -> Graph:
    return mutate.apply_changes(P.sparse(spark, d), _changes(spark, d)).fixed()


def _changed_vertices(spark: SparkSession, d: str) -> DataFrame:
    g = P.sparse(spark, d)
    g = Graph(g.vertices.withColumn("data", F.col("id") % 7), g.edges, True)
    ops = g.vertices.select(F.when(F.col("id") % 10 == 0, "d").when(F.col("id") % 10 == 1, "u").when(F.col("id") % 10 == 2, "a").alias("op"), F.when(F.col("id") % 20 == 2, F.col("id") + 10_000_000).otherwise(F.col("id")).alias("id"), (F.col("id") % 5 + 100).alias("data")).where("op is not null")
    new = mutate.apply_changes(g, None, ops, "weight", "data").fixed()
    degree = access.out_degree(new)
    return new.vertices.join(degree, "id").select("id", "data", "degree")


def bfs_program(source: int) -> VertexProgram:
    """Breadth-first search as a vertex program."""
    far = F.lit(traversal.UNREACHED)
    return VertexProgram(
        init=F.when(F.col("id") == source, F.lit(0).cast("long")).otherwise(far),
        active=F.col("id") == source,
        message=F.col("value") + 1,
        combine=F.min,
        update=F.least("value", "heard"),
    )


def wcc_program() -> VertexProgram:
    """Weakly connected components as a vertex program."""
    return VertexProgram(init=F.col("id"), message=F.col("value"), combine=F.min, update=F.least("value", "heard"), direction="both")


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    """The sampler over three batches of lines: heavy edges, light ones, then all with other weights, each time with a query for every vertex."""
    folder = scratch_path(spark, "stream")
    queries = P.vertices(spark, d).select(F.format_string("q %d", "id").alias("value"))
    weights = {"heavy": F.when(F.col("weight") > 25, F.col("weight")), "light": F.when(F.col("weight") <= 25, F.col("weight")), "other": 51 - F.col("weight")}
    once = cut_table(P.dense_edges(spark, d).groupBy("src", "dst").agg(*[F.min(w).alias(name) for name, w in weights.items()]), "edges")
    for name in weights:
        lines = once.where(F.col(name).isNotNull()).select(F.format_string("e %d %d %.1f", "src", "dst", name).alias("value"))
        lines.unionAll(queries).write.mode("append").text(f"{folder}/in", compression="gzip")
        sampler.run(spark, f"{folder}/in", f"{folder}/state", f"{folder}/out", f"{folder}/checkpoint", HOPS, "top_k", files_a_batch=1_000_000, buckets=64).awaitTermination()
    return spark.read.text(f"{folder}/out").select("batch", "value")


def _message_batches(spark: SparkSession, d: str) -> DataFrame:
    """Of every event the batch of its user's stream: 20 events or a day at most, over three runs of the stream."""
    folder = scratch_path(spark, "messages")
    events = P.table(spark, d, "events").select("user_id", "event_id", "ts")
    for part in ("ts < '2024-01-10'", "ts >= '2024-01-10' and ts < '2024-01-20'", "ts >= '2024-01-20' or ts is null"):
        events.where(part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1_000_000).parquet(f"{folder}/in")
        cut = batches.numbered(stream, "user_id", "ts", "event_id", 20, 86_400_000_000)
        cut.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _sample(strategy: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        g = P.dense(spark, d)
        return sampling.sample(g.adjacency, g.vertices, HOPS, strategy, seed=7).select("root", "slot", "nbr")

    return run


def _checked(strategy: str) -> Query:
    """Of each root's first hop: its slots, those with a neighbour, and neighbours that it doesn't have."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        g = P.dense(spark, d)
        known = g.edges.select(F.col("src").alias("root"), F.col("dst").alias("nbr"), F.lit(1).alias("known")).distinct()
        drawn = sampling.sample(g.adjacency, g.vertices, HOPS[:1], strategy, seed=7).join(known, ["root", "nbr"], "left")
        wrong = F.count(F.when(F.col("nbr").isNotNull() & F.col("known").isNull(), 1))
        return drawn.groupBy("root").agg(F.count(F.lit(1)).alias("slots"), F.count("nbr").alias("drawn"), wrong.alias("wrong"))

    return run


def _in_program(spark: SparkSession, d: str) -> DataFrame:
    """Breadth-first search against the edges, as a vertex program that sends along in-edges."""
    program = bfs_program(SOURCE)
    program.direction = "in"
    return program.run(P.dense(spark, d)).withColumnRenamed("value", "depth")


def _mutated_program(spark: SparkSession, d: str) -> DataFrame:
    """Components of the sparse graph, of which a tenth of the vertices and the lighter edges come in after the second round."""
    whole = P.sparse(spark, d)
    part = Graph(whole.vertices.where("id % 10 <> 7"), whole.edges.where("weight > 49 and src % 10 <> 7 and dst % 10 <> 7"), True)
    program = wcc_program()
    program.mutate = lambda g, state, step: whole if step == 1 else None
    program.woken = F.lit(True)
    return program.run(part).withColumnRenamed("value", "comp")


def _files(spark: SparkSession, d: str, edges: DataFrame, shown: str) -> str:
    path = scratch_path(spark, "files")
    edges.select(F.expr(shown).alias("value")).write.text(f"{path}/e")
    P.vertices(spark, d).select(F.col("id").cast("string").alias("value")).write.text(f"{path}/v")
    return path


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    """Degrees of the sparse graph's files, read by a parser that takes the ends the other way round."""
    path = _files(spark, d, P.sparse(spark, d).edges, "format_string('%d;%d', src, dst)")
    ends = lambda w: w.select(F.split(w["w"][0], ";").alias("s")).select(F.col("s")[1].cast("long").alias("src"), F.col("s")[0].cast("long").alias("dst"))
    return access.out_degree(text.load(spark, f"{path}/e", f"{path}/v", directed=True, parser=ends))


def _loaded_changed(spark: SparkSession, d: str) -> DataFrame:
    """Degrees of the sparse graph's files after a file of changes."""
    path = _files(spark, d, P.sparse(spark, d).edges, "format_string('%d %d %.1f', src, dst, weight)")
    _changes(spark, d).select(F.concat_ws(" ", "op", F.col("src").cast("string"), F.col("dst").cast("string"), F.col("weight").cast("string")).alias("value")).write.text(f"{path}/c")
    return access.out_degree(text.load_changed(spark, f"{path}/e", f"{path}/v", f"{path}/c", directed=True))


def _updated(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the sparse graph's files after files of changes that update every edge three times, the last time not to its largest weight."""
    edges = P.sparse(spark, d).edges
    path = _files(spark, d, edges, "format_string('%d %d %.1f', src, dst, weight)")
    new = edges.groupBy("src", "dst").agg(F.max("weight").alias("weight")).select("src", "dst", F.posexplode(F.array(F.col("weight") + 7, F.col("weight") + 3, F.col("weight") + 5)).alias("nth", "weight"))
    ordered = new.repartitionByRange("src", "dst", "nth").sortWithinPartitions("src", "dst", "nth")
    ordered.select(F.format_string("u %d %d %.1f", "src", "dst", "weight").alias("value")).write.text(f"{path}/c")
    return text.load_changed(spark, f"{path}/e", f"{path}/v", f"{path}/c", directed=True).edges.select("src", "dst", "weight")


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    """PageRank of the simple graph's file, loaded with vertices by number."""
    path = _files(spark, d, P.simple(spark, d).edges, "format_string('%d %d', src, dst)")
    return _rounded(ranking.pagerank(text.load_numbered(spark, f"{path}/e", P.vertices(spark, d).count())), "rank", 10)


def _appended(spark: SparkSession, d: str) -> DataFrame:
    """Degrees of the sparse graph and further edges, whose ends are new."""
    more = P.dense_edges(spark, d).where("weight = 48").withColumn("dst", F.col("dst") + 10_000_000)
    return access.out_degree(mutate.append_edges(P.sparse(spark, d), more))


def _written(spark: SparkSession, d: str) -> DataFrame:
    """Shortest paths of the sparse graph, written as text and read back."""
    path = scratch_path(spark, "result")
    text.write_result(traversal.sssp(P.sparse(spark, d), SOURCE), path)
    return text.read_result(spark, path)


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the sparse graph, stored under a signature and loaded again."""
    path = scratch_path(spark, "graph")
    sign = stored.signature(table="lineitem", at=49)
    stored.cached(spark, path, sign, lambda: P.sparse(spark, d))
    return access.counts(stored.cached(spark, path, sign, lambda: P.dense(spark, d)))


def _stored_search(directed: bool) -> Query:
    """Breadth-first search over the sparse graph, stored by buckets and loaded again."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        path = scratch_path(spark, "graph")
        sign = stored.signature(table="lineitem", at=49, directed=directed)
        return traversal.bfs(stored.cached(spark, path, sign, lambda: P.sparse(spark, d, directed)), SOURCE)

    return run


def _loaded(spark: SparkSession, d: str) -> DataFrame:
    """Degrees of the sparse graph's text files: comments, a broken line and an unknown end are left out."""
    path = scratch_path(spark, "files")
    edges = P.dense_edges(spark, d).where("weight >= 49").select(F.format_string("%d\t%d %.1f", "src", "dst", "weight").alias("value"))
    extra = spark.createDataFrame([("# a comment",), ("",), ("1 x 2",), ("1 999999999 5",)], "value string")
    edges.unionAll(extra).write.text(f"{path}/e")
    P.vertices(spark, d).select(F.col("id").cast("string").alias("value")).write.text(f"{path}/v")
    return access.out_degree(text.load(spark, f"{path}/e", f"{path}/v", directed=True))


def _compared(spark: SparkSession, d: str) -> DataFrame:
    """Whether the components agree with themselves, with other names for them, and with a few of them changed."""
    g = P.sparse(spark, d, directed=False).fixed()
    a, b = components.wcc(g), wcc_program().run(g).withColumnRenamed("value", "comp")
    others = {"same": b, "renamed": b.withColumn("comp", F.col("comp") + 1), "nearly": b.withColumn("comp", F.col("comp") * 1.00001), "changed": b.withColumn("comp", F.when(F.col("id") % 100 == 3, F.lit(-1)).otherwise(F.col("comp")))}
    rows = [(name, compare.isomorphic(a, x), compare.exact(a, x), compare.within(a, x)) for name, x in others.items()]
    return spark.createDataFrame(rows, "name string, isomorphic boolean, exact boolean, within boolean")


QUERIES: dict[str, Query] = {
    "bfs_dense": lambda s, d: traversal.bfs(P.dense(s, d), SOURCE),
    "bfs_sparse": lambda s, d: traversal.bfs(P.sparse(s, d), SOURCE),
    "bfs_simple": lambda s, d: traversal.bfs(P.simple(s, d), SOURCE),
    "sssp_dense": lambda s, d: traversal.sssp(P.dense(s, d), SOURCE),
    "sssp_sparse": lambda s, d: traversal.sssp(P.sparse(s, d), SOURCE),
    "sssp_near_far_dense": lambda s, d: traversal.sssp(P.dense(s, d), SOURCE, split=0),
    "bc_simple": lambda s, d: _rounded(_rounded(traversal.betweenness(P.simple(s, d), SOURCE), "delta", 6), "sigma", 6),
    "wcc_sparse": lambda s, d: components.wcc(P.sparse(s, d)),
    "cdlp_simple": lambda s, d: community.cdlp(P.simple(s, d)),
    "cdlp_dense_directed": lambda s, d: community.cdlp(P.dense(s, d)),
    "pagerank_simple": _pagerank(P.simple),
    "pagerank_sparse_ldbc": _pagerank(P.sparse),
    "pagerank_sparse_drop": _pagerank(P.sparse, sinks="drop"),
    "pagerank_sparse_push": _pagerank(P.sparse, sinks="push"),
    "pagerank_local_simple": _pagerank(P.simple, 8, normalized=False),
    "pagerank_local_undivided_simple": lambda s, d: ranking.pagerank(P.simple(s, d), rounds=3, normalized=False, divide="first").select("id", F.round("rank", 4).alias("rank")),
    "pagerank_local_undivided_ten_simple": lambda s, d: ranking.pagerank(P.simple(s, d), normalized=False, divide="first").select("id", F.round(F.log10("rank"), 8).alias("rank")),
    "lcc_simple": lambda s, d: _rounded(cohesion.lcc(P.simple(s, d)), "lcc", 12),
    "lcc_simple_threshold": lambda s, d: _rounded(cohesion.lcc(P.simple(s, d), 45), "lcc", 12),
    "lcc_dense_directed": lambda s, d: _rounded(cohesion.lcc_directed(P.dense(s, d)), "lcc", 12),
    "triangles_simple": lambda s, d: cohesion.triangle_counts(P.simple(s, d)),
    "triangle_total_simple": lambda s, d: cohesion.triangle_total(P.simple(s, d)),
    "kcore_simple_k30": lambda s, d: cohesion.kcore(P.simple(s, d), 30),
    "kcore_size_simple_k31": lambda s, d: cohesion.kcore_size(P.simple(s, d), 31),
    "coreness_sparse": lambda s, d: cohesion.coreness(P.sparse(s, d, False)),
    "coreness_simple": lambda s, d: cohesion.coreness(P.simple(s, d)),
    "coreness_total_simple": lambda s, d: cohesion.coreness_total(P.simple(s, d)),
    "kclique3_simple": lambda s, d: cohesion.kclique(P.simple(s, d), 3),
    "kclique4_simple": lambda s, d: cohesion.kclique(P.simple(s, d), 4),
    "kclique5_halved": lambda s, d: cohesion.kclique(P.halved(s, d), 5),
    "degree_out_dense": lambda s, d: access.out_degree(P.dense(s, d)),
    "degree_in_dense": lambda s, d: access.in_degree(P.dense(s, d)),
    "neighbors_filtered_dense": lambda s, d: access.neighbours(P.dense(s, d), P.vertices(s, d), "out", F.col("weight") > 25),
    "neighbors_in_dense": lambda s, d: access.neighbours(P.dense(s, d), P.vertices(s, d), "in"),
    "has_parent_sparse": lambda s, d: access.has_edges(P.sparse(s, d), "in"),
    "counts_dense": lambda s, d: access.counts(P.dense(s, d)),
    "frontier_erase_sparse": lambda s, d: access.erase(access.insert(P.vertices(s, d).where("id % 3 = 0"), P.vertices(s, d).where("id % 3 = 1")), access.has_edges(P.sparse(s, d), "out")),
    "border_dense": lambda s, d: access.border(P.dense(s, d), F.col("src") % 4, F.col("dst") % 4),
    "destinations_sparse": lambda s, d: access.destinations(P.sparse(s, d), F.col("dst") % 4).select("id", F.concat_ws(",", F.transform("parts", lambda x: x.cast("string"))).alias("parts")),
    "vertexcut_blocks": lambda s, d: partition.vertex_cut(P.dense_edges(s, d), P.vertices(s, d).count(), 4).groupBy("block").agg(F.count(F.lit(1)).alias("edges")),
    "map_partition": lambda s, d: partition.by_map(P.vertices(s, d), 6),
    "segment_partition": lambda s, d: partition.by_segment(P.vertices(s, d), partition.boundaries(P.vertices(s, d), 6)),
    "hash_partition": lambda s, d: partition.sizes(partition.by_hash(P.vertices(s, d), 4)),
    "rebalance_map": lambda s, d: partition.rebalance(P.dense(s, d), 4),
    "rebalance_segment": lambda s, d: partition.rebalance(P.sparse(s, d, False), 4, 2, True),
    "mutate_then_bfs": lambda s, d: traversal.bfs(_changed(s, d), SOURCE),
    "mutate_then_sssp": lambda s, d: traversal.sssp(_changed(s, d), SOURCE),
    "mutate_then_wcc": lambda s, d: components.wcc(_changed(s, d)),
    "mutate_vertices": _changed_vertices,
    "sample_topk_dense": _sample("top_k"),
    "sample_random_dense": _sample("random"),
    "sample_edge_weight_dense": _sample("edge_weight"),
    "sample_random_checked_dense": _checked("random"),
    "sample_edge_weight_checked_dense": _checked("edge_weight"),
    "stream_sampler_dense": _streamed,
    "stream_batches_events": _message_batches,
    "program_bfs_dense": lambda s, d: bfs_program(SOURCE).run(P.dense(s, d)).withColumnRenamed("value", "depth"),
    "program_wcc_sparse": lambda s, d: wcc_program().run(P.sparse(s, d)).withColumnRenamed("value", "comp"),
    "program_in_dense": _in_program,
    "program_mutated_sparse": _mutated_program,
    "program_pagerank_sparse": lambda s, d: _rounded(programs.fields(programs.pagerank().run(programs.with_degree(P.sparse(s, d)))).select("id", "rank"), "rank", 10),
    "program_hits_sparse": lambda s, d: _rounded(_rounded(programs.fields(programs.hits(6).run(P.sparse(s, d))), "hub", 9), "authority", 9),
    "program_tree_dense": lambda s, d: programs.fields(programs.tree(SOURCE).run(P.dense(s, d))),
    "loaded_parsed_sparse": _parsed,
    "loaded_changed_sparse": _loaded_changed,
    "pagerank_numbered_simple": _numbered,
    "appended_degree_sparse": _appended,
    "text_result_sssp_sparse": _written,
    "stored_counts_sparse": _stored,
    "stored_bfs_sparse": _stored_search(True),
    "stored_bfs_both_sparse": _stored_search(False),
    "loaded_updated_sparse": _updated,
    "loaded_degree_sparse": _loaded,
    "compared_components": _compared,
}
