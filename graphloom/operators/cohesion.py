"""Triangles, clustering, cores and cliques.

Edges are oriented from the vertex of lower degree to the one of higher degree
(ties by id), so a hub has few out-edges and the joins that look for triangles
and cliques stay far below the square of the degrees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import Graph
from ..plans.lineage import cut, cut_table
from ..plans.rounds import Dealt, Rounds

#: Of all vertices, those that fall in a round for all to look at their neighbours again.
WHOLE = 0.25


def _degrees(pairs: DataFrame) -> DataFrame:
    both = pairs.select(F.col("a").alias("v")).unionAll(pairs.select(F.col("b").alias("v")))
    return both.groupBy("v").agg(F.count(F.lit(1)).alias("deg"))


def oriented(pairs: DataFrame) -> DataFrame:
    """(u, w, du, dw): each pair once, from lower to higher (degree, id)."""
    degree = _degrees(pairs)
    da = degree.select(F.col("v").alias("a"), F.col("deg").alias("da")).hint("shuffle_hash")
    db = degree.select(F.col("v").alias("b"), F.col("deg").alias("db")).hint("shuffle_hash")
    known = pairs.join(da, "a").join(db, "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    pick = lambda x, y, name: F.when(up, F.col(x)).otherwise(F.col(y)).alias(name)
    return known.select(pick("a", "b", "u"), pick("b", "a", "w"), pick("da", "db", "du"), pick("db", "da", "dw"))


def _lists(edges: DataFrame) -> DataFrame:
    """(u, ws): of the edges (u, w, dw) each vertex's later neighbours in their order, at most the root of twice the edges."""
    by = edges.select("u", "w", "dw").repartition("u").groupBy("u").agg(F.sort_array(F.collect_list(F.struct("dw", "w"))).alias("s"))
    return cut_table(by.select("u", F.col("s.w").alias("ws")), "lists")


def _closed(lists: DataFrame) -> DataFrame:
    """(x, y, at, rest, zs): of each edge (x, y) that closes triangles their third vertices.

    What follows y in the list of x, where y is number ``at``, goes to y as one row and
    meets the list of y there.  So no row is made for two neighbours without a link, and
    only one list of each vertex waits in memory.
    """
    n = F.size("ws")
    out = lists.select(F.col("u").alias("x"), "ws", F.posexplode("ws").alias("at", "y")).where(F.col("at") + 1 < n)
    out = out.select("x", "y", "at", F.slice("ws", F.col("at") + 2, n).alias("rest"))
    own = lists.select(F.col("u").alias("y"), "ws").hint("shuffle_hash")
    return out.join(own, "y").select("x", "y", "at", "rest", F.array_intersect("rest", "ws").alias("zs")).where(F.size("zs") > 0)


def triangles(pairs: DataFrame, most: int | None = None) -> DataFrame:
    """(x, y, z) of each triangle once, in orientation order.

    With ``most``, vertices of higher degree offer no list of neighbours, so a
    triangle is missed if its first or second vertex is one.
    """
    edges = oriented(pairs)
    first = edges if most is None else edges.where(F.col("du") <= most)
    return _closed(_lists(first)).select("x", "y", F.explode("zs").alias("z"))


def _each(found: DataFrame, *names: str) -> DataFrame:
    return found.select(F.explode(F.array(*names)).alias("v"), *[c for c in found.columns if c not in names])


def triangle_counts(g: Graph) -> DataFrame:
    """(id, triangles) on the simple undirected graph."""
    pairs = cut_table(g.simple_edges(), "pairs")
    counts = _each(triangles(pairs), "x", "y", "z").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return g.vertices.select("id").join(counts, F.col("id") == F.col("v"), "left").select("id", F.coalesce("n", F.lit(0)).alias("triangles"))


def triangle_total(g: Graph) -> DataFrame:
    """One row (triangles)."""
    return triangles(cut_table(g.simple_edges(), "pairs")).agg(F.count(F.lit(1)).alias("triangles"))


def lcc(g: Graph, degree_threshold: int | None = None) -> DataFrame:
    """(id, lcc): twice the triangles over d(d-1), on the simple undirected graph; 0 for degrees 0 and 1."""
    pairs = cut_table(g.simple_edges(), "pairs")
    counts = _each(triangles(pairs, degree_threshold), "x", "y", "z").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    joined = g.vertices.select("id").join(_degrees(pairs).withColumnRenamed("v", "dv"), F.col("id") == F.col("dv"), "left").join(counts, F.col("id") == F.col("v"), "left")
    d = F.coalesce("deg", F.lit(0))
    return joined.select("id", F.when(d > 1, 2 * F.coalesce("n", F.lit(0)) / (d * (d - 1))).otherwise(F.lit(0.0)).alias("lcc"))


def lcc_directed(g: Graph) -> DataFrame:
    """(id, lcc): directed edges among the neighbours of either direction, with multiplicity, over n(n-1).

    Self-loops are left out; 0 for fewer than two neighbours.
    """
    weights = cut_table(g.edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("times")), "weights")
    pairs = weights.select("a", "b")
    found = triangles(pairs)
    corner = lambda v, p, q: F.struct(F.col(v).alias("v"), F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))
    corners = found.select(F.inline(F.array(corner("x", "y", "z"), corner("y", "x", "z"), corner("z", "x", "y"))))
    counts = corners.join(weights, ["a", "b"]).groupBy("v").agg(F.sum("times").alias("n"))
    joined = g.vertices.select("id").join(_degrees(pairs).withColumnRenamed("v", "dv"), F.col("id") == F.col("dv"), "left").join(counts, F.col("id") == F.col("v"), "left")
    d = F.coalesce("deg", F.lit(0))
    return joined.select("id", F.when(d > 1, F.coalesce("n", F.lit(0)) / (d * (d - 1))).otherwise(F.lit(0.0)).alias("lcc"))


def kcore(g: Graph, k: int) -> DataFrame:
    """(id, core_degree) of the vertices that stay when those of degree below k are peeled off, again and again.

    Degrees are those of the undirected multigraph; a self-loop counts twice.  A round
    follows the edges of the vertices that have just gone and takes what they held from
    the degrees of their neighbours; the edges stay where they are.
    """
    adjacency, rounds = Dealt(g.symmetrised().select("src", "dst")), Rounds()
    degree = adjacency.rows.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    if k <= 0:
        return g.vertices.select("id").join(degree, "id", "left").select("id", F.coalesce("deg", F.lit(0)).alias("core_degree"))
    goes = (F.col("deg") < k).alias("goes")
    gone = F.count(F.when(F.col("goes"), 1))
    state, met = rounds.keep(degree.select("id", "deg", goes), n=gone)
    while met["n"]:
        lost = adjacency.meet(state.where("goes").select("id")).groupBy(F.col("dst").alias("to")).agg(F.count(F.lit(1)).alias("lost")).hint("shuffle_hash")
        left = state.where(~F.col("goes")).join(lost, F.col("id") == F.col("to"), "left").select("id", (F.col("deg") - F.coalesce("lost", F.lit(0))).alias("deg"))
        state, met = rounds.keep(left.select("id", "deg", goes), n=gone)
    state = cut(state.select("id", F.col("deg").alias("core_degree")))
    adjacency.release()
    rounds.release()
    return state


def kcore_size(g: Graph, k: int) -> DataFrame:
    """One row (k, vertices)."""
    return kcore(g, k).agg(F.lit(k).alias("k"), F.count(F.lit(1)).alias("vertices"))


def coreness(g: Graph, rounds: int = 100_000, whole: float | None = None, steps: list[tuple[str, int]] | None = None) -> DataFrame:
    """(id, coreness): the largest k whose core has the vertex; 0 for an isolated one.

    Every vertex starts from its degree and falls to the h-index of its neighbours'
    values until none falls any more; the fixpoint is the coreness.  A vertex also knows
    its support, the number of neighbours whose values reach its own.  Who has fallen
    tells its neighbours from where to where, and only those whose support is then below
    their value look at their neighbours again.  While more than ``whole`` of all
    vertices fall in a round, all look again, which takes one shuffle less.  ``steps``
    gathers how each round was done and how many vertices fell.
    """
    whole = WHOLE if whole is None else whole
    adjacency, kept = Dealt(g.symmetrised().select("src", "dst")), Rounds()
    falls = F.count(F.when(F.col("old") > F.col("c"), 1))
    start = adjacency.rows.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("c"))
    state, met = kept.keep(start.select("id", "c", F.lit(0).cast("long").alias("s"), F.col("c").alias("old")), n=F.count(F.lit(1)))
    n = fell = met["n"]
    above = Window.partitionBy("of").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0)
    for _ in range(rounds):
        if not fell:
            break
        if fell > whole * n:
            base, how = state.select("id", "c", "s"), "all"
            heard = adjacency.meet(base).select(F.col("dst").alias("of"), F.col("c").alias("v"))
        else:
            told = adjacency.meet(state.where("old > c").select("id", "old", F.col("c").alias("new"))).select(F.col("dst").alias("to"), "old", "new")
            told = adjacency.dealt(told, "to").groupBy("to", "old", "new").agg(F.count(F.lit(1)).alias("times"))
            own = state.select("id", "c", "s")
            less = told.join(own.hint("shuffle_hash"), F.col("to") == F.col("id")).where("old >= c and c > new").groupBy("to").agg(F.sum("times").alias("less"))
            base, met = kept.keep(own.join(less.hint("shuffle_hash"), F.col("id") == F.col("to"), "left").select("id", "c", (F.col("s") - F.coalesce("less", F.lit(0))).alias("s")), n=F.count(F.when(F.col("s") < F.col("c"), 1)))
            if not met["n"]:
                state = base
                break
            how = "some"
            values = base.select(F.col("id").alias("nbr"), F.col("c").alias("v"))
            heard = adjacency.meet(base.where("s < c").select("id")).select(F.col("id").alias("of"), "dst").join(values.hint("shuffle_hash"), F.col("dst") == F.col("nbr")).select("of", "v")
        counted = adjacency.dealt(heard, "of").groupBy("of", "v").agg(F.count(F.lit(1)).alias("k"))
        ranked = counted.withColumn("upto", F.sum("k").over(above))  # a hub hears few different values
        # Of the values that give the h-index the smallest has the support.
        told = ranked.groupBy("of").agg(F.max(F.struct(F.least("v", "upto").alias("h"), F.col("upto").alias("support"))).alias("top")).select("of", "top.h", "top.support").hint("shuffle_hash")
        merged = base.join(told, F.col("id") == F.col("of"), "left").select("id", F.least("c", F.coalesce("h", "c")).alias("c"), F.coalesce("support", "s").alias("s"), F.col("c").alias("old"))
        state, met = kept.keep(merged, n=falls)
        fell = met["n"]
        if steps is not None:
            steps.append((how, fell))
    else:
        raise RuntimeError(f"the core numbers are not settled after {rounds} rounds")
    state = cut(state.select("id", "c"))
    adjacency.release()
    kept.release()
    return g.vertices.select("id").join(state, "id", "left").select("id", F.coalesce("c", F.lit(0)).alias("coreness"))


def coreness_total(g: Graph) -> DataFrame:
    """One row (total, largest): the sum and the largest of the core numbers."""
    return coreness(g).agg(F.coalesce(F.sum("coreness"), F.lit(0)).alias("total"), F.coalesce(F.max("coreness"), F.lit(0)).alias("largest"))


def bitmaps(edges: DataFrame) -> DataFrame:
    """(u, a, word, bits): of each vertex u the links among its neighbours, as bitmaps in words of 64.

    ``edges`` (u, w, dw) are oriented.  The neighbours of u are numbered from 0; the bitmap
    of number a has the numbers that a points to.  Words without a bit are not there.
    """
    met = _closed(_lists(edges)).select(F.col("x").alias("u"), F.col("at").alias("a"), "rest", F.explode("zs").alias("z"))
    found = met.select("u", "a", (F.col("a") + F.array_position("rest", F.col("z"))).alias("r"))
    bit = F.expr("shiftleft(1L, cast(r & 63 as int))")
    return found.groupBy("u", "a", F.shiftright("r", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def kclique(g: Graph, k: int) -> DataFrame:
    """One row (k, cliques) on the simple undirected graph: vertices for k = 1, edges for k = 2.

    A clique is found at its first vertex by the orientation, among whose neighbours
    bitmaps tell who may come next.  Those that may follow a smaller clique and its next
    member are the AND of two bitmaps, word by word, and the last member is only
    counted: no table has a row for each clique of k.
    """
    if k < 1:
        raise ValueError("k is 1 or more")
    if k == 1:
        return g.vertices.agg(F.lit(k).alias("k"), F.count(F.lit(1)).alias("cliques"))
    pairs = cut_table(g.simple_edges(), "pairs")
    if k == 2:
        return pairs.agg(F.lit(k).alias("k"), F.count(F.lit(1)).alias("cliques"))
    links = cut(bitmaps(oriented(pairs)))
    after, path = links, ["u", "a"]
    for size in range(3, k):
        last = f"p{size}"
        chosen = after.select(*path, F.explode(F.expr("filter(sequence(0, 63), b -> bit_get(bits, b) = 1)")).alias("b"), "word").select(*path, (F.col("word") * 64 + F.col("b")).alias(last))
        own = links.select(F.col("u").alias("x"), F.col("a").alias("y"), F.col("word").alias("z"), F.col("bits").alias("more"))
        both = chosen.join(after, path).join(own, (F.col("u") == F.col("x")) & (F.col(last) == F.col("y")) & (F.col("word") == F.col("z")))
        path = [*path, last]
        after = both.select(*path, "word", F.col("bits").bitwiseAND(F.col("more")).alias("bits")).where("bits <> 0")
        if size + 1 < k:
            after = cut(after)
    return after.agg(F.lit(k).alias("k"), F.coalesce(F.sum(F.bit_count("bits").cast("long")), F.lit(0)).alias("cliques"))
