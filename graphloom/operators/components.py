"""Connected components of a link table, as rounds of joins and aggregations.

Each round alternates two steps: every vertex points its larger neighbours to
its smallest neighbour, then every vertex points its smaller neighbours to the
smallest of them.  The number of rounds grows with the logarithm of the longest
chain; the links shrink towards one star for each component, and a vertex of
high degree only ever emits as many rows as it has links.

Many links are contracted first: each task joins what its own links connect and passes
on one link for each vertex but the roots, so fewer rows than vertices leave it, however
many links it had.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.lineage import cut
from ..plans.rounds import Rounds


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(links: DataFrame) -> DataFrame:
    both = _both(links)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.where("b > a").join(least.withColumnRenamed("a", "v"), F.col("a") == F.col("v"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least.withColumnRenamed("a", "v"), F.col("a") == F.col("v"))
    moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


#: Links from which on they are contracted first, and links that a task contracts at a time.
CONTRACTED, HELD = 20_000_000, 4_000_000


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The root of each of the vertices 0 to n - 1 under the links (a, b): the smallest vertex of its component."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low < high
        if not open_.any():
            return root
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root = root[root]


def contracted(links: DataFrame, held: int = HELD) -> DataFrame:
    """Links (a, b) that connect the same vertices: of every task's ``held`` links at a time a forest of stars, and these again with the next."""
    kind = links.schema["a"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def stars() -> pa.Table:
            table = pa.Table.from_batches(rows)
            both = pa.concat_arrays([c for name in ("a", "b") for c in table.column(name).chunks]).dictionary_encode()
            codes, n = both.indices.to_numpy(), len(both.dictionary)
            root = forest(codes[: len(codes) // 2], codes[len(codes) // 2 :], n)
            own = np.flatnonzero(root != np.arange(n))
            return pa.table({"a": both.dictionary.take(pa.array(own)), "b": both.dictionary.take(pa.array(root[own]))})

        for batch in batches:
            rows.append(batch)
            size += batch.num_rows
            if size >= held:
                kept = stars()
                rows[:], size = kept.to_batches(), kept.num_rows
                if size > held // 2:  # of mostly different vertices: little to gain
                    yield from rows
                    rows.clear()
                    size = 0
        if rows:
            yield from stars().to_batches()

    return links.select("a", "b").where("a <> b").mapInArrow(work, f"a {kind}, b {kind}")


def _kept(kept: Rounds, links: DataFrame) -> tuple[DataFrame, tuple]:
    """The links, computed once, and how many they are with a sum of their hashes, to tell two rounds apart."""
    out, met = kept.keep(links, n=F.count(F.lit(1)), x=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    return out, (met["n"], met["x"])


def components(links: DataFrame, rounds: int = 64, contract: int = CONTRACTED) -> DataFrame:
    """(id, component): the smallest id of each vertex's component; links are (a, b).

    Self-links are left out, so a vertex without any other link gives no row.  From
    ``contract`` links on, each task contracts its own before the rounds.
    """
    kept = Rounds()
    down = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, state = _kept(kept, down(links))
    if state[0] and state[0] >= contract:
        now, state = _kept(kept, down(contracted(now)))
    before = None
    for _ in range(rounds):
        if state == before or state[0] == 0:
            break
        before = state
        now, state = _kept(kept, _small(_large(now)))
    else:
        raise RuntimeError(f"the components are not settled after {rounds} rounds")
    now = cut(now)
    kept.release()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def wcc(g: Graph) -> DataFrame:
    """(id, comp): the smallest id of the weakly connected component; directions don't matter."""
    found = components(g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return g.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("comp"))
