"""The index of neighbours that batches add to."""

import os
import random

import pytest

from graphloom.operators.neighbour_index import NeighbourIndex
from graphloom.streaming import sampler

EDGES = "src long, dst long, weight double"


def size(paths):
    return sum(os.path.getsize(os.path.join(p, f)) for p in paths for f in os.listdir(p) if f.endswith(".parquet"))


def test_batches_equal_the_whole(spark, tmp_path):
    """Later weights replace earlier ones, before and after buckets are written anew; a batch that runs again changes nothing."""
    r = random.Random(2)
    index = NeighbourIndex(spark, str(tmp_path / "i"), buckets=4, deltas=2)
    want, ends = {}, set()
    for batch in range(6):
        rows = [(r.randrange(30), r.randrange(30), float(r.randrange(100))) for _ in range(25)]
        for s, d, w in sorted(rows):
            want[s, d] = (w, batch)
        ends |= {x for s, d, _ in rows for x in (s, d)}
        for _ in range(2 if batch in (1, 4) else 1):
            index.append(spark.createDataFrame(rows, EDGES), batch)
        again = NeighbourIndex(spark, index.path, 4, 2)
        again.live = index.live
        found = {}
        for x in again.edges(spark.range(40).withColumnRenamed("id", "at")).collect():
            key = x["src"], x["dst"]
            found[key] = max(found.get(key, (-1, -1.0)), (x["batch"], x["weight"]))
        assert {k: (w, b) for k, (b, w) in found.items()} == want
        assert {x["src"] for x in again.of(spark.range(40).withColumnRenamed("id", "at")).collect()} == ends
        assert all(len(parts) <= 2 for parts in index.live.values())


def test_what_is_read_does_not_grow(spark, tmp_path):
    """Batches about other vertices, or again about the same edges, leave what one vertex costs as it is."""
    index = NeighbourIndex(spark, str(tmp_path / "i"), buckets=64, deltas=3)
    index.append(spark.createDataFrame([(1, d, 1.0) for d in range(2, 40)], EDGES), 0)
    one = spark.createDataFrame([(1,)], "at long")
    assert index.edges(one).count() == 38
    first, buckets = size(index.opened), {p.rsplit("=")[-1] for p in index.opened}
    assert len(buckets) == 1
    for batch in range(1, 10):
        index.append(spark.createDataFrame([(1000 + s, 5000 + d, float(batch)) for s in range(30) for d in range(20)] + [(1, 2, float(batch))], EDGES), batch)
    found = index.edges(one).collect()
    assert max((x["batch"], x["weight"]) for x in found if x["dst"] == 2) == (9, 9.0) and {x["dst"] for x in found} == set(range(2, 40))
    assert {p.rsplit("=")[-1] for p in index.opened} == buckets and len(index.opened) <= 3
    everything = [d for d, _, files in os.walk(tmp_path / "i" / "rows") if any(f.endswith(".parquet") for f in files)]
    assert size(index.opened) < 4 * first and size(everything) > 5 * size(index.opened)


@pytest.mark.parametrize("directed", [True, False])
def test_three_batches_of_a_stream(spark, tmp_path, directed):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("e 1 2 5\ne 1 3 4\ne 2 9 1\nq 1\nq 77\nq 9\n")
    run = lambda: sampler.run(spark, str(source), str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "cp"), [2, 1], "top_k", directed=directed, buckets=8).awaitTermination()
    run()
    answers = lambda b: sorted(x["value"] for x in spark.read.text(f"{tmp_path}/out/batch={b}").collect())
    assert answers(0) == (["1 2 3 9 -", "9 - - - -"] if directed else ["1 2 3 1 1", "9 2 2 1 1"])
    (source / "b.txt").write_text("e 1 3 9\nq 1\n")
    run()
    assert answers(1) == (["1 3 2 - 9"] if directed else ["1 3 2 1 1"])
    (source / "c.txt").write_text("q 1\ne 1 2 10\ne 3 4 1\ne 1 2 8\n")
    run()
    assert answers(2) == (["1 2 3 9 4"] if directed else ["1 2 3 1 1"])
