"""Links contracted by each task, and batches of messages."""

import random

import numpy as np
import pytest

from graphloom.operators import components
from graphloom.streaming import batches


def plain(links):
    comp = {}
    for a, b in links:
        if a != b:
            comp.setdefault(a, a), comp.setdefault(b, b)
    for _ in range(len(comp)):
        before = dict(comp)
        for a, b in links:
            if a != b:
                comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == before:
            break
    return comp


def test_forest():
    r = np.random.default_rng(1)
    for n, m in ((1, 0), (2, 1), (50, 20), (50, 60), (300, 299)):
        a, b = r.integers(0, n, m), r.integers(0, n, m)
        root = components.forest(a, b, n)
        want = plain([*zip(a.tolist(), b.tolist(), strict=True)])
        assert root.tolist() == [want.get(i, i) for i in range(n)]
    chain = np.random.default_rng(2).permutation(1000)
    assert set(components.forest(chain[:-1], chain[1:], 1000).tolist()) == {0}


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("held", [7, 1000])
def test_contracted_links(spark, kind, held):
    """Fewer links than vertices leave a task, and the components are the same."""
    r = random.Random(3)
    name = (lambda x: x) if kind == "long" else str
    links = [(name(r.randrange(60)), name(r.randrange(60))) for _ in range(400)] + [(name(1), name(1)), (name(90), name(91)), (name(92), name(93)), (name(93), name(94))]
    df = spark.createDataFrame(links, f"a {kind}, b {kind}").repartition(3)
    few = components.contracted(df, held)
    if held == 1000:
        assert few.count() <= 3 * 64 < df.count()
    want = plain(links)
    assert {x["id"]: x["component"] for x in components.components(df, contract=0).collect()} == want
    assert {x["id"]: x["component"] for x in components.components(few).collect()} == want
    assert components.contracted(df.limit(0)).count() == 0


def test_cuts():
    assert batches.cuts([], 3, 10) == ([], (0, 0, 0))
    assert batches.cuts([0, 1, 2, 3, 4, 20, 31], 3, 10) == ([0, 0, 0, 1, 1, 1, 2], (2, 1, 31))
    assert batches.cuts([0, 11, 12, 23], 9, 10) == ([0, 0, 1, 1], (2, 0, 12))
    whole, _ = batches.cuts([*range(50)], 7, 5)
    state, parts = (0, 0, 0), []
    for k in range(0, 50, 9):
        found, state = batches.cuts([*range(k, min(50, k + 9))], 7, 5, state)
        parts += found
    assert parts == whole


def test_batches_do_not_depend_on_files(spark, tmp_path):
    """The same messages in one file and in many have the same batches; rows without a key are a stream of their own."""
    r = random.Random(5)
    rows = [(r.choice([1, 2, None]), i, 3 * i + r.randrange(3)) for i in range(90)]
    df = spark.createDataFrame(rows, "k long, i long, s long").selectExpr("k", "i", "timestamp_seconds(s) as t")
    got = []
    for n, files in enumerate(([(0, 90)], [(0, 20), (20, 21), (21, 70), (70, 90)])):
        folder = tmp_path / str(n)
        for a, b in files:
            df.where(f"i >= {a} and i < {b}").coalesce(1).write.mode("append").parquet(str(folder / "in"))
            cut = batches.numbered(spark.readStream.schema(df.schema).parquet(str(folder / "in")), "k", "t", "i", 4, 20_000_000)
            cut.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start().awaitTermination()
        got.append(sorted(map(tuple, spark.read.parquet(str(folder / "out")).collect()), key=str))
    want = []
    for k in (1, 2, None):
        own = [(i, s * 1_000_000) for key, i, s in rows if key == k]
        want += [(k, i, b) for (i, _), b in zip(own, batches.cuts([t for _, t in own], 4, 20_000_000)[0], strict=True)]
    assert got[0] == got[1] == sorted(want, key=str)
