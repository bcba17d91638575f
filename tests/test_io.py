"""Files, stored graphs and the streaming sampler."""

from graphloom.operators import access, traversal
from graphloom.sources import stored, text
from graphloom.streaming import sampler


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_load(spark, tmp_path):
    e = write(tmp_path / "e", "# comment", "1 2 3.5", "", "2\t3\t1", "3 x 1", "3 9 1", "1 3")
    v = write(tmp_path / "v", "1 7", "2 8", "3 9")
    g = text.load(spark, e, v, directed=True, data_type="long")
    assert sorted(map(tuple, g.edges.collect())) == [(1, 2, 3.5), (2, 3, 1.0)]
    assert sorted(map(tuple, g.vertices.collect())) == [(1, 7), (2, 8), (3, 9)]
    assert text.load(spark, e, unknown="add").vertices.count() == 4
    d = write(tmp_path / "d", "a 1 3 2", "d 1 2", "u 2 3 9", "x 1 1 1")
    changed = text.load_changed(spark, e, v, d, directed=True)
    assert sorted(map(tuple, changed.edges.collect())) == [(1, 3, 2.0), (2, 3, 9.0)]
    assert text.load_numbered(spark, e, 4).vertices.count() == 4


def test_results(spark, tmp_path):
    g = text.load(spark, write(tmp_path / "e", "1 2 0.1", "3 3 1"))
    text.write_result(traversal.sssp(g, 1), str(tmp_path / "out"))
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert lines == ["1 0.000000000000000e+00", "2 1.000000000000000e-01", "3 infinity"]
    assert {r["id"]: r["value"] for r in text.read_result(spark, str(tmp_path / "out")).collect()} == {1: 0.0, 2: 0.1, 3: float("inf")}


def test_stored(spark, tmp_path):
    g = text.load(spark, write(tmp_path / "e", "1 2 0.1"))
    path = str(tmp_path / "g")
    assert stored.load(spark, path, "s") is None
    assert stored.cached(spark, path, "s", lambda: g).edges.count() == 1
    assert stored.load(spark, path, "other") is None
    assert access.counts(stored.load(spark, path, "s")).first()["edges"] == 1
    assert stored.signature(a=1) != stored.signature(a=2)


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source / "a.txt", "# first", "e 1 2 5", "e 1 3 4", "q 1", "q 99", "junk")
    run = lambda: sampler.run(spark, str(source), str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "cp"), [2], "top_k").awaitTermination()
    run()
    answers = lambda: sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).select("value").collect())
    assert answers() == ["1 2 3"]
    write(source / "b.txt", "q 1", "e 1 3 9", "e 1 4 7")
    run()
    assert answers() == ["1 2 3", "1 3 4"]
