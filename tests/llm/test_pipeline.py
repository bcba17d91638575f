"""The pipeline against its stages in plain Python, and the registered queries."""

import __spark_entry__ as entry
import corpus_pipeline
from graphloom.llm import simhash
from graphloom.llm.quality import base
from tests.llm.test_duplicates import plain_hits, plain_lines

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    first = corpus_pipeline.quality_rules(spark, docs, SF)
    rows = {r["doc_id"]: r["text"] for r in first.collect()}
    for r in docs.collect():
        n, _, _, _, repeats = base(r["text"])
        if n < 20 or 100 * repeats > 30 * n:
            assert r["doc_id"] not in rows
    second = corpus_pipeline.dedup_lines(spark, first, SF)
    lines = dict(plain_lines(sorted(rows.items())))
    assert {r["doc_id"]: r["text"] for r in second.collect()} == lines and second.columns == docs.columns
    third = corpus_pipeline.near_dedup(spark, second, SF)
    prints = {i: simhash.fingerprint(t) for i, t in lines.items()}
    root = {i: i for i in prints}
    for _ in range(3):
        for i, x in prints.items():
            for j, y in prints.items():
                if ((x ^ y) % (1 << 64)).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    kept = set(root.values())
    assert {r["doc_id"] for r in third.collect()} == kept and third.columns == docs.columns
    clean = {i for i in kept if not plain_hits(lines[i], items)[4]}
    fourth = corpus_pipeline.decontaminated(spark, third, SF)
    assert {r["doc_id"] for r in fourth.collect()} == clean and fourth.columns == docs.columns
    last = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in last} == clean and all(r["round_trip"] for r in last)


def test_registered():
    names = list(entry.queries())
    assert [n for n in names if n.startswith("op")] and "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
    assert set(entry.oracle_sql()) <= set(names)
