"""The contract of the entry module in a checkout without the corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as entry
from pyspark.sql import SparkSession

names = set(entry.queries())
assert "bfs_dense" in names and not any(n.startswith("op") or n == "pipeline" for n in names), names
assert set(entry.oracle_sql()) <= names
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert entry.queries()["counts_dense"](spark, "/root/testdata/sf0.001").count() == 1
assert entry.entry(spark).columns == ["id", "depth"]
"""


def test_without_the_corpus_operators(tmp_path):
    for pipeline in (True, False):
        own = tmp_path / str(pipeline)
        shutil.copytree(f"{ROOT}/graphloom", own / "graphloom", ignore=lambda d, names: ["llm"] if d.endswith("graphloom") else [n for n in names if n == "__pycache__"])
        for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and os.path.exists(f"{ROOT}/corpus_pipeline.py") else [])]:
            shutil.copy(f"{ROOT}/{name}", own / name)
        code = CODE if pipeline else CODE.partition("spark = ")[0]
        done = subprocess.run([sys.executable, "-c", code], cwd=own, env=os.environ | {"PYTHONPATH": str(own)}, capture_output=True, text=True, timeout=300, check=False)
        assert done.returncode == 0, done.stderr[-2000:]
