import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_stands_without_the_optional_parts(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "spark-warehouse", "__pycache__"))
    code = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
q = e.queries()
assert q and set(e.oracle_sql()) <= set(q) and not any(n.startswith("op") for n in q) and "pipeline" not in q
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
assert e.entry(spark).count() > 0 and q["box_overlap_join"](spark, e.SMOKE_DIR).count() > 0
"""
    env = os.environ | {"PYTHONPATH": ""}
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True, timeout=120)
