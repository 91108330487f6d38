"""The operators in a local session without spark.checkpoint.dir, in a process of its own."""

import os
import subprocess
import sys
from pathlib import Path

CODE = """
import os, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
from tidemark.llm import exact_dedup, simhash
docs = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "c")], "doc_id long, text string")
assert sorted(r.keep_id for r in exact_dedup.dedup(docs).collect()) == [1, 1, 3]
assert simhash.keep_one(docs).count() == 2
"""


def test_a_session_without_the_setting_gets_a_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("SPARK_CONF_DIR", "PYSPARK_SUBMIT_ARGS")}
    env |= {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).resolve().parents[2])}
    done = subprocess.run([sys.executable, "-c", CODE], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
