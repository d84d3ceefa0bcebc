"""The contract loads in a fresh process that has no session yet."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]

LOAD = """
import __spark_entry__ as contract
from pyspark import SparkContext
queries, sql = contract.queries(), contract.oracle_sql()
assert SparkContext._active_spark_context is None
assert len(queries) >= 80 and set(sql) <= set(queries)
"""

RUN = """
from pyspark.sql import SparkSession
import __spark_entry__ as contract
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
spark.conf.set("spark.sql.shuffle.partitions", "2")
for name in ("naive_chunk", "count_rows", "hash_embedding"):
    assert contract.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
"""


def run(code):
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_loads_without_a_session():
    run(LOAD)


def test_runs_in_a_plain_session():
    run(RUN)
