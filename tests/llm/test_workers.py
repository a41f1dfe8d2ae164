"""The queries of the operators where the workers cannot import the package."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent.parent
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", "file://{home}/shared").getOrCreate())
spark.sparkContext.setLogLevel("OFF")

def importable(_):
    import importlib.util
    return importlib.util.find_spec("ponding") is not None

assert not spark.sparkContext.parallelize([0], 1).map(importable).first()
import __spark_entry__
for name, query in sorted(__spark_entry__.queries().items()):
    if name.startswith("op") and name[2].isdigit():
        # The smallest table has 200 documents, but 87 turns of conversations.
        assert query(spark, "/root/testdata/sf0.001").count() >= (50 if name.startswith("op12_") else 200), name
print("done")
"""


def test_workers_need_no_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT), home=tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert ran.stdout.strip().endswith("done"), ran.stderr[-3000:]
