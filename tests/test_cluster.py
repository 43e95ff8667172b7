"""A session of its own, started elsewhere and without the package on its path."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
sys.path.insert(0, sys.argv[1])
from moundworks.operators import generation
df = spark.createDataFrame([(1, "a")], "n int, prompt string")
from moundworks.functions import rules
def writer(prompts):
    from moundworks.constants import TIERS  # imported in the worker
    return prompts.str.upper() + str(len(TIERS))
print("GOT", generation.generate(df, writer).first().response)
"""


def test_workers_get_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT, ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "GOT A5" in out.stdout, out.stderr[-2000:]
