import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {scratch!r}).getOrCreate()
print("ROWS", entry.queries()["first_bytes"](spark, "/root/testdata/sf0.001").count())
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    environment = {name: value for name, value in os.environ.items() if name != "PYTHONPATH"}
    code = RUN.format(repo=REPO, scratch=str(tmp_path / "scratch"))
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300)
    assert "ROWS " in done.stdout, done.stderr[-2000:]
