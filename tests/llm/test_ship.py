import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from weftline.llm import simhash, urls
assert urls.judge_urls(s.createDataFrame([(1, "http://a.org/x")], "page_id bigint, url string")).first().verdict == "allow"
assert simhash.near_duplicates(s.createDataFrame([(1, "a b c d")], "doc_id bigint, text string")).count() == 1
"""


def test_workers_get_the_package_wherever_the_driver_runs(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith("PYSPARK_") and k != "SPARK_ENV_LOADED"}
    subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, check=True, env=env, timeout=180)
