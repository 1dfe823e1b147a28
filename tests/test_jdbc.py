"""The embedded database: its archive is read by executors of their own processes; the sink in local mode."""

import os
import subprocess
import sys
import tempfile
from pathlib import Path

from umbra.sources import io

REPO = Path(__file__).resolve().parents[1]
CLUSTER = """
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "700m").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", "file://{at}").getOrCreate())
from umbra.plans import registry
print("got", sorted(tuple(r) for r in registry.queries()["a2_jdbc_scan"](spark, "/root/testdata/sf0.001").collect()))
spark.stop()
"""


def test_executors_in_processes_of_their_own_read_the_table():
    with tempfile.TemporaryDirectory() as at:
        env = os.environ | {"PYTHONPATH": f"{REPO}:{os.environ.get('PYTHONPATH', '')}"}
        done = subprocess.run([sys.executable, "-c", CLUSTER.format(at=at)], cwd=at, env=env, capture_output=True, text=True, timeout=240)
    assert "got [(0, 'AFRICA'), (1, 'AMERICA'), (2, 'ASIA'), (3, 'EUROPE'), (4, 'MIDDLE EAST')]" in done.stdout, done.stderr[-2000:]


def test_odd_values_survive(spark):
    rows = [(1, None), (2, ""), (3, ' a "b", \n\\ c '), (None, "é—\U0001f600"), (5, "x,y"), (6, '"')]
    df = spark.createDataFrame(rows, "k int, s string").repartition(3)
    for made in (df, df.limit(0)):
        got = [tuple(r) for r in io.read_as(spark, "jdbc", **io.database(made, "ODD")).collect()]
        assert sorted(got, key=repr) == sorted(map(tuple, made.collect()), key=repr)


def test_sink(spark):
    url = {"url": "jdbc:derby:memory:sink;create=true", "dbtable": "T", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    io.release(spark.range(5), "", "jdbc", mode="overwrite", **url)
    assert sorted(r["id"] for r in io.read_as(spark, "jdbc", **url).collect()) == list(range(5))
