"""What a cluster needs that a local session does not."""

import os
import socket
import subprocess
import sys
import time
from types import SimpleNamespace

import pyspark
import pytest

import __spark_entry__
from seqmotif.session import ROOT, ship

SF = "/root/testdata/sf0.001"
DRIVER = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__
master, name, sf_dir, tmp = sys.argv[1:]
conf = {"spark.checkpoint.dir": f"file://{tmp}/shared", "spark.executor.memory": "1g", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.session.timeZone": "UTC"}
spark = SparkSession.builder.master(master).config(map=conf).getOrCreate()
__spark_entry__.queries()[name](spark, sf_dir).write.parquet(f"file://{tmp}/out")
spark.stop()
"""


def test_shipped_archive_stays(tmp_path):
    """The driver serves the archive to executors after ``ship`` is over."""
    sent = []
    sc = SimpleNamespace(master="spark://far:7077", environment={}, addPyFile=sent.append)
    for _ in range(2):
        ship(SimpleNamespace(sparkContext=sc))
    assert len(sent) == 1 and os.path.exists(sent[0])
    code = "import seqmotif.llm.jaccard as j; print(j.__file__)"
    out = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": sent[0]}, cwd=tmp_path, capture_output=True, text=True, check=True)
    assert out.stdout.startswith(sent[0]) and ROOT in sc.environment["PYTHONPATH"]


@pytest.fixture(scope="module")
def cluster(tmp_path_factory):
    """The address of a standalone master with one worker, each a process of its own."""
    home, tmp = os.path.dirname(pyspark.__file__), tmp_path_factory.mktemp("cluster")
    env = os.environ | {"SPARK_HOME": home, "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    kinds = (["master.Master", "--host", "127.0.0.1", "--port", str(port)], ["worker.Worker", "--host", "127.0.0.1", "-c", "2", "-m", "1g", "-d", str(tmp), f"spark://127.0.0.1:{port}"])
    with (tmp / "log").open("w") as log:
        running = []
        for kind, *args in kinds:
            running.append(subprocess.Popen([f"{home}/bin/spark-class", f"org.apache.spark.deploy.{kind}", "--webui-port", "0", *args], env=env, stdout=log, stderr=log))
            time.sleep(4)
        yield f"spark://127.0.0.1:{port}"
        for process in running:
            process.kill()
            process.wait()


@pytest.mark.parametrize("name", ["op2_exact_topk", "op6_ngram_jaccard_join", "op10_embedding_near_dedup"])
def test_cluster(spark, cluster, tmp_path, name):
    """A query on a cluster gives the rows of a local session."""
    env = os.environ | {"PYTHONPATH": ROOT, "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", DRIVER, cluster, name, SF, str(tmp_path)], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    got = spark.read.parquet(str(tmp_path / "out"))
    want = __spark_entry__.queries()[name](spark, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
