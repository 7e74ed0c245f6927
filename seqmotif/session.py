"""Session plumbing: code shipping to workers and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders of local sessions, by application.
_LOCAL: dict[str, str | None] = {}
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package.

    Workers on this machine get the source folder on their path; a cluster
    additionally receives the package as an archive, once per application. The
    driver serves the archive from where it is, to executors that start late as
    well, so it stays until the driver ends.
    """
    sc = spark.sparkContext
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    if not sc.master.startswith("local") and not getattr(sc, "_seqmotif_shipped", False):
        tmp = tempfile.mkdtemp(prefix="seqmotif-")
        atexit.register(shutil.rmtree, tmp, ignore_errors=True)
        stage = os.path.join(tmp, "src")
        shutil.copytree(os.path.join(ROOT, "seqmotif"), os.path.join(stage, "seqmotif"), ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(os.path.join(tmp, "seqmotif_src"), "zip", stage))
        sc._seqmotif_shipped = True


def scratch(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; a
    cluster without it is an error, as executors could not see each other's files.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _LOCAL.setdefault(spark.sparkContext.applicationId, None) or "file://" + tempfile.mkdtemp(prefix="seqmotif-")
        _LOCAL[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there."""
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
