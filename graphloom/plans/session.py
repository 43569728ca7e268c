"""Lineage cuts that survive lost executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the cluster; on a single machine without it, a folder of our own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="graphloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Computes the frame once and keeps it in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at the path, on whatever file system it names."""
    fs, where = _path(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _path(spark, path)
    fs.delete(where, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers where they wouldn't find it by their path or folder."""
    package = Path(__file__).resolve().parent.parent
    seen = {os.path.abspath(p) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p}
    sc = spark.sparkContext
    if str(package.parent) in seen or getattr(sc, "_graphloom_shipped", False):
        return
    path = Path(sc._temp_dir, f"{package.name}.zip")  # the driver's own folder: Spark serves the file from there
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(path))
    sc._graphloom_shipped = True
