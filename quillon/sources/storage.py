"""Paths on any file system that Spark knows, and a shared place for derived tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, a temporary one in local mode (tests), an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and the executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="quillon-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def read_text(spark: SparkSession, path: str) -> list[str]:
    """The lines of a small text file."""
    return [r.value for r in spark.read.text(path).collect()]
