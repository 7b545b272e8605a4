"""The folder that driver and executors share, and file system helpers for it."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a machine-local folder is made only where that is unset and the master is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop file system and path object of a path."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    return top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), top


def exists(spark: SparkSession, path: str) -> bool:
    fs, top = file_system(spark, path)
    return fs.exists(top)


def delete(spark: SparkSession, path: str) -> None:
    fs, top = file_system(spark, path)
    fs.delete(top, True)
