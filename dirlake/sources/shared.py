"""Intermediate tables in the shared folder named by spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder.

    Where none is set, a temporary folder serves a session on one machine (tests); on a cluster that would be a folder
    that others don't see, so it raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="dirlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def drop(df: DataFrame) -> None:
    """Removes the files of what cut() returned, once nothing reads them any more."""
    delete(df.sparkSession, df._cut_at)


def _path(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _path(spark, path)
    return files.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a file or folder by Hadoop's file systems; one that isn't there is no error."""
    at, files = _path(spark, path)
    files.delete(at, True)
