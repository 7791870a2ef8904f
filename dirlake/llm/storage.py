"""Where jobs keep what they have to write: the shared folder named by spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset (tests on one machine), below a temporary folder that is then set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="dirlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, instead_of: tuple[DataFrame, ...] = ()) -> DataFrame:
    """The rows of df, written as a table in the shared folder and read again: cuts the lineage and survives lost executors.

    instead_of: tables from here that nothing reads any more once this one is there; their files are removed.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    for old in instead_of:
        at = spark._jvm.org.apache.hadoop.fs.Path(old._written_at)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return out


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like written, dealt to as many buckets as a shuffle has partitions: joins and groupings by key need no exchange."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, key).sortBy(key).option("path", path).option("compression", "zstd").saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # an external one: its files stay, and found knows the buckets
    return found
