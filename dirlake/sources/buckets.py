"""Tables in folders by a hash of their key: a patch reads and rewrites only the folders that hold its keys."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import cut, delete, drop, exists

Combine = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Buckets:
    """A Parquet table at path whose rows lie in count folders, by the hash of the key columns.

    A merge replaces the folders it touches when its job commits, by dynamic partition overwrite. A run that is lost before leaves the
    table as it was, one that is lost while folders are moved may leave some of them new; the same merge run again mends
    that, so the combining function must give the same rows for a patch that is there already.
    """

    path: str
    schema: str
    key: tuple[str, ...]
    count: int = 256

    @property
    def columns(self) -> list[str]:
        return StructType.fromDDL(self.schema).names

    def bucket(self, *key: Column) -> Column:
        return F.pmod(F.xxhash64(*(key or [F.col(c) for c in self.key])), F.lit(self.count)).cast("int")

    def read(self, spark: SparkSession, folders: list[int] | None = None) -> DataFrame:
        """All rows, or those of some folders."""
        rows = spark.read.schema(f"{self.schema}, bucket int").parquet(self.path)
        return (rows if folders is None else rows.where(F.col("bucket").isin(folders))).drop("bucket")

    def lookup(self, spark: SparkSession, *key: object) -> DataFrame:
        """The rows of one key; one folder is read."""
        kinds = {f.name: f.dataType for f in StructType.fromDDL(self.schema).fields}
        values = [F.lit(v).cast(kinds[c]) for c, v in zip(self.key, key, strict=True)]
        rows = spark.read.schema(f"{self.schema}, bucket int").parquet(self.path)
        for c, v in zip(self.key, values, strict=True):
            rows = rows.where(F.col(c) == v)
        return rows.where(F.col("bucket") == self.bucket(*values)).drop("bucket")

    def create(self, rows: DataFrame) -> None:
        self._write(rows)

    def merge(self, patch: DataFrame, combine: Combine) -> list[int]:
        """Writes combine(rows, patch) into the folders of the patch's keys, and returns their numbers, at most count."""
        patch = cut(patch.withColumn("bucket", self.bucket()), "patch")
        touched = sorted(r.bucket for r in patch.select("bucket").distinct().collect())
        if touched:
            old = self.read(spark := patch.sparkSession, touched)
            before = old.inputFiles()
            self._write(combine(old, patch.drop("bucket")))
            for k in touched:
                if any(f"/bucket={k}/" in f and exists(spark, f) for f in before):  # nothing took their place: no row is left
                    delete(spark, f"{self.path}/bucket={k}")
        drop(patch)
        return touched

    def _write(self, rows: DataFrame) -> None:
        """Replaces the folders that rows belong to; a folder of very many rows is written by several tasks."""
        out = rows.select(*self.columns).withColumn("bucket", self.bucket()).hint("rebalance", "bucket")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
