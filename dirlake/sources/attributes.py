"""Attribute rows (meta_id, owner, key, value) kept in buckets by owner, with gap-free meta_ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dirlake.operators.keys import with_keys
from dirlake.operators.meta import merge_rows, pivot

from .buckets import Buckets
from .shared import exists


@dataclass(frozen=True)
class Attributes:
    """A table of attribute rows at path. The last meta_id given out is kept beside it, so that a merge doesn't read all ids."""

    path: str
    owner: str = "entity_id"
    count: int = 256

    @property
    def buckets(self) -> Buckets:
        return Buckets(self.path, f"meta_id bigint, {self.owner} bigint, key string, value string", (self.owner,), self.count)

    def read(self, spark: SparkSession) -> DataFrame:
        return self.buckets.read(spark)

    def of(self, spark: SparkSession, owner: int, keys: list[str]) -> DataFrame:
        """One owner's attributes, wide; one folder is read."""
        return pivot(self.buckets.lookup(spark, owner), keys, self.owner)

    def create(self, meta: DataFrame) -> None:
        """Writes rows that have their meta_ids."""
        self.buckets.create(meta)
        self._reserve(meta.sparkSession, meta.agg(F.max("meta_id")).first()[0] or 0)

    def merge(self, patch: DataFrame, lists: tuple[str, ...] = ()) -> list[int]:
        """Writes patch (owner, key, value), one row for each owner and key, and returns the folders that changed.

        A null value leaves the row, or for the keys in lists deletes it. New rows get the next meta_ids in the order of owner and key;
        they are reserved before rows are written, so a run that is lost leaves a gap at most, never an id given twice.
        """

        def combine(rows: DataFrame, new: DataFrame) -> DataFrame:
            merged = merge_rows(rows, new, self.owner, lists)
            added = with_keys(merged.where("meta_id is null").drop("meta_id"), [self.owner, "key"], "meta_id", last := self._last(rows.sparkSession))
            self._reserve(rows.sparkSession, last + added.count())
            return merged.where("meta_id is not null").unionByName(added)

        return self.buckets.merge(patch, combine)

    def _last(self, spark: SparkSession) -> int:
        at = f"{self.path}-last"
        if exists(spark, at) and (row := spark.read.schema("last bigint").parquet(at).agg(F.max("last")).first())[0] is not None:
            return row[0]
        return self.read(spark).agg(F.max("meta_id")).first()[0] or 0

    def _reserve(self, spark: SparkSession, last: int) -> None:
        spark.range(1).select(F.lit(last).cast("bigint").alias("last")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}-last")
