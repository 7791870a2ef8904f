"""Tables of entities laid out for reading few of them: one by id or slug, or a page in the order of date.

A table for single nodes is bucketed by id, so an id's bucket is all that is read; row groups carry Bloom filters of the
slugs. A table for pages is sorted by range into slices; an index has a row with the bounds of each slice, so a page reads the
slices that it lies in, however many there are.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_nodes(entities: DataFrame, table: str, buckets: int = 256, path: str | None = None, row_group_bytes: int | None = None) -> None:
    """Writes entities (id, slug, ...) as a catalogue table; listing.node() reads one of them."""
    writer = entities.repartition(buckets, "id").write.mode("overwrite").bucketBy(buckets, "id").sortBy("id")
    writer = writer.option("parquet.bloom.filter.enabled#slug", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def cursor(date: Column, key: Column) -> Column:
    """An opaque text for a place in a list."""
    return F.base64(F.to_json(F.array(date.cast("string"), key.cast("string")), {"ignoreNullFields": "false"}).cast("binary"))


def place(text: str, schema) -> Column:
    """The place that cursor() made a text for."""
    date, key = json.loads(base64.b64decode(text))
    return F.struct(F.lit(date).cast(schema[0].dataType), F.lit(key).cast(schema[1].dataType))


@dataclass(frozen=True)
class Pages:
    """Entities at path, newest first, ties by the larger key; those without a date come last."""

    path: str
    date: str = "date"
    key: str = "id"

    @property
    def order(self) -> list[Column]:
        return [F.col(self.date).desc_nulls_last(), F.col(self.key).desc_nulls_last()]

    def create(self, entities: DataFrame, slices: int) -> None:
        rows = entities.repartitionByRange(slices, *self.order).sortWithinPartitions(*self.order).withColumn("slice", F.spark_partition_id())
        rows.write.mode("overwrite").partitionBy("slice").parquet(f"{self.path}/rows")
        at = F.struct(self.date, self.key)
        written = entities.sparkSession.read.schema(rows.schema).parquet(f"{self.path}/rows")
        written.groupBy("slice").agg(F.max(at).alias("first"), F.min(at).alias("last"), F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/index")

    def slices(self, spark: SparkSession, size: int, at: Column | None, backward: bool) -> list[int]:
        """The slices that size rows behind a place are in. Each has a row, so size + 1 rows of the index are enough."""
        index = spark.read.parquet(f"{self.path}/index")
        if at is not None:
            index = index.where(F.col("first") > at if backward else F.col("last") < at)
            whole = (F.col("last") > at) if backward else (F.col("first") < at)
        else:
            whole = F.lit(True)
        index = index.select("slice", F.when(whole, F.col("n")).otherwise(1).alias("n"))  # at least one of a slice that is cut
        found, rows = [], 0
        for r in index.orderBy(F.col("slice").desc() if backward else F.col("slice")).limit(size + 1).collect():
            if rows >= size:
                break
            found.append(r.slice)
            rows += r.n
        return found

    def page(self, spark: SparkSession, first: int | None = None, after: str | None = None, last: int | None = None, before: str | None = None) -> DataFrame:
        """The first rows after a cursor, or the last ones before one, newest first, with cursor and has_more.

        has_more: whether there are more rows in the direction read. Without a cursor reading begins at the list's end.
        """
        if (first is None) == (last is None) or (first is not None and before) or (last is not None and after):
            raise ValueError("a page has first (and after) or last (and before)")
        backward, size, text = first is None, first or last, before if first is None else after
        schema = spark.read.parquet(f"{self.path}/index").schema["first"].dataType
        at = place(text, schema.fields) if text else None
        chosen = self.slices(spark, size + 1, at, backward)
        folders = [f"{self.path}/rows/slice={k}" for k in chosen]
        if not folders:
            rows = spark.read.parquet(f"{self.path}/rows").limit(0)
        else:
            rows = spark.read.option("basePath", f"{self.path}/rows").parquet(*folders)
        here = F.struct(self.date, self.key)
        if at is not None:
            rows = rows.where(here > at if backward else here < at)
        order = [F.col(self.date).asc_nulls_first(), F.col(self.key).asc_nulls_first()] if backward else self.order
        rows = rows.drop("slice").orderBy(*order).limit(size + 1)
        n = F.row_number().over(Window.orderBy(*order))  # over size + 1 rows
        rows = rows.withColumn("_n", n).withColumn("has_more", F.count("*").over(Window.partitionBy()) > size).where(F.col("_n") <= size).drop("_n")
        return rows.withColumn("cursor", cursor(F.col(self.date), F.col(self.key))).orderBy(*self.order)
