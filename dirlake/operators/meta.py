"""Attributes kept as rows (owner, key, value): reading them wide, and writing patches.

Each read is one shuffle on the owner whatever the number of attributes; each write is one join on the owner.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import with_keys


def pivot(meta: DataFrame, keys: list[str], owner: str = "entity_id") -> DataFrame:
    """One row for each owner with a column for each key: the value with the smallest meta_id, or null.

    A row without meta_id counts where there is none with one; of several such rows the least value does.
    """
    wanted = meta.where(F.col("key").isin(keys))
    place = F.struct(F.col("meta_id").isNull(), "meta_id", "value")
    return wanted.groupBy(owner).agg(*[F.min_by("value", F.when(F.col("key") == k, place)).alias(k) for k in keys])


def unpivot(wide: DataFrame, owner: str, keys: list[str]) -> DataFrame:
    """Rows (owner, key, value) of the attributes that aren't null."""
    return wide.unpivot(owner, keys, "key", "value").where("value is not null")


def attributes(entities: DataFrame, meta: DataFrame, keys: list[str], entity: str = "id", owner: str = "entity_id") -> DataFrame:
    """Entities with their attributes; all attributes are null where an entity has none."""
    wide = pivot(meta, keys, owner)
    return entities.join(wide.withColumnRenamed(owner, entity), entity, "left")


def upsert(base: DataFrame, patch: DataFrame, key: str, sparse: list[str] = (), flags: list[str] = (), lists: list[str] = ()) -> DataFrame:
    """base with the rows of patch (one for each key) written into it.

    sparse: a null in the patch leaves the value; flags: present is 1, absent 0; lists: the patch's value, null deletes.
    Rows without a patch stay as they are, keys that only the patch has are added.
    """
    patched = patch.select(key, *[F.col(c).alias(f"_{c}") for c in (*sparse, *flags, *lists)], F.lit(True).alias("_in_patch"))

    def value(c: str) -> Column:
        new = F.col(f"_{c}")
        if c in sparse:
            return F.coalesce(new, F.col(c))
        if c in flags:
            return F.when(F.col("_in_patch"), F.when(new.isNotNull(), 1).otherwise(0)).otherwise(F.col(c))
        if c in lists:
            return F.when(F.col("_in_patch"), new).otherwise(F.col(c))
        return F.col(c)

    return base.join(patched, key, "full").select(*[F.col(c) if c == key else value(c).alias(c) for c in base.columns])


def merge_rows(meta: DataFrame, patch: DataFrame, owner: str = "entity_id", lists: tuple[str, ...] = ()) -> DataFrame:
    """Attribute rows after writing patch (owner, key, value), new ones without a meta_id.

    A new value takes the place of the old row with the smallest meta_id; a null value leaves it, or for the keys in lists deletes all
    rows of the key.
    """
    new = patch.select(owner, "key", F.col("value").alias("_value"), F.lit(True).alias("_in_patch")).where(F.col("_value").isNotNull() | F.col("key").isin(*lists))
    first = F.row_number().over(Window.partitionBy(owner, "key").orderBy(F.col("meta_id").asc_nulls_last(), "value")) == 1
    out = meta.withColumn("_first", first).join(new, [owner, "key"], "full")
    out = out.where(F.col("_in_patch").isNull() | F.col("_value").isNotNull())
    value = F.when(F.coalesce("_first", F.lit(True)), F.coalesce("_value", "value")).otherwise(F.col("value"))
    return out.select("meta_id", owner, "key", value.alias("value"))


def upsert_rows(meta: DataFrame, patch: DataFrame, owner: str = "entity_id", lists: tuple[str, ...] = ()) -> DataFrame:
    """merge_rows, in which rows without a meta_id get the next ones above the largest, in the order of owner and key."""
    merged = merge_rows(meta, patch, owner, lists)
    last = meta.agg(F.max("meta_id")).first()[0] or 0
    added = with_keys(merged.where("meta_id is null").drop("meta_id"), [owner, "key"], "meta_id", last)
    return merged.where("meta_id is not null").unionByName(added)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
