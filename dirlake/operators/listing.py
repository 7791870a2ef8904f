"""Lists of entities: recent ones, pages, ordered look-ups, connections, numbered batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import with_keys

#: Rows of a task, about, where rows are dealt out by a key.
ROWS = 1 << 17


def recent(entities: DataFrame, date: str, key: str, limit: int = 50) -> DataFrame:
    """The newest entities, ties by the larger key."""
    return entities.orderBy(F.col(date).desc(), F.col(key).desc()).limit(limit)


def page(entities: DataFrame, date: str, key: str, size: int, after: tuple[Column, Column] | None = None) -> DataFrame:
    """A page in the order of recent(), after the row with the given date and key; no page is counted through."""
    if after:
        d, k = after
        entities = entities.where((F.col(date) < d) | ((F.col(date) == d) & (F.col(key) < k)))
    return recent(entities, date, key, size)


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt out by key to tasks of about ROWS rows, so that what a task sorts or groups by it doesn't grow with the table."""
    return rows.repartition(max(1, -(-rows.count() // ROWS)), key)


def ordered_lookup(lists: DataFrame, owner: str, ids: str, targets: DataFrame, target: str) -> DataFrame:
    """owner, pos and the target's columns for each id in an array; of repeated ids the first place counts.

    lists has one row an owner. Repeats are found within the array, so a task holds one list, not a table of all places.
    """
    sorted_places = F.array_sort(F.transform(ids, lambda x, i: F.struct(x.alias("id"), i.alias("pos"))))
    firsts = F.transform(F.array(sorted_places), lambda x: F.filter(x, lambda e, i: (i == 0) | ~e["id"].eqNullSafe(F.get(x, i - 1)["id"])))[0]  # the outer array: x is made once
    places = lists.select(owner, F.inline(firsts).alias(target, "pos"))
    return places.join(targets, target).select(owner, "pos", *targets.columns)


def connection(entities: DataFrame, links: DataFrame, terms: DataFrame, taxonomy: str) -> DataFrame:
    """Pairs of entity and term of a taxonomy, with the columns of both."""
    return links.where(F.col("taxonomy") == taxonomy).join(terms.drop("taxonomy"), "term_id").join(entities.withColumnRenamed("id", "entity_id"), "entity_id")


def node(entities: DataFrame, key: str, value: Column) -> DataFrame:
    """The entity whose id, or slug, has the value; of several the one with the smallest id. No row for a null value."""
    return entities.where(F.col(key) == value).orderBy("id").limit(1)


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with n: their number from 0 in the order of a key without ties; no task gets all rows."""
    return with_keys(rows, [key], "n", -1)


def batches(rows: DataFrame, key: str, size: int = 50) -> DataFrame:
    """rows with batch: fixed-size batches in the order of key."""
    return numbered(rows, key).withColumn("batch", F.floor(F.col("n") / size).cast("long")).drop("n")
