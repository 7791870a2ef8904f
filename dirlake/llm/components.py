"""Connected components of a graph kept in DataFrames: distributed union-find by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written


def components(edges: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of each node of edges (a, b: long, not null).

    In each round every root hooks on to its smallest neighbour, takes that one's root, and edges inside a tree go. The
    tables of a round are written to the shared folder; the loop ends when no edge is left. Loops and repeated edges
    don't matter; without edges there are no rows.
    """
    found = None
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        hook = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("root")), "hooks")
        above = hook.select(F.col("id").alias("root"), F.col("root").alias("top"))
        hook = written(hook.join(above, "root").select("id", F.col("top").alias("root")), "roots", (hook,))
        if found is None:
            found = hook
        else:
            up = hook.select(F.col("id").alias("root"), F.col("root").alias("top"))
            found = written(found.join(up, "root", "left").select("id", F.coalesce("top", "root").alias("root")), "found", (found,))
        merged = edges
        for side in "ab":
            merged = merged.join(hook.select(F.col("id").alias(side), F.col("root").alias(f"root_{side}")), side)
        merged = merged.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).where("a <> b").distinct()
        edges = written(merged, "edges", (edges,) if hook is found else (edges, hook))
        if edges.isEmpty():
            return found.select("id", F.col("root").alias("component"))
