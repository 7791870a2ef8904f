"""Terms as intervals: below a term is a range of numbers, so subtrees need no walk by levels.

Terms are numbered in the order of a walk from the roots, children by name; a term's interval runs from its own number to
that of its last descendant. Sizes of subtrees and places are found by doubling distances up the tree: each
doubling is one grouping and one join, and there are about as many as the depth has binary digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirlake.sources.shared import cut

from .keys import running_sum


def _doubled(state: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """state (term_id, up, ...) folded over all distances up the tree. up is the ancestor at the distance reached so far,
    null beyond the root; sums are the columns' new values from own ones and those of up (with _). Terms in cycles, and
    below them, never reach a root: once no other term is left they go."""
    open_before = None
    while True:
        state = cut(state, "doubling")
        still_open = state.where("up is not null").count()
        if still_open in (0, open_before):
            return state.where("up is null").drop("up")
        open_before = still_open
        above = state.select([F.col(c).alias(f"_{c}") for c in state.columns])
        met = state.join(above, F.col("up") == F.col("_term_id"), "left")
        kept = [c for c in state.columns if c not in sums and c != "up"]
        state = met.select(*kept, F.col("_up").alias("up"), *[c.alias(n) for n, c in sums.items()])


def sizes(terms: DataFrame) -> DataFrame:
    """term_id and size (itself and all descendants) of each term (term_id, up); terms in cycles and below them have sizes of no meaning."""
    state = terms.withColumn("size", F.lit(1).cast("long"))
    open_before = None
    while True:
        state = cut(state, "sizes")
        still_open = state.where("up is not null").count()
        if still_open in (0, open_before):
            return state.drop("up")
        open_before = still_open
        below = state.where("up is not null").groupBy(F.col("up").alias("_of")).agg(F.sum("size").alias("_more"))
        above = state.select(F.col("term_id").alias("_id"), F.col("up").alias("_up"))
        state = state.join(below, F.col("term_id") == F.col("_of"), "left").join(above, F.col("up") == F.col("_id"), "left")
        state = state.select("term_id", F.col("_up").alias("up"), (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size"))


def intervals(terms: DataFrame) -> DataFrame:
    """term_id, parent, low, high, depth of terms (term_id, name, parent): descendants are those with low in (low, high].

    Numbers begin at 1; children go by name (null first), then term_id. A term whose parent is missing is a root; terms in
    a cycle, or below one, have none.
    """
    known = terms.select(F.col("term_id").alias("_id"))
    tree = terms.select("term_id", "name", "parent").join(known, F.col("parent") == F.col("_id"), "left").withColumnRenamed("_id", "up")
    tree = tree.join(sizes(tree.select("term_id", "up")), "term_id")
    placed = running_sum(tree, ["up", "name", "term_id"], "size", "earlier")
    first = placed.groupBy(F.col("up").alias("_of")).agg(F.min("earlier").alias("_first"))
    step = placed.join(first, F.col("up").eqNullSafe(F.col("_of"))).select("term_id", "up", "size", "parent", (F.col("earlier") - F.col("_first") + 1).alias("low"), F.lit(0).cast("long").alias("depth"))
    added = {"low": F.col("low") + F.coalesce("_low", F.lit(0)), "depth": F.when(F.col("up").isNull(), F.col("depth")).otherwise(F.col("depth") + F.col("_depth") + 1)}
    out = _doubled(step, added)
    return out.select("term_id", "parent", "low", (F.col("low") + F.col("size") - 1).alias("high"), "depth")


def below(labels: DataFrame, term: object, itself: bool = True) -> DataFrame:
    """The terms in the subtree of one, from intervals(): a range of low, which a table sorted by low reads in part."""
    own = labels.where(F.col("term_id") == term).select("low", "high").first()
    if own is None:
        return labels.limit(0)
    return labels.where(F.col("low").between(own.low if itself else own.low + 1, own.high))


def entities_below(labels: DataFrame, links: DataFrame, term: object) -> DataFrame:
    """entity_id of the entities linked to a term or one below it, each once."""
    return links.join(below(labels, term).select("term_id"), "term_id").select("entity_id").distinct()


def subtree_counts(labels: DataFrame, links: DataFrame) -> DataFrame:
    """term_id, n_terms and n_links of each subtree: terms below it, and links (entity_id, term_id) to it or to a term below.

    Links are summed along low; a subtree's sum is the difference of two running sums, so no term meets its descendants.
    """
    own = labels.join(links.groupBy("term_id").agg(F.count("*").alias("n")), "term_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = cut(running_sum(own, ["low"], "n", "before"), "sums")
    ends = sums.select(F.col("low").alias("high"), (F.col("before") + F.col("n")).alias("until"))
    return sums.join(ends, "high").select("term_id", (F.col("high") - F.col("low")).alias("n_terms"), (F.col("until") - F.col("before")).alias("n_links"))
