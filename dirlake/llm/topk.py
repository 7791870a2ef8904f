"""Operator 12: exact top-k search by inner product, term at a time.

A component is a term. Candidates are kept in blocks as postings: for each term the places of the vectors that have it
and their weights; a term that most vectors of a block have is kept as one array over all places. A query is a sparse
row of terms and weights. Each of its terms scatters its weighted postings into the query's dense array of scores over
the block; nothing is skipped. Of the scores a partition selection keeps the k best, which are merged with those so far.

Queries are dealt to groups of at most `group_rows`, candidates to blocks of `block_rows`. A cell is a group of queries
and a stripe of the blocks: its task holds the group's queries and their k best, and blocks stream past. What cells found is
merged by query, k rows from each.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vectors import dense, integers, usable

#: Candidates of a block, queries of a group, and queries whose scores are held at once.
BLOCK_ROWS, GROUP_ROWS, AT_ONCE = 8192, 16384, 16
FOUND = "q long, query_id long, vec_id long, score long"
FOUND_ARROW = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as f:
        return dict(f)


def postings(ids: np.ndarray, none: np.ndarray, vectors: np.ndarray) -> bytes:
    """A block of candidates in the order of their ids (null last): arrays of the terms that most have, lists of the others."""
    order = np.lexsort((ids, none))
    ids, none, vectors = ids[order], none[order], vectors[order]
    held = (vectors != 0).sum(axis=0)
    full = held * 2 > len(ids)
    rest = np.nonzero(~full & (held > 0))[0]
    term, place = np.nonzero(vectors[:, rest].T)
    kind = np.int32
    return packed(ids=ids, none=none, terms=np.nonzero(full)[0], full=np.ascontiguousarray(vectors[:, full].T.astype(kind)), rare=rest, ends=np.searchsorted(term, np.arange(1, len(rest) + 1)), places=place, weights=vectors[place, rest[term]].astype(kind))


def scores(block: dict[str, np.ndarray], queries: np.ndarray) -> np.ndarray:
    """Inner products of some queries (rows of weights by term) with all vectors of a block."""
    bound = sum(float(np.abs(queries).max(initial=0)) * float(np.abs(w).max(initial=0)) for w in [*block["full"], *([block["weights"]] * len(block["rare"]))])
    kind = np.int32 if bound < 2**31 else np.int64
    out = np.zeros((len(queries), len(block["ids"])), kind)
    held = np.empty_like(out)
    for term, weights in zip(block["terms"].tolist(), block["full"].astype(kind, copy=False), strict=True):
        w = queries[:, term].astype(kind) if term < queries.shape[1] else np.zeros(len(queries), kind)
        own = np.nonzero(w)[0]
        if len(own) == len(w):
            out += np.multiply(w[:, None], weights, out=held)
        else:
            out[own] += w[own, None] * weights
    begin = 0
    for term, end in zip(block["rare"].tolist(), block["ends"].tolist(), strict=True):
        own = np.nonzero(queries[:, term])[0] if term < queries.shape[1] else ()
        if len(own):
            out[np.ix_(own, block["places"][begin:end])] += queries[own, term].astype(kind)[:, None] * block["weights"][begin:end].astype(kind)
        begin = end
    return out


class Best:
    """The k best candidates of each query so far: by score, then id (null last)."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.score = [np.empty(0, np.int64)] * len(ids)
        self.vec = [np.empty(0, np.int64)] * len(ids)
        self.none = [np.empty(0, bool)] * len(ids)

    def add(self, block: dict[str, np.ndarray], queries: np.ndarray) -> None:
        ids = block["ids"][: len(block["ids"]) - int(block["none"].sum())]
        low, high = np.searchsorted(ids, self.ids), np.searchsorted(ids, self.ids, side="right")  # the rows of a query's own id
        for at in range(0, len(queries), AT_ONCE):
            for i, found in enumerate(scores(block, queries[at : at + AT_ONCE]), at):
                places = np.concatenate([np.arange(low[i]), np.arange(high[i], len(found))]) if high[i] > low[i] else slice(None)
                self.merge(i, found[places].astype(np.int64), block["ids"][places], block["none"][places])

    def merge(self, i: int, score: np.ndarray, vec: np.ndarray, none: np.ndarray) -> None:
        k = self.k
        if len(self.score[i]) == k:
            near = np.nonzero(score >= self.score[i][-1])[0]
            score, vec, none = score[near], vec[near], none[near]
        if len(score) > k:
            least = np.partition(score, len(score) - k)[-k]
            above = np.nonzero(score > least)[0]
            near = np.concatenate([above, np.nonzero(score == least)[0][: k - len(above)]])  # places go by id
            score, vec, none = score[near], vec[near], none[near]
        if not len(score):
            return
        score, vec, none = np.concatenate([self.score[i], score]), np.concatenate([self.vec[i], vec]), np.concatenate([self.none[i], none])
        order = np.lexsort((vec, none, -score))[:k]
        self.score[i], self.vec[i], self.none[i] = score[order], vec[order], none[order]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query with all other rows.

    vectors has vec_id and embedding; other columns are left out. A component x counts as floor(scale * x), within
    2^24 either way. Queries are the rows whose vec_id is divisible by `every`. Vectors that are null or hold a null, NaN or
    infinity take no part; an empty one scores 0, and a shorter one has zeros at its end. Ties go to the smaller vec_id,
    null last. Rows of a query's own vec_id are no candidates of it; rows that share a vec_id are queries of their own.
    Fewer than k candidates give all of them, an empty table no row.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    asked = rows.where(F.col("vec_id") % every == 0)
    groups = max(1, -(-asked.count() // group_rows))
    stripes = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // groups))

    def to_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def block(some: pa.Table) -> pa.RecordBatch:
            ids = some["vec_id"].combine_chunks()
            raw = postings(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), dense(*integers(some["embedding"].combine_chunks(), scale)))
            return pa.record_batch([pa.array([raw], pa.binary())], names=["block"])

        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) >= block_rows:
                table = pa.Table.from_batches(kept)
                while table.num_rows >= block_rows:
                    yield block(table.slice(0, block_rows))
                    table = table.slice(block_rows)
                kept = table.to_batches()
        if sum(b.num_rows for b in kept):
            yield block(pa.Table.from_batches(kept))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, best, weights = None, [], None, None

        def found() -> Iterator[pa.RecordBatch]:
            if best is not None:
                n = [len(x) for x in best.score]
                vec = pa.array(np.concatenate(best.vec), mask=np.concatenate(best.none))
                yield pa.record_batch([pa.array(np.repeat(numbers, n)), pa.array(np.repeat(best.ids, n)), vec, pa.array(np.concatenate(best.score))], schema=FOUND_ARROW)

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                if row["cell"][0].as_py() != cell:
                    yield from found()
                    cell, waiting, best, weights = row["cell"][0].as_py(), [], None, None
                if row["block"][0].as_py() is None:
                    waiting.append(row)
                elif waiting or best is not None:
                    if best is None:
                        own = pa.Table.from_batches(waiting)
                        numbers, waiting = own["q"].to_numpy(), []
                        best, weights = Best(own["vec_id"].to_numpy(), k), dense(*integers(own["embedding"].combine_chunks(), scale))
                    best.add(unpacked(row["block"][0].as_py()), weights)
        yield from found()

    def dealt(number: str, n: int):
        """Rows numbered by partition and place go round n."""
        return F.pmod(F.shiftright(number, 33) + F.col(number).bitwiseAND((1 << 33) - 1), F.lit(n)).cast("int")

    queries = asked.withColumn("q", F.monotonically_increasing_id())
    queries = queries.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    queries = queries.select((dealt("q", groups) * stripes + F.col("stripe")).alias("cell"), "q", "vec_id", "embedding", F.lit(None).cast("binary").alias("block"))
    blocks = rows.mapInArrow(to_postings, "block binary").withColumn("number", F.monotonically_increasing_id())
    blocks = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    blocks = blocks.select((F.col("group") * stripes + dealt("number", stripes)).alias("cell"), F.lit(None).cast("long").alias("q"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast(rows.schema["embedding"].dataType).alias("embedding"), "block")
    cells = queries.unionByName(blocks).repartitionById(groups * stripes, F.col("cell")).sortWithinPartitions("cell", F.col("block").isNotNull())
    merged = cells.mapInArrow(search, FOUND).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())))
    return merged.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the five best of all embeddings for each whose vec_id is divisible by 50."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
