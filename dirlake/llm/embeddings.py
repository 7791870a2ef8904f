"""Operator 4: embedding pairs of high cosine within a label, by spherical-cap filters from structured random codes.

Filter directions are a product code: the space is rotated at random and cut in two halves, each with `words` random
unit vectors; every choice of one word a half, joined and scaled to unit length, is a direction. A vector belongs to
the filters whose directions lie in the spherical cap around it that holds `listed` of them: a direction exceeds its
cosine threshold. List decoding finds them among sums of the best words of either half. Vectors that share a filter
are compared exactly.

Of pairs with cosine 0.93, over 99.9 % share one of 48 filters out of 1024 * 1024 (measured); of closer pairs, more. The
number of words grows with the root of the largest label's number of vectors, so that a filter holds few by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .storage import written

#: Vectors of a filter that are compared in one group; a fuller filter is cut into chunks, and all pairs of chunks compared.
CHUNK = 1024
#: Entries of sparse filters that one group takes, about; a filter with up to SMALL vectors is compared pair by pair.
GROUP, SMALL = 4096, 32
#: Words of either half: at least, and at most (a filter's number fits 32 bits).
LEAST_WORDS, MOST_WORDS = 1024, 1 << 16
NODE_ARROW = pa.schema([("label", pa.string()), ("node", pa.int64()), ("copies", pa.int64()), ("vec_id", pa.int64()), ("v", pa.binary()), ("filters", pa.list_(pa.int32()))])
LINK_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


@lru_cache(maxsize=8)
def code(dim: int, words: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A rotation and the words of both halves; the same in all workers."""
    r = np.random.default_rng([20240229, dim, words])
    rotation = np.linalg.qr(r.normal(size=(dim, dim)))[0]
    books = []
    for own in np.array_split(np.arange(dim), 2):
        x = r.normal(size=(words, len(own)))
        books.append(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) / np.sqrt(2))
    return rotation, books


def filters(x: np.ndarray, words: int, listed: int) -> np.ndarray:
    """The filters of each row of x (unit vectors)."""
    rotation, books = code(x.shape[1], words)
    scores = [part @ book.T for part, book in zip(np.array_split(x @ rotation, 2, axis=1), books, strict=True)]
    best = [np.argpartition(-s, listed - 1, axis=1)[:, :listed] for s in scores]
    left, right = (np.take_along_axis(s, k, 1) for s, k in zip(scores, best, strict=True))
    sums = (left[:, :, None] + right[:, None, :]).reshape(len(x), -1)
    top = np.argpartition(-sums, listed - 1, axis=1)[:, :listed]
    return np.take_along_axis(best[0], top // listed, 1) * words + np.take_along_axis(best[1], top % listed, 1)


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length as unit vectors in double precision."""
    x = np.stack([np.frombuffer(v, kind) for v in raw]).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def words_for(n: int) -> int:
    """A power of two of about 16 times the root of n."""
    return min(MOST_WORDS, max(LEAST_WORDS, 1 << int(np.ceil(np.log2(16 * np.sqrt(max(1, n)))))))


def small_pairs(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of runs that begin at start."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for k in np.unique(size[size > 1]).tolist():
        i, j = np.triu_indices(k, 1)
        at = start[size == k][:, None]
        found.append(((at + i).ravel(), (at + j).ravel()))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def pair_links(x: np.ndarray, lists: np.ndarray, here: np.ndarray, i: np.ndarray, j: np.ndarray, least: float, at_once: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j), those whose cosine is high enough and whose first common filter is here."""
    kept = [(i[:0], j[:0])]
    for at in range(0, len(i), at_once):
        a, b = i[at : at + at_once], j[at : at + at_once]
        near = np.einsum("ij,ij->i", x[a], x[b]) >= least
        a, b = a[near], b[near]
        for k in range(0, len(a), 1024):
            p, q = a[k : k + 1024], b[k : k + 1024]
            common = (lists[p][:, :, None] == lists[q][:, None, :]).any(axis=2)
            first = np.take_along_axis(lists[p], common.argmax(axis=1)[:, None], 1)[:, 0]  # lists are sorted
            kept.append((p[first == here[p]], q[first == here[p]]))
    return tuple(np.concatenate(z) for z in zip(*kept, strict=True))


def block_links(x: np.ndarray, lists: np.ndarray, here: int, chunk: np.ndarray, cut: bool, least: float) -> np.ndarray:
    """The same for all rows of one filter as a matrix; if cut, only pairs of different chunks."""
    linked = x @ x.T >= least
    np.fill_diagonal(linked, False)
    if cut:
        linked &= chunk[:, None] != chunk[None, :]
    some = np.nonzero(linked.any(axis=1))[0]
    names, column = np.unique(lists[some], return_inverse=True)
    there = np.zeros((len(some), len(names)), np.float32)
    there[np.repeat(np.arange(len(some)), lists.shape[1]), column.ravel()] = np.tile(1, lists.shape[1] * len(some))
    there = there[:, names < here]
    linked[np.ix_(some, some)] &= there @ there.T == 0
    return linked


def vector_key(label: str, embedding: str) -> list[Column]:
    """128 bits that tell a vector of a label."""
    return [F.xxhash64(label, embedding), F.xxhash64(F.lit(1), label, embedding)]


def similar_vectors(vectors: DataFrame, least: float = 0.93, words: int | None = None, listed: int = 48, block: int = 256) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding, label); other columns are left out.

    Vectors are compared if their labels are equal and not null and their lengths agree. A vector that is null, empty or
    zero, or holds a null, NaN or infinity, links with nothing. Rows with equal vectors are linked; rows that share
    a vec_id are rows of their own, and a null vec_id names a component only if there is no other id. words is
    chosen by the largest label's number of distinct vectors if it is not given.
    """
    kind = "<f8" if "array<double>" in vectors.schema["embedding"].dataType.simpleString() else "<f4"
    vectors = vectors.select("vec_id", "embedding", F.col("label").cast("string").alias("label"))
    usable = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    rows = vectors.withColumns({x: F.when(usable, h) for x, h in zip(("key", "check"), vector_key("label", "embedding"), strict=True)})
    copies = rows.where("key is not null").groupBy("key", "check").agg(F.count("*").alias("copies"), F.min("vec_id").alias("vec_id"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    copies = written(copies.withColumn("node", F.monotonically_increasing_id()), "vectors")
    if words is None:
        words = words_for(copies.groupBy("label").count().agg(F.max("count")).first()[0] or 0)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                some = batch.slice(at, block)
                flat, ends = some["embedding"].flatten().to_numpy(zero_copy_only=False).astype(kind), np.cumsum(some["embedding"].value_lengths().to_numpy())
                label = np.array(some["label"].to_pylist(), object)
                sizes = np.diff(ends, prepend=0)
                for size in np.unique(sizes):
                    own = np.nonzero(sizes == size)[0]
                    v = [flat[ends[i] - size : ends[i]].tobytes() for i in own]
                    lists = np.sort(filters(unit(v, kind), words, listed).astype(np.uint32).view(np.int32), axis=1)
                    columns = [pa.array([f"{size} {x}" for x in label[own]], pa.string()), *(some[c].take(pa.array(own)) for c in ("node", "copies", "vec_id")), pa.array(v, pa.binary()), pa.array(list(lists), pa.list_(pa.int32()))]
                    yield pa.record_batch(columns, schema=NODE_ARROW)

    nodes = written(copies.mapInArrow(decode, "label string, node long, copies long, vec_id long, v binary, filters array<int>"), "filters")
    entries = nodes.select("node", "label", F.explode("filters").alias("filter"))
    full = entries.groupBy("label", "filter").agg(F.count("*").alias("m")).where("m > 1")
    met = written(entries.join(full, ["label", "filter"]), "met")
    slots = -(-(met.groupBy("label").count().agg(F.max("count")).first()[0] or 1) // GROUP)
    parts = F.ceil(F.col("m") / CHUNK).cast("int")
    own = met.select("label", "filter", "node", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("chunk"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    slot = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("filter"), F.lit(slots))).otherwise(F.lit(-(1 << 40)) + F.col("filter"))  # a full filter has a group to itself
    own = own.select("label", slot.alias("slot"), "filter", "node", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    own = own.join(nodes.select("node", "copies", "v", "filters"), "node")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        """Links within each filter: numbers of linked vectors (n), and pairs that join what is linked."""
        cut = key[2].as_py() != key[3].as_py()
        table = table.sort_by([("filter", "ascending"), ("node", "ascending")])
        here, node, copies, chunk = (table[c].to_numpy() for c in ("filter", "node", "copies", "chunk"))
        x = unit(table["v"].to_pylist(), kind)
        lists = table["filters"].combine_chunks().flatten().to_numpy().reshape(len(x), -1)
        start = np.nonzero(np.diff(here, prepend=here[0] + 1))[0]
        size = np.diff(start, append=len(here))
        few = size <= (0 if cut else SMALL)
        i, j = pair_links(x, lists, here, *small_pairs(start[few], size[few]), least)
        n = np.bincount(i, copies[j], len(x)).astype(np.int64) + np.bincount(j, copies[i], len(x)).astype(np.int64)
        edges = [(j, i)]
        for at, k in zip(start[~few].tolist(), size[~few].tolist(), strict=True):
            s = slice(at, at + k)
            linked = block_links(x[s], lists[s], here[at], chunk[s], cut, least)
            n[s] += linked @ copies[s]
            root = np.full(k, -1)
            for r in np.nonzero(linked.any(axis=1))[0]:
                if root[r] >= 0:
                    continue
                root[r], front = r, np.array([r])
                while len(front):
                    reached = np.nonzero(linked[front].any(axis=0) & (root < 0))[0]
                    root[reached], front = r, reached
            leaf = np.nonzero((root >= 0) & (root != np.arange(k)))[0]
            edges.append((at + leaf, at + root[leaf]))
        has = np.nonzero(n)[0]
        a, b = (np.concatenate(z) for z in zip(*edges, strict=True))
        return pa.table([pa.array(np.concatenate([node[has], node[a]])), pa.array(np.concatenate([node[has], node[b]])), pa.array(np.concatenate([n[has], np.zeros(len(a), np.int64)]))], schema=LINK_ARROW)

    found = written(own.groupBy("label", "slot", "low", "high").applyInArrow(compare, "a long, b long, n long"), "links")
    n_links = found.groupBy("a").agg(F.sum("n").alias("n")).select(F.col("a").alias("node"), "n")
    joined = components(found.where("a <> b").select("a", "b")).withColumnRenamed("id", "node")
    of = nodes.select("node", "copies", "vec_id").join(n_links, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of = written(of, "components")
    of = of.join(of.groupBy("component").agg(F.min("vec_id").alias("component_id")), "component").select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    of = of.join(copies.select("node", "key", "check"), "node")
    out = rows.select("vec_id", "key", "check").join(of, ["key", "check"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of all embeddings: cosine of 0.93 or more within a label."""
    return similar_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
