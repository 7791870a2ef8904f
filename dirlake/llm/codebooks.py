"""Operator 13: product codes of vectors, entries found by Exponion search in exact integers.

A vector is cut into parts; each part's position has a codebook of `entries` integer vectors. Rounds assign every part
to its nearest entry and replace each entry by the floor of its parts' mean. The search for the nearest entry starts at the
part's previous entry a, at distance u. The other entries stand in a list sorted by their distance from a. With the best
distance so far v, an entry at distance r from a is at least r - u away, so none beyond r = u + v can be nearer or as near;
(u + v)^2 <= 2 (u^2 + v^2), so the scan of the list ends where r^2 exceeds 2 (u^2 + v^2), all in integers.

Codebooks are small (entries * dimensions numbers) and go to tasks with the code; sums and counts are added up within tasks,
then by part and entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import written
from .vectors import integers, usable

#: Vectors that a task handles at once; parts that the rows of one label are spread over when label errors are joined.
BLOCK, SALTS = 8192, 32


def neighbours(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of a codebook the others by distance (ties to lower index), and their squared distances."""
    far = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(far, -1)  # the entry itself comes first
    order = np.argsort(far, axis=1, kind="stable")[:, 1:]
    return order, np.take_along_axis(far, order, 1)


def nearest(parts: np.ndarray, start: np.ndarray, book: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index of each part's nearest entry (ties to lower index) and the squared distance; the search begins at entry start."""
    order, far = lists
    first = ((parts - book[start]) ** 2).sum(axis=1)
    best, dist = start.copy(), first.copy()
    live = np.arange(len(parts))
    for j in range(order.shape[1]):
        live = live[far[start[live], j] <= 2 * (first[live] + dist[live])]
        if not len(live):
            break
        entry = order[start[live], j]
        d = ((parts[live] - book[entry]) ** 2).sum(axis=1)
        nearer = (d < dist[live]) | ((d == dist[live]) & (entry < best[live]))
        moved = live[nearer]
        best[moved], dist[moved] = entry[nearer], d[nearer]
    return best, dist


def encode(vectors: np.ndarray, start: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows * parts) and squared distances of integer vectors, from the previous codes."""
    code, error = np.empty_like(start), np.empty(start.shape, np.int64)
    for p, (book, cut) in enumerate(zip(books, np.split(vectors, len(books), axis=1), strict=True)):
        code[:, p], error[:, p] = nearest(cut, start[:, p], book, neighbours(book))
    return code, error


def numbers(column: pa.Array, kind: type) -> np.ndarray:
    """A list column of lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def assigned(rows: DataFrame, books: np.ndarray, scale: float | None) -> DataFrame:
    """rows (vec_id, label, v, code) with new codes and their error; with a scale, v is raw and code is left out: the search begins at 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                if scale is None:
                    v, start = numbers(some["v"], np.int64), numbers(some["code"], np.int64)
                else:
                    v = integers(some["v"], scale)[0].reshape(some.num_rows, -1)
                    start = np.zeros((some.num_rows, len(books)), np.int64)
                code, error = encode(v, start, books)
                yield pa.record_batch([some["vec_id"], some["label"], pa.array(list(v.astype(np.int32)), pa.list_(pa.int32())), pa.array(list(code.astype(np.int32)), pa.list_(pa.int32())), pa.array(error.sum(axis=1))], names=["vec_id", "label", "v", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, v array<int>, code array<int>, error long")


def means(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks with each entry replaced by the floor of the mean of its parts; unused entries stay."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            at = (numbers(batch["code"], np.int64) + np.arange(parts) * entries).ravel()
            own = numbers(batch["v"], np.int64).reshape(-1, width)
            count += np.bincount(at, minlength=len(count))
            order = np.argsort(at, kind="stable")
            begin = np.nonzero(np.diff(at[order], prepend=-1))[0]
            if len(begin):
                total[at[order][begin]] += np.add.reduceat(own[order], begin, axis=0)
        used = np.nonzero(count)[0]
        if len(used):
            yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(count[used]), *(pa.array(total[used, i]) for i in range(width))], names=["at", "n", *(f"s{i}" for i in range(width))])

    sums = rows.select("v", "code").mapInArrow(run, ", ".join(["at int", "n long", *(f"s{i} long" for i in range(width))]))
    out = books.reshape(-1, width).copy()
    for row in sums.groupBy("at").agg(*[F.sum(c).alias(c) for c in sums.columns[1:]]).collect():  # entries of the codebooks at most
        out[row["at"]] = [s // row["n"] for s in row[2:]]
    return out.reshape(books.shape)


def seeds(rows: DataFrame, parts: int, entries: int, scale: float) -> np.ndarray | None:
    """Codebooks from the vectors of the smallest vec_ids (null last, ties by components), all of the first one's length."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding").asc()]
    first = rows.select("vec_id", "embedding").orderBy(*order).limit(1).collect()
    if not first:
        return None
    own = rows.where(F.size("embedding") == len(first[0].embedding)).select("vec_id", "embedding").orderBy(*order).limit(entries).collect()
    v = integers(pa.array([r.embedding for r in own], pa.list_(pa.float64())), scale)[0].reshape(len(own), -1)
    return np.stack(np.split(v, parts, axis=1))


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (an index for each part), error of vectors (vec_id, embedding, label), and the codebooks (part, entry, component).

    A component x counts as floor(scale * x), within 2^24 either way. Vectors that are null or hold a null, NaN or infinity
    are left out, as are those whose length no part divides evenly, or isn't that of the first vector kept. The codebooks begin
    as the parts of the `entries` smallest vec_ids (fewer, if there are fewer); rows that share a vec_id go by
    components, a null vec_id last. Repeated rows count as often as they stand there. Other columns are left out;
    an empty table gives no row and no codebook.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable() & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0)).select("vec_id", "label", "embedding")
    books = seeds(rows, parts, entries, scale)
    if books is None:
        kinds = dict(rows.dtypes)
        return spark.createDataFrame([], f"vec_id {kinds['vec_id']}, label {kinds['label']}, code array<int>, error long"), np.zeros((parts, 0, 0), np.int64)
    rows = rows.where(F.size("embedding") == books.shape[0] * books.shape[2]).withColumnRenamed("embedding", "v")
    for k in range(rounds):
        rows = written(assigned(rows, books, None if k else scale).drop("error"), "codes")
        books = means(rows, books)
    return written(assigned(rows, books, None if rounds else scale).drop("v"), "codes"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal numbers, by part, entry, place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error: the sum of error over equal labels, nulls together. Rows of a label are spread over SALTS keys."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("of_salt"))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return salted.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("of_salt"))).drop("of", "of_salt", "salt")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of all embeddings: 16 parts, 64 entries, 2 rounds."""
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    code = F.lower(F.array_join(F.transform("code", lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    return label_errors(coded).select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
