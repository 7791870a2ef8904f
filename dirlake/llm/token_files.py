"""Operator 6: token ids in files of directly addressable codes (DAC).

An id is cut into chunks of 8 bits, lowest first. Level k keeps, one byte each, the k-th chunks of all ids that have
one, a bitmap telling which of these ids go on, and a rank directory: the number of set bits before every block of
512 bits. Token i is read from one byte a level: chunk i, then, if its bit is set, chunk rank(i) of the next level.

A shard is a row of an uncompressed Parquet table: ids of whole documents, in ascending doc_id. Range partitioning
keeps the order over all shards. A second table has each partition's first place. To read one token, `read_token`
finds its partition there, then its shard by the statistics of small pages, and one byte a level in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .storage import shared_dir
from .tokens import default_path, word_encoder

#: Bytes of text that a range of documents has, about.
RANGE_BYTES = 64 << 20
#: Tokens after which a shard ends (at the end of a document), and bits for each entry of a rank directory.
SHARD_TOKENS, RANK_BITS = 1 << 13, 512
#: Pages of few shards, and row groups of a few MB: what reading a token takes from disk.
LAYOUT = {"compression": "uncompressed", "parquet.block.size": str(4 << 20), "parquet.page.size": str(64 << 10), "parquet.page.row.count.limit": "8"}
SHARD = "part int, shard int, before long, until long, doc_ids array<bigint>, doc_tokens array<bigint>, levels array<binary>, goes_on array<binary>, ranks array<binary>"
SHARD_ARROW = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("before", pa.int64()), ("until", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("levels", pa.list_(pa.binary())), ("goes_on", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))])
READ_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("before", pa.int64()), ("ids", pa.binary())])


def to_codes(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, continuation bitmaps and rank directories of unsigned 32-bit ids."""
    levels, goes_on, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        levels.append((rest & 0xFF).astype(np.uint8).tobytes())
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), RANK_BITS // 8)) if len(bits) else np.empty(0, np.int64)
        goes_on.append(bits.tobytes())
        ranks.append(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)[:-1]]).astype("<u4").tobytes() if len(bits) else b"")
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            return levels, goes_on, ranks


def token_at(levels: list[bytes], goes_on: list[bytes], ranks: list[bytes], i: int) -> int:
    """The id at place i of a shard, from one byte a level; nothing else is decoded."""
    out = 0
    for k, chunks in enumerate(levels):
        out |= chunks[i] << (8 * k)
        bits = goes_on[k]
        if not bits[i >> 3] >> (i & 7) & 1:
            break
        block = i // RANK_BITS
        start = block * RANK_BITS // 8
        inside = int.from_bytes(bits[start : (i >> 3) + 1], "little") & ((1 << (i - block * RANK_BITS)) - 1)
        i = int(np.frombuffer(ranks[k], "<u4", 1, 4 * block)[0]) + inside.bit_count()
    return out


def from_codes(levels: list[bytes], goes_on: list[bytes]) -> np.ndarray:
    """All ids of a shard."""
    out = np.frombuffer(levels[0], np.uint8).astype(np.uint32)
    at = np.arange(len(out))
    for k in range(1, len(levels)):
        more = np.unpackbits(np.frombuffer(goes_on[k - 1], np.uint8), count=len(at), bitorder="little").astype(bool)
        at = at[more]
        out[at] |= np.frombuffer(levels[k], np.uint8).astype(np.uint32) << np.uint32(8 * k)
    return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Writes the ids of docs (doc_id, text), each document followed by end_id, to tables at path: shards and parts.

    A null text counts as empty; rows that share a doc_id stand in the order of their texts; a null doc_id comes first.
    """
    spark = docs.sparkSession

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        shard, before, until, ids, doc_ids, counts = 0, 0, 0, [], [], []

        rows: list[tuple] = []

        def done() -> None:
            rows.append((part, shard, before, until, doc_ids, counts, *to_codes(np.frombuffer(b"".join(ids), "<u4"))))

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, SHARD_ARROW, strict=True)], schema=SHARD_ARROW)

        for block in T.blocks(batches, "text"):
            coded = encoder.encode(block["text"])
            for doc_id, x in zip(block["doc_id"].to_pylist(), coded, strict=True):
                ids += (x, end)
                doc_ids.append(doc_id)
                counts.append(len(x) // 4 + 1)
                until += counts[-1]
                if until - before >= SHARD_TOKENS:
                    done()
                    shard, before = shard + 1, until
                    ids, doc_ids, counts = [], [], []
            if rows:
                yield batch()
        if counts:
            done()
            yield batch()

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    ranges = docs.select("doc_id", "text").repartitionByRange(n, "doc_id", F.substring("text", 1, 64))  # keys are sampled by the driver
    ranges.sortWithinPartitions("doc_id", "text").mapInArrow(shards, SHARD).write.options(**LAYOUT).parquet(f"{path}/shards")
    table = spark.read.schema(SHARD).parquet(f"{path}/shards")
    totals = {r.part: r.n for r in table.groupBy("part").agg(F.max("until").alias("n")).collect()}  # a row for each partition written
    starts = np.cumsum([0, *(totals[p] for p in sorted(totals))]).tolist()
    rows = [(p, starts[i], starts[i + 1]) for i, p in enumerate(sorted(totals))]
    spark.createDataFrame(rows, PARTS).coalesce(1).write.parquet(f"{path}/parts")


PARTS = "part int, start long, stop long"


def read_token(spark: SparkSession, path: str, i: int) -> int:
    """The id at place i of all tokens at path; reads the pages that may hold its shard."""
    part = spark.read.schema(PARTS).parquet(f"{path}/parts").where((F.col("start") <= i) & (F.col("stop") > i)).first()
    if part is None:
        raise IndexError(i)
    at = i - part.start
    shard = spark.read.schema(SHARD).parquet(f"{path}/shards").where((F.col("part") == part.part) & (F.col("before") <= at) & (F.col("until") > at)).select("before", "levels", "goes_on", "ranks").first()
    return token_at([bytes(x) for x in shard.levels], [bytes(x) for x in shard.goes_on], [bytes(x) for x in shard.ranks], at - shard.before)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), ids (binary, little-endian unsigned 32-bit) of each document at path."""
    table = spark.read.schema(SHARD).parquet(f"{path}/shards").drop("until")
    parts = spark.read.schema(PARTS).parquet(f"{path}/parts").select("part", "start")  # a row for RANGE_BYTES

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = from_codes(row["levels"], row["goes_on"]).astype("<u4", copy=False)
                ends = np.cumsum(np.array(row["doc_tokens"], np.int64))
                starts = ends - row["doc_tokens"]
                yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), pa.array(np.full(len(ends), row["part"], np.int32)), pa.array(starts + row["before"]), pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())], schema=READ_ARROW)

    found = table.mapInArrow(documents, "doc_id long, part int, before long, ids binary").join(F.broadcast(parts), "part")
    return found.select("doc_id", (F.col("before") + F.col("start")).alias("start"), "ids")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files written for all documents."""
    path = shared_dir(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, default_path())
    return read_tokens(spark, path).select("doc_id", "start", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
