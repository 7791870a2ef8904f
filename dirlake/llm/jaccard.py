"""Operator 1: documents joined by the Jaccard similarity of their word shingles, by a grouped prefix join.

Sets. Each document becomes the set of hashes of its shingles. Hashes travel as packed arrays to the part of the hash
space they belong to, where all documents' hashes are sorted and counted, and the number of documents that have each
hash goes back to those documents; a hash that only one document has can't link anything and stays behind. Hashes
are ordered by rarity (in 64 steps), then by value.

Join. Two sets of n and m hashes with Jaccard similarity t share a hash among the first n - ceil(t n) + 1 of the one
and the like of the other. Equal sets are one node; nodes with the same prefix and size are one group. Groups
that share a prefix hash and pass the length and positional bounds are expanded to nodes, and these are verified.

Only the components are asked for. So each prefix hash first pairs every group with one leader, the one with the
fewest hashes of its own; in a second pass all pairs are made, but for nodes that are linked already. That join is on
the hash and a class of sizes: the place of the hash in the larger set bounds the sizes of its partners, so groups that
share only a template too small to link them don't meet.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .components import components
from .lm import from_low, low_bytes, slices
from .storage import written

PACKED = "part int, block long, header boolean, doc_ids array<bigint>, a binary, b binary, c binary"
PACKED_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("header", pa.bool_()), ("doc_ids", pa.list_(pa.int64())), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
SETS = "doc_id long, n long, d1 long, d2 long, single long, prefix array<bigint>, keys binary"
SETS_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("single", pa.int64()), ("prefix", pa.list_(pa.int64())), ("keys", pa.binary())])
#: Bytes of text whose hashes one part of the hash space gets, and whose parts one task takes in turn, about.
PART_BYTES, TASK_BYTES = 16 << 20, 256 << 20
#: Hashes and documents that are dealt to the parts at once.
DEALT = 1 << 20


def packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(PACKED_ARROW)
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, PACKED_ARROW, strict=True)], schema=PACKED_ARROW)


def document_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a block of texts, sorted by text and hash, and the text of each."""
    data, offsets = T.text_bytes(column)
    words, starts = T.words(data, offsets, T.SPACED)[:2]
    first = T.firsts(starts, offsets)
    doc = np.repeat(np.arange(len(column)), np.diff(first))
    hashes = T.shingles(words, size)
    whole = doc[: len(hashes)] == doc[size - 1 :] if len(hashes) else np.empty(0, bool)
    hashes, doc = [hashes[whole]], [doc[: len(whole)][whole]]
    for few in range(1, size):
        short = np.nonzero(np.diff(first) == few)[0]
        own = np.zeros(len(short), np.uint64)
        for j in range(few):
            own += words[first[short] + j] * T.PLACES[j]
        hashes.append(T.mix(own + T.PLACES[63 - few]))
        doc.append(short)
    h, d = np.concatenate(hashes), np.concatenate(doc)
    by = np.lexsort((h, d))
    h, d = h[by], d[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]


def dealt_sets(batches: Iterable[pa.RecordBatch], column: str, size: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """doc_ids, hashes and the document of each hash, sorted by document, for about DEALT of them at once."""
    ids, some, weight = [], [], 0
    for block in T.blocks(batches, column):
        h, d = document_sets(block[column], size)
        some.append((h, d + len(ids)))
        ids += block["doc_id"].to_pylist()
        weight += len(h) + block.num_rows
        if weight >= DEALT:
            yield ids, *(np.concatenate(x) for x in zip(*some, strict=True))
            ids, some, weight = [], [], 0
    if some:
        yield ids, *(np.concatenate(x) for x in zip(*some, strict=True))


def gaps(x: np.ndarray) -> bytes:
    """Rising numbers as differences, which compress well."""
    return np.diff(x, prepend=0).astype("<u4").tobytes()


def from_gaps(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(x, "<u4"), dtype=np.int64)


def rarity_keys(low: np.ndarray, part: int, counts: np.ndarray) -> np.ndarray:
    """Keys whose order is rarity (in half octaves), then hash; equal for equal hashes only."""
    step = np.minimum(63, (2 * np.log2(counts)).astype(np.int64)).astype(np.uint64)
    return step << np.uint64(57) | T.mix(low | np.uint64(part & 0xFFFF) << np.uint64(48)) >> np.uint64(7)


def shared_sets(docs: DataFrame, column: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n (set size), a digest of the set (d1, d2), single (hashes that no other row has), and,
    where the row could be linked, the prefix (without single hashes) and all keys other than of single hashes, sorted."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_parts, n_tasks = max(at_least, -(-total // PART_BYTES)), max(at_least, -(-total // TASK_BYTES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block_id = TaskContext.get().partitionId() << 32
        for ids, h, d in dealt_sets(batches, column, size):
            ends = np.searchsorted(d, np.arange(len(ids) + 1))
            digests = [np.diff(np.concatenate([[np.uint64(0)], np.cumsum(T.mix(h ^ c), dtype=np.uint64)])[ends]) for c in T.PLACES[:2]]
            rows = [(block_id % n_parts, block_id, True, ids, np.diff(ends).astype("<u4").tobytes(), digests[0].tobytes(), digests[1].tobytes())]
            part = ((h >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.uint16 if n_parts < 1 << 16 else np.uint32)
            by = np.argsort(part, kind="stable")
            h, d, part = h[by], d[by], part[by].astype(np.int64)
            rows += [(p, block_id, False, None, low_bytes(h[s]), gaps(d[s]), b"") for p, s in slices(part)]
            yield packed(rows)
            block_id += 1

    def count(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        out = [b for b in table.filter(table["header"]).to_batches() if b.num_rows]
        rest = table.filter(pa.compute.invert(table["header"]))
        lows = [from_low(x) for x in rest["a"].to_pylist()]
        if lows:
            low = np.concatenate(lows)
            _, back, counts = np.unique(low, return_inverse=True, return_counts=True)
            counts = counts[back]
            at, rows = 0, []
            for block, own, b in zip(rest["block"].to_pylist(), lows, rest["b"].to_pylist(), strict=True):
                c = counts[at : at + len(own)]
                at += len(own)
                if (c > 1).any():
                    rows.append((part, block, False, None, rarity_keys(own[c > 1], part, c[c > 1]).tobytes(), gaps(from_gaps(b)[c > 1]), b""))
            out.append(packed(rows))
        return pa.Table.from_batches(out, PACKED_ARROW)

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["header"])
        n = np.frombuffer(head["a"], "<u4").astype(np.int64)
        keys = np.frombuffer(b"".join(r["a"] for r in rows if not r["header"]), np.uint64)
        doc = np.concatenate([np.empty(0, np.int64), *(from_gaps(r["b"]) for r in rows if not r["header"])])
        by = np.lexsort((keys, doc))
        keys = keys[by].view(np.int64)
        ends = np.searchsorted(doc[by], np.arange(len(n) + 1))
        single = n - np.diff(ends)
        length = np.where(n > 0, np.maximum(0, n + (-percent * n) // 100 + 1 - single), 0)
        usable = length > 0
        prefix = [keys[a : a + m] if m else None for a, m in zip(ends[:-1].tolist(), length.tolist(), strict=True)]
        whole = [keys[a:b].tobytes() if ok else None for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), usable.tolist(), strict=True)]
        return pa.table([pa.array(head["doc_ids"], pa.int64()), pa.array(n), pa.array(np.frombuffer(head["b"], "<i8")), pa.array(np.frombuffer(head["c"], "<i8")), pa.array(single), pa.array(prefix, pa.list_(pa.int64())), pa.array(whole, pa.binary())], schema=SETS_ARROW)

    dealt = docs.select(F.col("doc_id").cast("long"), column).mapInArrow(deal, PACKED)
    counted = dealt.repartition(n_tasks, "part").groupBy("part").applyInArrow(count, PACKED)
    return written(counted.repartition(n_tasks, "block").groupBy("block").applyInArrow(gather, SETS), "sets")


def enough(overlap: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether so many shared hashes make the similarity that is asked for."""
    return overlap * (100 + percent) >= percent * (n + m)


def group_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """grp_a, grp_b of groups that share a prefix hash and pass the length and positional bounds, but for those that are
    linked already; entries (key, grp, n, place, low, high). A pair comes once for each such hash.

    Of a pair with n >= m hashes, the larger takes m from n * percent / 100 to what the hashes from the place on allow,
    and goes to each class of sizes in between (about 3 % apart); the smaller goes to its own class.
    """
    level = lambda x: F.floor(F.log(x) / F.log(F.lit(1.03)))
    left = F.col("n") - F.col("place")
    most = F.least(F.col("n"), F.floor(left * (100 + percent) / percent) - F.col("n"))
    least = F.ceil(F.col("n") * percent / 100)
    larger = entries.where(most >= least).withColumn("class", F.explode(F.sequence(level(least), level(most)))).alias("x")
    same = entries.where(enough(left, F.col("n"), F.col("n"), percent)).withColumn("class", level(F.col("n"))).alias("y")
    pairs = larger.join(same, (F.col("x.key") == F.col("y.key")) & (F.col("x.class") == F.col("y.class")))
    pairs = pairs.where("x.n > y.n or (x.n = y.n and x.grp < y.grp)").where("not (x.low = x.high and y.low = y.high and x.low = y.low)")
    pairs = pairs.where(enough(F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")), F.col("x.n"), F.col("y.n"), percent))
    return pairs.select(F.col("x.grp").alias("grp_a"), F.col("y.grp").alias("grp_b"))


def verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough."""
    sets = nodes.select("node", "n", "keys")
    both = pairs.join(sets.toDF("b", "n_b", "keys_b"), "b").join(sets.toDF("a", "n_a", "keys_a"), "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, n, m in zip(*(batch[c].to_pylist() for c in ("keys_a", "keys_b", "n_a", "n_b")), strict=True):
                shared = len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
                keep.append(shared * (100 + percent) >= percent * (n + m))
            yield pa.record_batch([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "n_a", "n_b", "keys_a", "keys_b").mapInArrow(check, "a long, b long")


def similar_documents(docs: DataFrame, column: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text; other columns are left out).

    A text of fewer words than size has one shingle, all its words; a null or empty text or one without words has none
    and links with nothing. component_id is the smallest doc_id among the rows linked, at any remove. Rows that
    share a doc_id are rows of their own; a null doc_id counts only where no other is in the component.
    """
    sets = shared_sets(docs, column, size, percent).withColumn("node", F.xxhash64("d1", "d2", "n"))
    usable = sets.where("keys is not null")
    nodes = written(usable.select("node", "n", "single", "prefix", "keys", F.xxhash64("prefix", "n", "single").alias("grp")).dropDuplicates(["node"]), "nodes")
    groups = nodes.groupBy("grp").agg(F.min("node").alias("leader"), F.first("n").alias("n"), F.first("single").alias("single"), F.first("prefix").alias("prefix"))
    entries = groups.select("grp", "leader", "n", "single", F.posexplode("prefix").alias("place", "key"))
    entries = written(entries.select("key", "grp", "leader", "n", "single", (F.col("single") + F.col("place")).alias("place")), "prefixes")

    def bounds(a: str, b: str) -> Column:
        left = F.least(F.col(f"{a}.n") - F.col(f"{a}.place"), F.col(f"{b}.n") - F.col(f"{b}.place"))
        return enough(left, F.col(f"{a}.n"), F.col(f"{b}.n"), percent)

    best = entries.groupBy("key").agg(F.min(F.struct("single", "leader", "n", "place")).alias("x"), F.count("*").alias("m")).where("m > 1")
    by_key = entries.alias("y").join(best.select("key", "x"), "key").where("x.leader <> leader").where(bounds("x", "y")).select(F.col("x.leader").alias("a"), F.col("leader").alias("b"))
    linkable = enough(F.col("n") - F.col("single"), F.col("n"), F.col("n"), percent)  # of members of one group
    in_group = nodes.where(linkable).select("grp", F.col("node").alias("b")).join(groups.select("grp", F.col("leader").alias("a")), "grp").where("a <> b").select("a", "b")
    links = written(verified(written(by_key.union(in_group).distinct(), "pairs"), nodes, percent), "links")

    known = components(links)
    member = written(nodes.select("node", "grp").join(known.withColumnRenamed("id", "node"), "node", "left").select("grp", "node", F.coalesce("component", "node").alias("c")), "members")
    spread = member.groupBy("grp").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    entries = entries.join(spread, "grp")
    mixed = entries.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("key")
    left = written(entries.join(mixed, "key", "left_semi"), "mixed")
    pairs = group_pairs(left, percent).distinct()
    pairs = pairs.join(member.toDF("grp_a", "a", "c_a"), "grp_a").join(member.toDF("grp_b", "b", "c_b"), "grp_b").where("c_a <> c_b")
    uneven = spread.where("low <> high").join(groups.where(linkable).select("grp"), "grp").select("grp")
    uneven = member.join(uneven, "grp", "left_semi")
    inner = uneven.toDF("grp", "a", "c_a").join(uneven.toDF("grp", "b", "c_b"), "grp").where("a < b and c_a <> c_b")
    more = verified(written(pairs.select("a", "b").union(inner.select("a", "b")), "pairs"), nodes, percent)

    joined = components(links.union(more)).withColumnRenamed("id", "node")
    ids = usable.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = ids.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_node = ids.select("node", "component").join(least, "component").select("node", "component_id")
    return sets.select("doc_id", "n", "node").join(of_node, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of all documents: five-word shingles, similarity of 0.8 or more."""
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
