"""Operator 11: the trie of conversations' prefixes.

Fingerprint. A turn (role, text) is a number modulo the prime 2^61 - 1 in each of two lanes; the fingerprint of a prefix is the
polynomial of its turns' numbers, one prefix sum along the conversation. Numpy scans pieces of PIECE turns, what the pieces before add
up to is added afterwards, so a conversation of any length is dealt to many tasks.

Verification. Prefixes of one depth and fingerprint are a group, its representative the smallest conv_id. Turns of equal
numbers are compared by content, and all members of a group must have the representative's last turn and parent group; by
induction over the depth they then agree turn by turn. Where any differ, another lane with another base splits the
groups, until all members agree.

Roll-up. The nodes that a conversation represents are one path down to its end. So a node's subtree is made of the paths
of its members: each path adds its sums once to every node above it on its conversation, and its own nodes have running sums
from the end. No step goes level by level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as T
from .storage import written

#: Turns of a conversation that are scanned as one piece (a power of two), and lanes of a fingerprint to begin with.
PIECE, LANES = 1 << 12, 2
#: conv_ids whose decimal numbers are joined at once: those that share all but so many bits.
CHUNK_BITS = 16
P = int(T.PRIME)


def base(lane: int) -> int:
    return int(np.random.default_rng([20240407, lane]).integers(1 << 32, P))


def powers(lane: int, first: int, n: int) -> np.ndarray:
    """base^first, base^(first + 1), ... modulo the prime: n of them."""
    out = np.empty(max(1, n), np.uint64)
    out[0], size = pow(base(lane), first, P), 1
    while size < n:
        out[size : 2 * size] = T.product(out[: min(size, n - size)], np.uint64(pow(base(lane), size, P)))
        size *= 2
    return out[:n]


def prefix_sums(terms: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums modulo the prime of terms since the last place where first is true (or the begin)."""
    low, high = np.cumsum(terms & np.uint64(0xFFFFFFFF)), np.cumsum(terms >> np.uint64(32))
    begin = np.maximum.accumulate(np.where(first, np.arange(len(terms)), 0))
    low -= np.where(begin > 0, low[begin - 1], np.uint64(0))
    high -= np.where(begin > 0, high[begin - 1], np.uint64(0))
    return T.reduced(low + ((high & np.uint64((1 << 29) - 1)) << np.uint64(32)) + (high >> np.uint64(29)))


def ordered(turns: DataFrame, lanes: int, modulus: int) -> DataFrame:
    """conv_id, place (from 1), n_bytes and the turn's number in each lane (t0, t1, ...). Turns are sorted by range, so no task gets a whole long conversation."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id is not null")
    rows = rows.withColumns({f"t{k}": F.pmod(F.xxhash64(F.lit(k), "role", "text"), F.lit(modulus)) for k in range(lanes)})
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = written(rows.select("conv_id", "at", F.octet_length("text").cast("long").alias("n_bytes"), *(f"t{k}" for k in range(lanes))), "turns")
    part = F.shiftright("at", 33)
    runs = rows.groupBy("conv_id", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    runs = runs.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")).drop("n")  # a row for each partition
    return rows.withColumn("part", part).join(runs, ["conv_id", "part"]).withColumn("place", F.col("before") + F.col("at") - F.col("first") + 1).drop("part", "first", "before", "at")


def turns_agree(turns: DataFrame, lanes: int, modulus: int) -> bool:
    """Whether turns of equal numbers in all lanes have equal roles and texts."""
    content = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.where("conv_id is not null").select(content.alias("content"), *[F.pmod(F.xxhash64(F.lit(k), content["role"], content["text"]), F.lit(modulus)).alias(f"t{k}") for k in range(lanes)])
    return rows.groupBy(*(f"t{k}" for k in range(lanes))).agg((F.min("content") == F.max("content")).alias("same")).where("not same").isEmpty()


def fingerprints(rows: DataFrame, lanes: int) -> DataFrame:
    """rows (conv_id, depth from 1, total, n_bytes, t0, ...) with the fingerprint of each prefix (f0, ...) and of the one a turn shorter (p0, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, [np.uint64(0)] * lanes
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, depth = (batch[c].to_numpy() for c in ("conv_id", "depth"))
            piece = (depth - 1) // PIECE
            first = np.concatenate([[True], (conv[1:] != conv[:-1]) | (piece[1:] != piece[:-1])])
            goes_on = np.cumsum(first) == 1 if last == (conv[0], piece[0]) else np.zeros(len(conv), bool)
            sums, before = [], []
            for k in range(lanes):
                table = {q: powers(k, q * PIECE, PIECE) for q in np.unique(piece).tolist()}
                power = np.empty(len(conv), np.uint64)
                for q, own in table.items():
                    at = piece == q
                    power[at] = own[depth[at] - 1 - q * PIECE]
                term = T.product(batch[f"t{k}"].to_numpy().astype(np.uint64), power)
                f = prefix_sums(term, first)
                f[goes_on] = T.reduced(f[goes_on] + carry[k])
                carry[k] = f[-1]
                sums.append(pa.array(f.astype(np.int64)))
                before.append(pa.array(T.reduced(f + T.PRIME - term).astype(np.int64)))
            last = (conv[-1], piece[-1])
            yield pa.record_batch([*batch.columns, *sums, *before], names=[*batch.schema.names, *(f"f{k}" for k in range(lanes)), *(f"p{k}" for k in range(lanes))])

    names = ["conv_id", "depth", "total", "n_bytes", *(f"t{k}" for k in range(lanes))]
    piece = F.shiftright(F.col("depth") - 1, PIECE.bit_length() - 1)
    own = rows.select(*names).repartition("conv_id", piece).sortWithinPartitions("conv_id", "depth")
    local = written(own.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, *(f"f{k}" for k in range(lanes)), *(f"p{k}" for k in range(lanes))])), "scans").withColumn("piece", piece)
    ends = local.where((F.col("total") > PIECE) & (F.col("depth") % PIECE == 0) & (F.col("depth") < F.col("total")))
    past = Window.partitionBy("conv_id").orderBy("piece")
    ends = ends.select("conv_id", (F.col("piece") + 1).alias("piece"), *[F.pmod(F.sum(F.col(f"f{k}").cast("decimal(38,0)")).over(past), F.lit(P).cast("decimal(38,0)")).cast("long").alias(f"add{k}") for k in range(lanes)])
    modulo = lambda x: F.when(x >= P, x - P).otherwise(x)
    out = local.join(ends, ["conv_id", "piece"], "left")
    return out.select(*names, *[modulo(F.col(f"{c}{k}") + F.coalesce(f"add{k}", F.lit(0))).alias(f"{c}{k}") for c in "fp" for k in range(lanes)])


def from_end(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """nodes with running sums (below_...) of columns along each conv_id's nodes, from the deepest up to each, by pieces."""
    own = nodes.withColumn("piece", F.shiftright("depth", PIECE.bit_length() - 1))
    pieces = own.groupBy("conv_id", "piece").agg(*[F.sum(c).alias(f"all_{c}") for c in columns])
    deeper = Window.partitionBy("conv_id").orderBy(F.col("piece").desc()).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("conv_id", "piece", *[F.sum(f"all_{c}").over(deeper).alias(f"all_{c}") for c in columns]).where(f"all_{columns[0]} is not null")
    here = Window.partitionBy("conv_id", "piece").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    own = own.select("*", *[F.sum(c).over(here).alias(f"below_{c}") for c in columns]).join(pieces, ["conv_id", "piece"], "left")
    return own.withColumns({f"below_{c}": F.col(f"below_{c}") + F.coalesce(f"all_{c}", F.lit(0)) for c in columns}).drop("piece", *(f"all_{c}" for c in columns))


def joined_ids(ends: DataFrame, key: list[str]) -> DataFrame:
    """key, ends_sha256: the digest of the decimal conv_ids of each key, ascending, joined by commas. Ids are joined in chunks of bounded size, which stream through the digest."""
    chunk = F.shiftright("conv_id", CHUNK_BITS)
    chunks = ends.groupBy(*key, chunk.alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))  # 2^CHUNK_BITS ids at most
    chunks = chunks.select(*key, "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, out = None, None, []
        for batch in batches:
            for *k, ids in zip(*(batch[c].to_pylist() for c in [*key, "ids"]), strict=True):
                if k != at:
                    out += [] if own is None else [[*at, own.hexdigest()]]
                    at, own = k, hashlib.sha256(ids.encode())
                else:
                    own.update(b"," + ids.encode())
            if out:
                yield table(out)
                out = []
        if own is not None:
            yield table([[*at, own.hexdigest()]])

    def table(rows: list[list]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=[*key, "ends_sha256"])

    return chunks.repartition(*key).sortWithinPartitions(*key, "chunk").mapInArrow(run, ", ".join([*(f"{c} long" for c in key), "ends_sha256 string"]))


Rebuild = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def as_they_are(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations of their own turns: rows with depth and total, and conv_id, total of each."""
    convs = rows.groupBy("conv_id").agg(F.count("*").alias("total"))
    return rows.withColumnRenamed("place", "depth").join(convs, "conv_id"), convs


def prefix_trie(turns: DataFrame, rebuild: Rebuild = as_they_are, lanes: int = LANES, modulus: int = P) -> DataFrame:
    """One row for each distinct sequence of first turns of conversations, the empty one included.

    turns has conv_id, turn, role, text; other columns are left out. Rows without conv_id belong to no conversation. Turns go
    by turn (null first), then role and text; repeated rows are turns of their own; a null role or text counts as empty.
    rebuild makes from rows (conv_id, place, ...) the rows (conv_id, depth, total, ...) and the conversations
    (conv_id, total), which may have no turn. Returns conv_id (the smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256. Without conversations there is no node.
    """
    while not turns_agree(turns, lanes, modulus):
        lanes += 1
    rows, convs = rebuild(ordered(turns, lanes, modulus))
    f, p, t = ([f"{c}{k}" for k in range(lanes)] for c in "fpt")
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), F.col("total").cast("long").alias("total"), zero.alias("n_bytes"), *[zero.alias(c) for c in [*t, *f, *p]])
    prefixes = written(fingerprints(rows, lanes).unionByName(roots), "prefixes")
    key = ["depth", *f]
    own = [*p, *t]
    groups = prefixes.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), (F.max("total") == F.col("depth")).cast("long").alias("leaf"), *[F.min(c).alias(c) for c in own], *[F.max(c).alias(f"max_{c}") for c in own])
    groups = written(groups, "nodes")
    if not groups.where(" or ".join(f"{c} <> max_{c}" for c in own)).isEmpty():
        return prefix_trie(turns, rebuild, lanes + 1, modulus)
    nodes = groups.select(*key, *p, "conv_id", "n_convs", "leaf", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"))

    paths = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    above = prefixes.join(paths, "conv_id").where("depth < top").select(*key, "saved", "leaf", zero.alias("child"))
    children = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), *[F.col(x).alias(y) for x, y in zip(p, f, strict=True)], zero.alias("saved"), zero.alias("leaf"), F.lit(1).cast("long").alias("child"))
    added = above.unionByName(children).groupBy(*key).agg(F.sum("saved").alias("more_saved"), F.sum("leaf").alias("more_leaf"), F.sum("child").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(x).alias(y) for x, y in zip(f, p, strict=True)], F.col("conv_id").alias("parent_conv_id"))
    ends = joined_ids(prefixes.where("depth = total").select(*key, "conv_id"), key)
    out = from_end(nodes, ["saved", "leaf"]).join(added, key, "left").join(parents, ["depth", *p], "left").join(ends, key, "left")

    def plus(a: str, b: str) -> Column:
        return F.col(a) + F.coalesce(b, F.lit(0))

    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        plus("below_leaf", "more_leaf").alias("n_leaves"),
        plus("below_saved", "more_saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def shared_starts(rows: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversation c begins with the first h turns of conversation c - c % family, then has its own after its first h; h is crc32 of c modulo most."""
    convs = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = convs.withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % most, "origin": F.col("conv_id") - F.col("conv_id") % family})
    heads = convs.select(F.col("conv_id").alias("origin"), F.col("n").alias("n_origin"))
    convs = convs.join(heads, "origin", "left").withColumn("m", F.least("h", F.coalesce("n_origin", F.lit(0))))
    convs = written(convs.select("conv_id", "origin", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "conversations")
    kept = rows.join(convs.select("conv_id", "h", "m", "total"), "conv_id").where("place > h").withColumn("depth", F.col("place") - F.col("h") + F.col("m"))
    first = rows.where((F.col("place") < most) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "origin").join(convs, "origin").where("place <= h").withColumn("depth", F.col("place"))
    return kept.select(*first.drop("origin").columns).unionByName(first.drop("origin")), convs.select("conv_id", "total")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each rebuilt with the shared start of its family of five."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), shared_starts)
