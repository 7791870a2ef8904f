"""Operator 2: byte strings of a given length that occur more than once, anywhere in the corpus, are removed.

Longest-previous-factor arrays: in suffix order the suffixes with the longest match among earlier ones stand at the
previous and next smaller text position, so the longer of these two common prefixes is the longest previous factor
(LPF). A string of `length` bytes starts earlier if the LPF of its suffix is at least `length`, and starts later if the
like is true with text positions reversed. Suffixes are compared byte by byte, up to `length` bytes.

Not every suffix is sorted, and not all together. Among the `gram`-byte strings inside a window of `length` bytes the
one with the least hash is the window's anchor, so equal windows have equal anchors at equal places. Neighbouring
windows with one anchor form a run:
- a run whose anchor occurs once has no match; a run whose whole content (by a cryptographic digest of 128 bits) occurs
  again is matched as a whole;
- where runs of one anchor differ, one run of each content goes to the anchor's part, and the suffixes of a part are sorted;
- an anchor with more than `hot` contents would make a large part. Digests of its windows are counted by a grouping with
  partial aggregation instead, which no number of surroundings makes large.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .storage import written

RUNS = "key long, doc_id long, anchor long, content binary, lo long, size long"
DEALT = "part long, key long, doc_id long, lo long, size long, asked boolean, data binary"
WINDOWS = "key long, doc_id long, lo long, asked boolean, content binary"
SPANS = "key long, lo long, hi long"
#: Suffixes that are sorted together, about.
PART_WINDOWS = 1 << 19


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    raw = memoryview(data.tobytes())
    return pa.array([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window of width, from running minima of blocks to the left and to the right."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchored_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text, first window (in data), number of windows and anchor hash of each run.

    Anchors are found in pieces of data, so that a long text takes memory for one piece and for its runs.
    """
    found = [tuple(np.empty(0, np.int64) for _ in range(5))]
    for low in range(0, len(data) - length + 1, T.PIECE_BYTES):
        piece = data[low : low + T.PIECE_BYTES + length - 1]
        at = np.arange(len(piece) - gram + 1)
        hashes = T.span_hashes(T.prefix_sums(piece), slice(0, len(at)), slice(gram, None))
        least = sliding_least(hashes & ~np.uint64(0xFFFFFFFF) | at.astype(np.uint64), length - gram + 1)
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        begin = np.maximum(offsets[:-1] - low, 0)
        sizes = np.maximum(0, np.minimum(offsets[1:] - low - length + 1, len(anchor)) - begin)
        x = spread(begin, sizes)
        text = np.repeat(np.arange(len(sizes)), sizes)
        own = anchor[x]
        new = np.nonzero(np.diff(own, prepend=-1) | np.diff(text, prepend=-1))[0]
        found.append((text[new], x[new] + low, np.diff(new, append=len(x)), hashes[own[new]].view(np.int64), own[new] + low))
    text, x, size, hashes, own = (np.concatenate(z) for z in zip(*found, strict=True))
    new = np.nonzero(np.diff(own, prepend=-1) | np.diff(text, prepend=-1))[0]  # a run that goes on in the next piece is one
    return text[new], x[new], np.add.reduceat(size, new) if len(new) else size, hashes[new]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the stretches with these starts and sizes."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def runs_of(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """All runs of docs (key, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in T.blocks(batches, "text"):
            data, offsets = T.text_bytes(block["text"])
            text, x, size, anchor = anchored_runs(data, offsets, length, gram)
            of = pa.array(text)
            columns = [block["key"].take(of), block["doc_id"].take(of), pa.array(anchor), digests(data, x, x + size - 1 + length), pa.array(x - offsets[text]), pa.array(size)]
            yield pa.record_batch(columns, names=["key", "doc_id", "anchor", "content", "lo", "size"])

    return docs.mapInArrow(run, RUNS)


def ranked(keys: np.ndarray) -> np.ndarray:
    """Each key's place among the distinct keys in order."""
    by = np.argsort(keys)
    keys = keys[by]
    out = np.empty(len(keys), np.int32)
    out[by] = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])
    return out


def paired(rank: np.ndarray, at: np.ndarray | slice, step: int) -> np.ndarray:
    """Numbers in the order of the strings at these places that are made of two with known ranks, step bytes apart."""
    padded = np.concatenate([rank, np.full(step, -1, np.int32)])
    return rank[at].astype(np.int64) << 32 | (padded[step:][at] + 1)


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """starts in the order of the `length` bytes that begin there, then of place; and the ranks of all strings of 8, 16,
    32, ... bytes that led to it, by prefix doubling."""
    size = min(8, length)
    words = np.zeros(len(data), np.uint64)
    for j in range(size):
        words <<= np.uint64(8)
        words[: len(data) - j] |= data[j:]
    levels = [(size, ranked(words))]
    while 2 * levels[-1][0] <= length:
        size, rank = levels[-1]
        levels.append((2 * size, ranked(paired(rank, slice(None), size))))
    size, rank = levels[-1]
    return starts[np.argsort(paired(rank, starts, length - size), kind="stable")], levels


def common_prefix(data: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Length of the common prefixes of the suffixes at a and at b, `length` at most."""
    out = np.zeros(len(a), np.int64)
    last = len(data) - 1
    for size, rank in reversed(levels):
        same = rank[np.minimum(a + out, last)] == rank[np.minimum(b + out, last)]
        out[same] += size
    same = np.ones(len(a), bool)
    for _ in range(levels[0][0] - 1):
        same &= data[np.minimum(a + out, last)] == data[np.minimum(b + out, last)]
        out[same] += 1
    return np.minimum(out, length)


def smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value, where the previous and the next smaller one stand; -1 for none."""
    values = values.tolist()
    before, after, open_ = [-1] * len(values), [-1] * len(values), []
    for i, v in enumerate(values):
        while open_ and values[open_[-1]] > v:
            after[open_.pop()] = i
        if open_:
            before[i] = open_[-1]
        open_.append(i)
    return np.array(before, np.int64), np.array(after, np.int64)


def longest_factors(data: np.ndarray, order: np.ndarray, levels: list[tuple[int, np.ndarray]], length: int, previous: bool) -> np.ndarray:
    """For each suffix in order: its longest match, `length` at most, with a suffix at an earlier place (a later one, if not previous)."""
    out = np.zeros(len(order), np.int64)
    for other in smaller(order if previous else -order):
        some = other >= 0
        out[some] = np.maximum(out[some], common_prefix(data, levels, order[some], order[other[some]], length))
    return out


def located(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """docs with the given runs (key, part, lo, size, asked) of each document, as an array."""
    some = runs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("lo", "size", "asked", "part"))).alias("runs"))  # at most a document's
    return docs.join(some, "key").select("key", "doc_id", "text", "runs")


def run_columns(block: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Document (its number in the block), lo, size, asked and part of each run of a block."""
    own = block["runs"].to_pylist()
    of = np.repeat(np.arange(len(own)), [len(x) for x in own])
    return of, *(np.array([r[c] for x in own for r in x]).astype(kind) for c, kind in (("lo", np.int64), ("size", np.int64), ("asked", bool), ("part", np.int64)))


def sorted_suffixes(docs: DataFrame, runs: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """key, lo, hi of the bytes covered by matched windows of the given runs; each part's suffixes are sorted."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in T.blocks(batches, "text"):
            data, offsets = T.text_bytes(block["text"])
            of, lo, size, asked, part = run_columns(block)
            sizes = size - 1 + length
            raw = data[spread(offsets[of] + lo, sizes)]
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            content = pa.Array.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())])
            columns = [pa.array(part), block["key"].take(pa.array(of)), block["doc_id"].take(pa.array(of)), pa.array(lo), pa.array(size), pa.array(asked), content.cast(pa.binary())]
            yield pa.record_batch(columns, names=["part", "key", "doc_id", "lo", "size", "asked", "data"])

    def match(key: tuple, table: pa.Table) -> pa.Table:
        keys, lo, size = (table[c].to_numpy() for c in ("key", "lo", "size"))
        doc_ids = table["doc_id"].fill_null(np.iinfo(np.int64).min).to_numpy()
        asked = table["asked"].to_numpy()
        by = np.lexsort((lo, keys, doc_ids))  # text order; equal rows are one document
        by = by[np.concatenate([[True], (np.diff(lo[by]) != 0) | (np.diff(keys[by]) != 0)])]
        keys, lo, size, asked = keys[by], lo[by], size[by], asked[by]
        content = table["data"].to_pylist()
        data = np.frombuffer(b"".join(content[i] for i in by), np.uint8)
        begin = np.cumsum(size - 1 + length) - (size - 1 + length)
        x = spread(begin, size)
        order, levels = suffix_order(data, x, length)
        factors = longest_factors(data, order, levels, length, True)
        if not keep_first:
            factors = np.maximum(factors, longest_factors(data, order, levels, length, False))
        found = np.zeros(len(data), bool)
        found[order] = factors >= length
        run = np.repeat(np.arange(len(size)), size)
        hit = np.nonzero(found[x] & asked[run])[0]
        x, run = x[hit], run[hit]
        new = np.nonzero((np.diff(x, prepend=-2) > 1) | (np.diff(run, prepend=-1) > 0))[0]
        last = np.append(new[1:], len(x))[: len(new)] - 1
        at = lambda i: pa.array(x[i] - begin[run[i]] + lo[run[i]])
        return pa.table([pa.array(keys[run[new]]), at(new), pa.compute.add(at(last), length)], names=["key", "lo", "hi"])

    return located(docs, runs).mapInArrow(deal, DEALT).groupBy("part").applyInArrow(match, SPANS)


def counted_windows(docs: DataFrame, runs: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """The same for runs of frequent anchors: digests of windows are counted."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in T.blocks(batches, "text"):
            data, offsets = T.text_bytes(block["text"])
            of, lo, size, asked, _ = run_columns(block)
            run, at = np.repeat(np.arange(len(of)), size), spread(lo, size)
            for s in range(0, len(at), 1 << 16):  # of a large document some at a time
                r, a = run[s : s + (1 << 16)], at[s : s + (1 << 16)]
                x = offsets[of[r]] + a
                yield pa.record_batch([block["key"].take(pa.array(of[r])), block["doc_id"].take(pa.array(of[r])), pa.array(a), pa.array(asked[r]), digests(data, x, x + length)], names=["key", "doc_id", "lo", "asked", "content"])

    windows = written(located(docs, runs).mapInArrow(each, WINDOWS), "windows")
    counts = windows.groupBy("content").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "lo")).alias("first")).where("n > 1")
    hit = windows.where("asked").join(counts, "content")
    if keep_first:
        hit = hit.where("key <> first.key or lo <> first.lo")
    return hit.select("key", "lo", (F.col("lo") + length).alias("hi"))


def remove_repeats(docs: DataFrame, column: str = "text", length: int = 400, gram: int = 96, keep_first: bool = True, hot: int = 4096) -> DataFrame:
    """doc_id, n_bytes, removed (array of [start, end) of maximal removed byte runs), kept (binary) of each row of docs.

    With keep_first, a byte goes if a string of `length` bytes over it also starts earlier (by doc_id, null first,
    then by text, then place); else if it also starts anywhere else. Strings are judged on the input, overlaps
    count, and no string crosses documents. A null text counts as empty. Equal rows (same doc_id and text) match each
    other without keep_first; with it they are one document, and lose the same bytes. Other columns are left out.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(column), F.lit("")).alias("text"))
    docs = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    runs = written(runs_of(docs, length, gram), "runs")
    contents = runs.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "lo", "size")).alias("first"))
    contents = written(contents, "contents")
    anchors = contents.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    asked = F.lit(keep_first) | (F.col("n") == 1)
    differing = contents.join(anchors, "anchor").select("anchor", "first.key", "first.lo", "first.size", asked.alias("asked"), (F.col("kinds") > hot).alias("frequent"))
    differing = written(differing, "differing")
    sizes = {r.frequent: r.size for r in differing.groupBy("frequent").agg(F.sum("size").alias("size")).collect()}  # two rows
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sizes.get(False, 0) // PART_WINDOWS))
    differing = differing.withColumn("part", F.pmod("anchor", F.lit(n_parts)))
    spans = sorted_suffixes(docs, differing.where("not frequent"), length, keep_first)
    if True in sizes:
        spans = spans.union(counted_windows(docs, differing.where("frequent"), length, keep_first))
    again = contents.where("n > 1").select("anchor", "content", F.col("first.key").alias("first_key"), F.col("first.lo").alias("first_lo"))
    whole = runs.join(again, ["anchor", "content"])
    if keep_first:
        whole = whole.where("key <> first_key or lo <> first_lo")
    spans = spans.union(whole.select("key", "lo", F.expr(f"lo + size - 1 + {length}")))
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))  # at most a document's

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in T.blocks(batches, "text"):
            data, offsets = T.text_bytes(block["text"])
            rows = []
            for i, doc_id in enumerate(block["doc_id"].to_pylist()):
                raw, own = data[offsets[i] : offsets[i + 1]], block["spans"][i].values
                if own is None or not len(own):
                    rows.append((doc_id, len(raw), [], raw.tobytes()))
                    continue
                lo, hi = (own.field(c).to_numpy() for c in ("lo", "hi"))
                by = np.argsort(lo)
                lo, reach = lo[by], np.maximum.accumulate(hi[by])
                new = np.concatenate([[0], np.nonzero(lo[1:] > reach[:-1])[0] + 1])
                edges = np.stack([lo[new], reach[np.append(new[1:], len(lo)) - 1]], axis=1)
                stay = zip([0, *edges[:, 1].tolist()], [*edges[:, 0].tolist(), len(raw)], strict=True)
                rows.append((doc_id, len(raw), edges.tolist(), b"".join(raw[a:z].tobytes() for a, z in stay)))
            ids, n, removed, kept = zip(*rows, strict=True)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    return docs.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_bytes long, removed array<array<bigint>>, kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of all documents: no 400-byte string that occurs twice stays."""
    cut = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_first=False)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
