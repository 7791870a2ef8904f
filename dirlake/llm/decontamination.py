"""Operator 5: documents that hold passages of a benchmark, by a prefix-filtered set join.

A window is a run of `window` words of an item, or all words of a shorter item. As a set of word shingles it is
contained in a document only if each of its shingles is there, so one shingle is a sufficient prefix: the rarest over
all documents. Documents are joined on these shingles; the shingle's place in the window gives where the window would
lie (it must fit between the document's first and last word), and all words there are compared.

The benchmark is taken in blocks of at most about block_bytes of text (an item is never cut). What is broadcast is bounded
by that, at some 15 times the bytes; a larger benchmark takes more passes over the documents, two a block. Windows are made on
whole blocks by numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from . import text as T

FOUND = S.StructType([S.StructField("n_words", S.LongType()), S.StructField("spans", S.ArrayType(S.LongType())), S.StructField("items", S.ArrayType(S.StringType()))])
FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


@dataclass
class Lookup:
    """Sorted hashes, found through a bitmap on their upper bits first."""

    keys: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray) -> Lookup:
        bits = np.zeros(1 << 20, bool)
        bits[hashes >> np.uint64(44)] = True
        return cls(np.unique(hashes), bits)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in hashes that hold a key, and the key's number."""
        at = np.nonzero(self.bits[hashes >> np.uint64(44)])[0]
        k = np.searchsorted(self.keys, hashes[at])
        ok = k < len(self.keys)
        ok[ok] = self.keys[k[ok]] == hashes[at[ok]]
        return at[ok], k[ok]


@dataclass
class Windows:
    """Distinct windows of one length: where they begin in a row of words, their tokens (shingles) and items."""

    size: int
    shingle: int
    words: np.ndarray
    begin: np.ndarray
    tokens: Lookup
    names: list[str]
    first: np.ndarray  # items of window i: own[first[i] : first[i + 1]], numbers of names
    own: np.ndarray

    def items(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in windows, and the items of the windows there."""
        n = self.first[windows + 1] - self.first[windows]
        at = np.repeat(np.arange(len(windows)), n)
        return at, self.own[np.repeat(self.first[windows] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def distinct_windows(words: np.ndarray, begin: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of one window of each content, and for each window the number of its content."""
    keys = T.shingles(words, size)[begin]
    _, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
    if any((words[begin + j] != words[begin[index][inverse] + j]).any() for j in range(size)):  # different windows of one hash
        rows = np.lib.stride_tricks.sliding_window_view(words, size)[begin]
        _, index, inverse = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return index, inverse.ravel()


def item_windows(rows: list[Row], window: int, shingle: int) -> list[Windows]:
    """Windows of the items (item_id, text), by length, on all items at once."""
    data, offsets = T.text_bytes(pa.array([r.text for r in rows], pa.string()))
    hashes, starts, _ = T.words(data, offsets, T.ALNUM)
    first = T.firsts(starts, offsets)
    length = np.diff(first)
    names = sorted({str(r.item_id) for r in rows if r.item_id is not None})
    number = {x: i for i, x in enumerate(names)}
    name = np.array([-1 if r.item_id is None else number[str(r.item_id)] for r in rows], np.int64)
    out = []
    for size in np.unique(np.minimum(length, window)[length > 0]).tolist():
        item = np.nonzero(length >= window if size == window else length == size)[0]
        n = length[item] - size + 1
        of = np.repeat(item, n)
        begin = np.repeat(first[item] - np.cumsum(n) + n, n) + np.arange(n.sum())
        index, inverse = distinct_windows(hashes, begin, size)
        window_of, own = np.divmod(np.unique(inverse * (len(names) + 1) + name[of] + 1), len(names) + 1)
        window_of, own = window_of[own > 0], own[own > 0] - 1
        s, begin = min(shingle, size), begin[index]
        inside = np.zeros(len(hashes) - s + 1, bool)
        for j in range(size - s + 1):
            inside[begin + j] = True
        tokens = Lookup.of(T.shingles(hashes, s)[inside])
        out.append(Windows(size, s, hashes, begin, tokens, names, np.searchsorted(window_of, np.arange(len(begin) + 1)), own.astype(np.int32)))
    return out


def rarest(w: Windows, counts: np.ndarray, at_once: int = 1 << 16) -> tuple[Lookup, np.ndarray, np.ndarray]:
    """For a lookup of the windows' rarest tokens: where each one's windows begin, and the windows with the token's place in them."""
    number = np.searchsorted(w.tokens.keys, T.shingles(w.words, w.shingle))  # of no meaning between windows
    token, place = np.empty(len(w.begin), np.int64), np.empty(len(w.begin), np.int64)
    for at in range(0, len(w.begin), at_once):
        own = number[w.begin[at : at + at_once, None] + np.arange(w.size - w.shingle + 1)]
        least = np.argmin(counts[own], axis=1)
        token[at : at + at_once], place[at : at + at_once] = own[np.arange(len(own)), least], least
    by = np.argsort(token, kind="stable")
    used, begin = np.unique(token[by], return_index=True)
    return Lookup.of(w.tokens.keys[used]), np.append(begin, len(by)), np.stack([by, place[by]], axis=1).astype(np.int32)


def token_counts(docs: DataFrame, column: str, sets: list[Windows]) -> list[np.ndarray]:
    """How often each token occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast([(w.shingle, w.tokens) for w in sets])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(t.keys), np.int64) for _, t in shared.value]
        for block in T.blocks(batches, column):
            hashes = T.words(*T.text_bytes(block[column]), T.ALNUM)[0]
            for (size, tokens), c in zip(shared.value, counts, strict=True):
                np.add.at(c, tokens.find(T.shingles(hashes, size))[1], 1)
        for i, c in enumerate(counts):
            k = np.nonzero(c)[0]
            yield pa.record_batch([pa.array(np.full(len(k), i)), pa.array(k), pa.array(c[k])], names=["i", "k", "n"])

    out = [np.zeros(len(w.tokens.keys), np.int64) for w in sets]
    for r in docs.select(column).mapInArrow(count, "i long, k long, n long").groupBy("i", "k").agg(F.sum("n").alias("n")).collect():  # as many rows as the block has shingles
        out[r.i][r.k] = r.n
    return out


def _scan(w: Windows, anchors: tuple[Lookup, np.ndarray, np.ndarray], hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, first words and windows of all occurrences."""
    lookup, begin, order = anchors
    at, k = lookup.find(T.shingles(hashes, w.shingle))
    n = begin[k + 1] - begin[k]
    at, entry = np.repeat(at, n), np.repeat(begin[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
    window, place = order[entry, 0], order[entry, 1]
    doc = np.searchsorted(first, at, side="right") - 1
    start = at - place
    fits = (start >= first[doc]) & (start + w.size <= first[doc + 1])
    doc, start, window = doc[fits], start[fits], window[fits]
    same = np.ones(len(start), bool)
    for j in range(w.size):
        same[same] = hashes[start[same] + j] == w.words[w.begin[window[same]] + j]
    return doc[same], start[same], window[same]


def find_passages(docs: DataFrame, benchmark: DataFrame, column: str = "text", window: int = 10, shingle: int = 3, block_bytes: int = 16 << 20) -> tuple[DataFrame, str]:
    """docs with one more column, whose name is returned: struct(n_words, spans, items).

    spans lists the first words and ends of the maximal runs of hit words, items the ids (as strings, sorted, each
    once) of the benchmark items (item_id, text) that have a window in the text. A null or empty text has no words,
    no spans and no items, an item without words has no window; the hits of an item without id count, the item
    doesn't. Repeated rows each get their result; other columns stay as they are.
    """
    name = "passages"
    while name in docs.columns:
        name += "_"
    schema = S.StructType([*docs.schema.fields, S.StructField(name, FOUND)])
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    out = docs.withColumn(name, F.lit(None).cast(FOUND))
    for b in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).collect()  # about block_bytes of text
        sets = item_windows(rows, window, shingle)
        tables = [(w, rarest(w, counts)) for w, counts in zip(sets, token_counts(docs, column, sets), strict=True)]
        for w in sets:
            w.tokens = None  # tasks look for the rarest only
        shared = docs.sparkSession.sparkContext.broadcast(tables)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for block in T.blocks(batches, column):
                data, offsets = T.text_bytes(block[column])
                hashes, starts = T.words(data, offsets, T.ALNUM)[:2]
                first = T.firsts(starts, offsets)
                change = np.zeros(len(hashes) + 1, np.int64)
                items: dict[int, set[str]] = {}
                for w, anchors in shared.value:
                    doc, start, own = _scan(w, anchors, hashes, first)
                    np.add.at(change, start, 1)
                    np.add.at(change, start + w.size, -1)
                    for d in np.unique(doc).tolist():
                        items.setdefault(d, set())
                    met = np.unique(np.stack([doc, own], axis=1), axis=0)
                    at, item = w.items(met[:, 1])
                    for d, k in np.unique(np.stack([met[at, 0], item], axis=1), axis=0).tolist():
                        items[d].add(w.names[k])
                hit = np.cumsum(change)[:-1] > 0
                rows = []
                before = block[name]
                for i, n in enumerate(np.diff(first)):
                    own, known, had = hit[first[i] : first[i + 1]], items.get(i), before[i].as_py()
                    if had and had["spans"]:
                        own = own.copy()
                        for a, z in zip(had["spans"][::2], had["spans"][1::2], strict=True):
                            own[a:z] = True
                    edges = np.nonzero(np.diff(np.concatenate([[False], own, [False]])))[0].tolist() if known is not None or had and had["spans"] else []
                    rows.append({"n_words": int(n), "spans": edges, "items": sorted({*(known or ()), *(had["items"] if had else ())})})
                yield pa.RecordBatch.from_arrays([*(block.column(c) for c in range(len(block.schema) - 1)), pa.array(rows, FOUND_ARROW)], names=schema.names)

        out = out.mapInArrow(search, schema)
    return out, name


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found, name = find_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate(F.transform(f"{name}.spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id",
        F.col(f"{name}.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size(f"{name}.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", f"{name}.items"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
