"""Operator 10: an interpolated modified Kneser-Ney bigram model, counted in Spark and mapped by its workers.

Tokens are hashes of words; each text is followed by one end token and preceded, as a context only, by a begin mark.
Counts travel as packed arrays: a task counts within a block of text, then sends each part of the hash space its
sorted hashes and counts. A part of the model is one sorted array of hashes with an array of counts beside it, in
files of the shared folder, which workers map into memory and search with sorted queries.

Pairs go to the part of their first word, so that a context's statistics form in one place; pairs of first words with
over a thousandth of all tokens, or a quarter of a part's share of them, are dealt by both words, and their statistics
added up.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .storage import shared_dir, written

BEGIN, END = np.uint64(0x5BF03635D1E2A3B1), np.uint64(0xC2B2AE3D27D4EB4F)
LOW = np.uint64((1 << 48) - 1)
#: Bytes of text that are counted at once, that a part of the model stands for (about), and that are scored at once.
COUNT_BYTES, PART_BYTES, SCORE_BYTES = 8 << 20, 32 << 20, 2 << 20
#: Tokens of a long text that are counted or scored at once.
TOKENS_AT_ONCE = 1 << 20
PACKED = "part int, a binary, b binary, c binary, d binary"
PACKED_ARROW = pa.schema([("part", pa.int32()), *((x, pa.binary()) for x in "abcd")])


def parts_of(h: np.ndarray, n: int) -> np.ndarray:
    """The part, of n, of each hash, by its lower 48 bits."""
    return (((h & LOW) >> np.uint64(16)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def pair_parts(u: np.ndarray, v: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    spread = np.where(np.isin(u, hot), T.mix(u + v * T.PLACES[0]), u)
    return parts_of(spread, n)


def pair_keys(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return T.mix(u * T.PLACES[1] + (v & LOW) * T.PLACES[2])


def low_bytes(h: np.ndarray) -> bytes:
    """The lower six bytes of each hash."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_low(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def token_block(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and tokens of all texts of a block, and the place of each text's first token and the end."""
    data, offsets = T.text_bytes(column)
    hashes, starts = T.words(data, offsets, T.SPACED)[:2]
    first = T.firsts(starts, offsets) + np.arange(len(column) + 1)
    tokens = np.full(first[-1], END, np.uint64)
    inner = np.ones(first[-1], bool)
    inner[first[1:] - 1] = False
    tokens[inner] = hashes
    contexts = np.empty_like(tokens)
    contexts[1:] = tokens[:-1]
    contexts[first[:-1]] = BEGIN
    return contexts, tokens, first


def counted_blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Contexts and tokens of about COUNT_BYTES of text at once; those of a longer text come in several parts."""
    some, size = [], 0
    for block in T.blocks(batches, column):
        own = token_block(block[column])[:2]
        while len(own[0]) > 2 * TOKENS_AT_ONCE:
            yield tuple(x[:TOKENS_AT_ONCE] for x in own)
            own = tuple(x[TOKENS_AT_ONCE:] for x in own)
        some.append(own)
        size += pa.compute.sum(pa.compute.binary_length(block[column])).as_py() or 0
        if size >= COUNT_BYTES:
            yield tuple(np.concatenate(x) for x in zip(*some, strict=True))
            some, size = [], 0
    if some:
        yield tuple(np.concatenate(x) for x in zip(*some, strict=True))


def added(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, and each array's sums for them."""
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    at = np.nonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1)))[0] if len(keys) else np.empty(0, np.int64)
    return keys[at], *(np.add.reduceat(v[by], at) if len(at) else v[:0] for v in values)


def packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PACKED_ARROW, strict=True)], schema=PACKED_ARROW)


def slices(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal numbers in a sorted array."""
    at = np.nonzero(np.diff(part, prepend=-1))[0].tolist()
    for a, b in zip(at, [*at[1:], len(part)], strict=True):
        yield int(part[a]), slice(a, b)


def u4(x: np.ndarray) -> bytes:
    return x.astype("<u4").tobytes()


def read_u4(x: bytes) -> np.ndarray:
    return np.frombuffer(x, "<u4").astype(np.int64)


def word_counts(docs: DataFrame, column: str, n: int) -> DataFrame:
    """Packed rows: a part's words (a) and how often they occur (b, 64 bits)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens in counted_blocks(batches, column):
            words, counts = np.unique(tokens, return_counts=True)
            by = np.argsort(part := parts_of(words, n), kind="stable")
            words, counts, part = words[by], counts[by], part[by]
            yield packed([(p, words[s].tobytes(), counts[s].astype("<u8").tobytes(), b"", b"") for p, s in slices(part)])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        words, counts = added(*(np.frombuffer(b"".join(table[x].to_pylist()), "<u8") for x in "ab"))
        return pa.Table.from_batches([packed([(key[0].as_py(), words.tobytes(), counts.tobytes(), b"", b"")])])

    return written(docs.select(column).mapInArrow(count, PACKED).groupBy("part").applyInArrow(add, PACKED), "words")


def pair_counts(docs: DataFrame, column: str, hot: np.ndarray, n: int) -> DataFrame:
    """Packed rows, several a part: first words (a), their numbers of pairs (b), second words (c), counts (d)."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, v in counted_blocks(batches, column):
            v = v & LOW
            _, at, counts = np.unique(pair_keys(u, v), return_index=True, return_counts=True)
            u, v = u[at], v[at]
            by = np.lexsort((u, part := pair_parts(u, v, shared.value, n)))
            u, v, counts, part = u[by], v[by], counts[by], part[by]
            rows = []
            for p, s in slices(part):
                own = u[s]
                at = np.nonzero(np.diff(own, prepend=own[:1] + np.uint64(1)))[0]
                rows.append((p, own[at].tobytes(), u4(np.diff(at, append=len(own))), low_bytes(v[s]), u4(counts[s])))
            yield packed(rows)

    return docs.select(column).mapInArrow(count, PACKED)


def save(path: str, array: np.ndarray) -> None:
    """Whole files only: a task that runs twice replaces the file by an equal one."""
    own = f"{path}.{os.getpid()}-{os.urandom(4).hex()}"
    with open(own, "wb") as f:
        np.save(f, array)
    os.replace(own, path)


def discounts(n: list[int]) -> list[float]:
    """D1, D2 and D3+ from the numbers of items with counts 1 to 4; where one is missing, the customary halves."""
    if min(n) <= 0:
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(k + 0.99, max(0.01, k + 1 - (k + 2) * y * n[k + 1] / n[k])) for k in range(3)]


def train(docs: DataFrame, column: str = "text", folder: str | None = None, part_bytes: int = PART_BYTES) -> dict:
    """Counts docs' texts (null: empty) and writes the model; returns what scoring needs. folder must be a path that
    driver and workers share and can open (by default one below spark.checkpoint.dir, if that is a file path)."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "lm")
    if urlparse(folder).scheme not in ("", "file"):
        raise ValueError(f"workers map the model's files: {folder} is no mounted path, give one as folder")
    folder = urlparse(folder).path
    os.makedirs(folder)
    size = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    words = word_counts(docs, column, n)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.frombuffer(x, "<u8") for x in batch["b"].to_pylist()]
            yield pa.record_batch([pa.array([int(c.sum()) for c in counts]), pa.array([len(c) for c in counts])], names=["n", "v"])

    row = words.mapInArrow(totals, "n long, v long").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n_tokens, vocabulary = row.n or 0, row.v or 0

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
                yield pa.record_batch([pa.array(np.frombuffer(a, "<i8")[np.frombuffer(b, "<u8") > n_tokens // max(1000, 4 * n)])], names=["word"])

    hot = np.array(sorted(r.word for r in words.mapInArrow(frequent, "word long").collect()), np.int64).view(np.uint64)  # at most a thousand, or four for each part
    hot = np.append(hot, BEGIN)

    def pairs(key: tuple, table: pa.Table) -> pa.Table:
        u = np.repeat(np.frombuffer(b"".join(table["a"].to_pylist()), "<u8"), read_u4(b"".join(table["b"].to_pylist())))
        v = from_low(b"".join(table["c"].to_pylist()))
        counts = read_u4(b"".join(table["d"].to_pylist()))
        keys = pair_keys(u, v)
        by = np.argsort(keys, kind="stable")
        at = np.nonzero(np.diff(keys[by], prepend=keys[by[:1]] + np.uint64(1)))[0]
        counts, u, v, keys = np.add.reduceat(counts[by], at), u[by[at]], v[by[at]], keys[by[at]]
        save(f"{folder}/pairs-{key[0].as_py()}.keys.npy", keys)
        save(f"{folder}/pairs-{key[0].as_py()}.counts.npy", counts.astype(np.uint64))
        rows = [(-1, b"", b"", np.bincount(np.minimum(counts, 5), minlength=6)[:5].astype("<i8").tobytes(), np.int64(len(counts)).tobytes())]
        v, followed = added(v, np.ones(len(v), np.int64))
        rows += [(p, low_bytes(v[s]), u4(followed[s]), b"", b"") for p, s in slices(parts_of(v, n))]  # parts rise with v
        u, *kinds = added(u, counts == 1, counts == 2, counts > 2) if len(u) else (u, u, u, u)
        by = np.argsort(part := parts_of(u, n), kind="stable")
        u, kinds, part = u[by], np.stack(kinds, axis=1)[by], part[by]
        rows += [(p, b"", b"", u[s].tobytes(), u4(kinds[s])) for p, s in slices(part)]
        return pa.Table.from_batches([packed(rows)])

    statistics = written(pair_counts(docs, column, hot, n).groupBy("part").applyInArrow(pairs, PACKED), "pairs")

    def table_of_words(key: tuple, table: pa.Table) -> pa.Table:
        col = {x: table[x].to_pylist() for x in "abcd"}
        kind = table["kind"].to_pylist()
        pick = lambda x, k: b"".join(y for y, own in zip(col[x], kind, strict=True) if own == k)
        words, counts = added(np.frombuffer(pick("a", 0), "<u8"), np.frombuffer(pick("b", 0), "<u8").astype(np.int64))
        lows, followed = added(from_low(pick("a", 1)), read_u4(pick("b", 1)))
        contexts = np.frombuffer(pick("c", 1), "<u8")
        kinds = read_u4(pick("d", 1)).reshape(-1, 3)
        contexts, *kinds = added(contexts, *kinds.T)
        keys = np.union1d(words, contexts)
        values = np.zeros((len(keys), 5), np.int64)
        at = np.searchsorted(keys, words)
        values[at, 0] = counts
        if len(lows):
            k = np.minimum(np.searchsorted(lows, words & LOW), len(lows) - 1)
            values[at, 1] = np.where(lows[k] == words & LOW, followed[k], 0)
        for j, x in enumerate(kinds):
            values[np.searchsorted(keys, contexts), 2 + j] = x
        save(f"{folder}/words-{key[0].as_py()}.keys.npy", keys)
        save(f"{folder}/words-{key[0].as_py()}.values.npy", values)
        seen = np.bincount(np.minimum(values[at, 1], 5).astype(np.int64), minlength=6)[:5]
        return pa.table({"n": [seen.tolist()]}, schema=pa.schema([("n", pa.list_(pa.int64()))]))

    both = words.withColumn("kind", F.lit(0)).unionByName(statistics.where("part >= 0").withColumn("kind", F.lit(1)))
    seen = both.groupBy("part").applyInArrow(table_of_words, "n array<bigint>").agg(*[F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(5)]).first()
    of_pairs, n_pairs = np.zeros(5, np.int64), 0
    for r in statistics.where("part < 0").select("c", "d").collect():  # a row of 48 bytes for each part
        of_pairs += np.frombuffer(bytes(r.c), "<i8")
        n_pairs += int(np.frombuffer(bytes(r.d), "<i8")[0])
    of_words = [int(x or 0) for x in seen]
    d_words = discounts(of_words[1:])
    followed = vocabulary - of_words[0]
    left = (d_words[0] * of_words[1] + d_words[1] * of_words[2] + d_words[2] * max(0, followed - of_words[1] - of_words[2])) / max(1, n_pairs)
    return {"folder": folder, "parts": n, "hot": hot, "tokens": n_tokens, "vocabulary": vocabulary, "pairs": n_pairs, "d_pairs": discounts(of_pairs[1:].tolist()), "d_words": d_words, "left": left if n_pairs else 1.0}


@lru_cache(maxsize=1 << 14)  # systems bound the mappings of a process
def _mapped(path: str) -> np.ndarray | None:
    return np.load(path, mmap_mode="r") if os.path.exists(path) else None


def look_up(folder: str, kind: str, values: str, part: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
    """Values of the keys (0 where unknown), searched part by part in rising order."""
    out = np.zeros((len(keys), width), np.int64)
    by = np.lexsort((keys, part))
    for p, s in slices(part[by]):
        known = _mapped(f"{folder}/{kind}-{p}.keys.npy")
        if known is None or not len(known):
            continue
        own = keys[by[s]]
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        found = known[at] == own
        out[by[s][found]] = np.asarray(_mapped(f"{folder}/{kind}-{p}.{values}.npy")[at[found]]).reshape(-1, width)
    return out


def log_probabilities(model: dict, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of each token's probability after its context, and the token's count."""
    n, folder, v_low = model["parts"], model["folder"], v & LOW
    words, at = np.unique(np.concatenate([v, u, [END]]), return_inverse=True)
    values = look_up(folder, "words", "values", parts_of(words, n), words, 5)
    counts, of_v, of_u = values[:, 0], at[: len(v)], at[len(v) : -1]
    grade = lambda c, d: np.array([0.0, *d])[np.minimum(c, 3)]
    followed = values[of_v, 1]
    lower = (followed - grade(followed, model["d_words"])) / max(1, model["pairs"]) + model["left"] / (model["vocabulary"] + 1)
    keys, first, back = np.unique(pair_keys(u, v_low), return_index=True, return_inverse=True)
    pairs = look_up(folder, "pairs", "counts", pair_parts(u[first], v_low[first], model["hot"], n), keys, 1)[back, 0]
    total = np.where(u == BEGIN, counts[at[-1]], counts[of_u])
    gamma = np.where(total > 0, (values[of_u, 2:] * model["d_pairs"]).sum(axis=1) / np.maximum(total, 1), 1.0)
    return np.log10((pairs - grade(pairs, model["d_pairs"])) / np.maximum(total, 1) + gamma * lower), counts[of_v]


SCORED = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SCORED_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score(docs: DataFrame, model: dict, column: str = "text") -> DataFrame:
    """Per row of docs: doc_id, tokens with the end, tokens seen in training, add-one unigram and model log10 probability.

    A null or empty text is its end token alone; repeated rows each get their result; other columns are left out.
    Without training text every token has probability 1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for block in T.blocks(batches, column, SCORE_BYTES):
            u, v, first = token_block(block[column])
            parts = [slice(at, at + TOKENS_AT_ONCE) for at in range(0, len(v), TOKENS_AT_ONCE)]
            logs, counts = (np.concatenate(x) for x in zip(*(log_probabilities(model, u[s], v[s]) for s in parts), strict=True))
            base = np.log10((counts + 1) / (model["tokens"] + model["vocabulary"] + 1))
            rows = len(first) - 1
            sums = [np.add.reduceat(x, first[:-1]) for x in (counts > 0, base, logs)]
            yield pa.record_batch([block["doc_id"].cast(pa.int64()), pa.array(np.diff(first)), pa.array(sums[0].astype(np.int64)), pa.array(np.full(rows, model["tokens"])), pa.array(sums[1]), pa.array(sums[2])], schema=SCORED_ARROW)

    return docs.select("doc_id", column).mapInArrow(run, SCORED)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return score(docs, train(docs.where(~held).select("text"))).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
