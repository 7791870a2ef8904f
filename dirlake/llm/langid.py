"""Operator 8: language ID by cross-parsing with suffix automata.

A sample of labelled text for each language becomes a suffix automaton, kept as a table of transitions. A text is cut
greedily into phrases, each the longest match with the language's sample (or one unknown symbol). The number of
phrases times the binary logarithm of the sample's length, over the text's length, estimates the cross entropy; the
language with the least wins. Texts are folded to symbols first: letters in lower case, combining marks, all else as single gaps. The
parse starts anew after every LANE symbols, so that numpy can follow many lanes at once.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from . import text as T

#: Symbols: gap, then each letter and mark of the samples, then any mark and any letter never learnt, then the end of a lane.
LANE = 256
#: The sample for each language: documents, and characters of each. It bounds the fit; no statistic comes from it.
SAMPLE_DOCS, SAMPLE_CHARS = 48, 1024
FOUND = "lang_pred string, score double"


#: Steps are next state * columns, with the phrases ended above so many bits. Larger tables than DENSE are kept sparse.
ENDED, DENSE = 48, 1 << 22


@dataclass
class Table:
    """Steps of one language's parse. Columns are its own letters; those it hasn't share one; the last ends a lane."""

    column: np.ndarray  # of each symbol
    root: np.ndarray  # steps from the root
    keys: np.ndarray | None  # sorted state * columns + column of the transitions; None if steps has all states and columns
    steps: np.ndarray

    def follow(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        column = self.column[symbols]
        at = state + column
        if self.keys is None:
            return self.steps[at]
        k = np.minimum(np.searchsorted(self.keys, at), len(self.keys) - 1)
        end = (state > 0).astype(np.int64) << ENDED
        missed = np.where(column == len(self.root) - 1, end, self.root[column] + end)
        return np.where(self.keys[k] == at, self.steps[k], missed)


@dataclass
class Model:
    languages: list[str]
    fold: np.ndarray  # symbol of each code point
    width: int  # number of symbols
    letters: np.ndarray  # whether each symbol is a letter
    tables: list[Table]
    bits: list[float]


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is its root."""
    to: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return to


def transitions(symbols: list[int], width: int) -> Table:
    """Every step of the greedy parse: on a mismatch the phrase ends and the symbol begins the next one."""
    to = automaton(symbols)
    own = sorted(to[0])
    n = len(own) + 2
    column = np.full(width, n - 2, np.int64)
    column[own] = np.arange(len(own))
    column[width - 1] = n - 1
    root = np.full(n, 1 << ENDED, np.int64)  # an unknown symbol is a phrase of its own
    root[: len(own)] = [to[0][c] * n for c in own]
    root[n - 1] = 0
    keys = np.array([s * n + int(column[c]) for s, x in enumerate(to) for c in x], np.int64)
    steps = np.array([t * n for x in to for t in x.values()], np.int64)
    if len(to) * n > DENSE:
        by = np.argsort(keys)
        return Table(column, root, keys[by], steps[by])
    table = np.tile(root + (1 << ENDED), len(to))
    table[:n] = root
    table[keys] = steps
    return Table(column, root, None, table)


def kind(c: str) -> str:
    """L of a letter, M of a mark that combines with letters."""
    return unicodedata.category(c)[0]


def plain(c: str) -> str:
    """What stands for a letter or mark: the first one of its lower-case compatibility form (i of the dotted capital)."""
    return next((x for x in unicodedata.normalize("NFKC", c).lower() if kind(x) in "LM"), c)


def fold_table(samples: dict[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbol of each code point, and whether each symbol is a letter."""
    seen = Counter(c for x in samples.values() for c in unicodedata.normalize("NFC", x) if kind(c) in "LM")
    learnt = Counter()
    for c, n in seen.items():
        learnt[plain(c)] += n
    known = {c: i + 1 for i, (c, _) in enumerate(learnt.most_common())}
    letters = np.array([False, *(kind(c) == "L" for c in known), False, True, False])
    fold = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if (k := kind(c)) in "LM":
            fold[code] = known.get(plain(c), len(known) + 1 + (k == "L"))
    return fold, letters


def folded(fold: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts, one after the other, and how many each text has. Runs of gaps are one gap."""
    texts = [unicodedata.normalize("NFC", x) for x in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    symbols = fold[codes]
    of = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] > 0) | (symbols[:-1] > 0) | (of[1:] != of[:-1])
    return symbols[keep], np.bincount(of[keep], minlength=len(texts))


def fit(samples: dict[str, str]) -> Model:
    """samples: labelled text of each language."""
    fold, letters = fold_table(samples)
    width = len(letters)
    tables, bits = [], []
    for x in samples.values():
        symbols, _ = folded(fold, [x])
        tables.append(transitions(symbols.tolist(), width))
        bits.append(float(np.log2(max(2, len(symbols)))))
    return Model(list(samples), fold, width, letters, tables, bits)


def phrases(model: Model, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Phrases of each text (rows) in each language (columns)."""
    lanes = -(-sizes // LANE)
    first = np.cumsum(lanes) - lanes
    within = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    grid = np.full((LANE + 1, int(lanes.sum())), model.width - 1, np.uint32)
    grid[within % LANE, np.repeat(first, sizes) + within // LANE] = symbols
    out = np.zeros((len(sizes), len(model.languages)))
    for k, table in enumerate(model.tables):
        state = np.zeros(grid.shape[1], np.int64)
        count = np.zeros(grid.shape[1], np.int64)
        for symbol in grid:
            step = table.follow(state, symbol)
            count += step >> ENDED
            state = step & ((1 << ENDED) - 1)
        total = np.concatenate([[0], np.cumsum(count)])
        out[:, k] = total[first + lanes] - total[first]
    return out


def sample(labelled: DataFrame, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Labelled text (text, lang, key) of each language: of the `docs` rows with the least hashes of key, `chars` each, from a place drawn by hash."""
    usable = labelled.where("lang is not null and text is not null and key is not null")
    counts = usable.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return {}
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 8 * docs / r["count"])))])
    few = usable.withColumn("h", F.xxhash64("key")).where(F.pmod("h", F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "key", "text"))).where(F.col("n") <= docs)
    out: dict[str, str] = {}
    start = F.pmod(F.xxhash64("h", "key"), F.greatest(F.char_length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    for r in few.select("lang", F.substring("text", start, F.lit(chars)).alias("text")).orderBy("lang", "n").collect():  # at most docs * chars for each language
        out[r.lang] = out.get(r.lang, "") + " " + r.text
    return out


def identify(docs: DataFrame, model: Model, column: str = "text") -> tuple[DataFrame, str]:
    """docs with one more column, whose name is returned: struct(lang_pred, score).

    The language is `und` and the score 0 where text is null or empty or has no letter, or no language was learnt.
    Else the score is one less the winner's share of the second best language's entropy (1 if there is only one);
    of equal languages the first in the model wins. Repeated rows and other columns stay as they are.
    """
    name = "language"
    while name in docs.columns:
        name += "_"
    schema = S.StructType([*docs.schema.fields, S.StructField(name, S.StructType([S.StructField("lang_pred", S.StringType()), S.StructField("score", S.DoubleType())]))])
    found = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for block in T.blocks(batches, column):
            symbols, sizes = folded(model.fold, [x or "" for x in block[column].to_pylist()])
            lettered = np.add.reduceat(np.append(model.letters[symbols], False), np.minimum(np.cumsum(sizes) - sizes, len(symbols))) * (sizes > 0) > 0
            rates = phrases(model, symbols, sizes) * np.array(model.bits) / np.maximum(sizes, 1)[:, None] if model.languages else np.zeros((len(sizes), 0))
            rows = []
            for ok, own in zip(lettered, rates, strict=True):
                order = np.argsort(own, kind="stable")
                if not ok or not len(own):
                    rows.append({"lang_pred": "und", "score": 0.0})
                else:
                    rows.append({"lang_pred": model.languages[order[0]], "score": 1.0 if len(own) == 1 else float(1 - own[order[0]] / max(own[order[1]], 1e-9))})
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in range(len(block.schema))), pa.array(rows, found)], names=schema.names)

    return docs.mapInArrow(run, schema), name


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document; learnt from the documents that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = fit(sample(docs.where(~held).select("text", "lang", F.col("doc_id").alias("key"))))
    found, name = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), f"{name}.lang_pred", f"{name}.score")
