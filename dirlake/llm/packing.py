"""Operator 9: packing token ids into sequences by sum of squares.

Each task packs its own documents as they come. Whole windows of a long document fill sequences of their own. Its
rest of s tokens goes to the fill level h (0: a new window) for which the sum over levels of the squared number of
partly filled windows grows least; level arrays hold these numbers and the windows of each level. When more than
max_open windows are open, and at the end of the task, what open windows hold is cut freely to fill windows to the
brim; the last rest is cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .tokens import default_path, word_encoder

PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
PIECE_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


class Packer:
    """Pieces are (doc_id, start, doc_tokens, ids); a finished sequence is a list of them."""

    def __init__(self, size: int, max_open: int):
        self.size, self.max_open = size, max_open
        self.count = np.zeros(size, np.int64)
        self.windows: list[list[list]] = [[] for _ in range(size)]
        self.open = 0

    def level(self, s: int) -> int:
        """The fill level whose window takes s tokens: least growth of the sum of squares, then the fullest."""
        h = np.arange(1, self.size - s + 1)
        h = h[self.count[1 : self.size - s + 1] > 0]
        after = h + s
        growth = np.where(after < self.size, 2 * self.count[np.minimum(after, self.size - 1)] + 1, 0) - 2 * self.count[h] + 1
        best = len(h) - 1 - int(np.argmin(growth[::-1])) if len(h) else 0
        return int(h[best]) if len(h) and growth[best] <= 2 * self.count[s] + 1 else 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[list[tuple]]:
        n = len(ids) // 4
        full = n - n % self.size
        for at in range(0, full, self.size):
            yield [(doc_id, at, n, ids[4 * at : 4 * (at + self.size)])]
        if s := n - full:
            h = self.level(s)
            window = self.windows[h].pop() if h else []
            self.count[h] -= h > 0
            self.open -= h > 0
            window.append((doc_id, full, n, ids[4 * full :]))
            if h + s == self.size:
                yield window
            else:
                self.windows[h + s].append(window)
                self.count[h + s] += 1
                self.open += 1
            if self.open > self.max_open:
                yield from self.drain(False)

    def drain(self, last: bool) -> Iterator[list[tuple]]:
        """Cuts what open windows hold into full windows; the rest stays open, or is cut by powers of two if last."""
        pieces = [p for level in reversed(self.windows) for w in level for p in w]
        self.__init__(self.size, self.max_open)
        left = sum(len(p[3]) for p in pieces) // 4
        window, room = [], 0
        for doc_id, start, n, ids in pieces:
            while ids:
                if not room:
                    if left < self.size and not last:
                        window = []
                    room = min(self.size, 1 << left.bit_length() - 1) if last else self.size
                take = min(room, len(ids) // 4)
                window.append((doc_id, start, n, ids[: 4 * take]))
                ids, start, room, left = ids[4 * take :], start + take, room - take, left - take
                if not room:
                    yield window
                    window = []
        if window:
            fill = self.size - room
            self.windows[fill].append(window)
            self.count[fill], self.open = 1, 1


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 4096, max_open: int = 1024) -> DataFrame:
    """Pieces of the sequences that docs (doc_id, text) are packed into, with their ids (binary, unsigned 32-bit).

    A null or empty text is its end id alone; rows that share a doc_id are documents of their own; other columns are
    left out. sequence_id holds the task's number above 32 bits; offset is the piece's place in its sequence. A task
    keeps at most max_open windows and one block of text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        packer, sequence = Packer(size, max_open), TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def put(windows: Iterator[list[tuple]]) -> int:
            nonlocal sequence
            for window in windows:
                at = 0
                for doc_id, start, n, ids in window:
                    rows.append((doc_id, start, len(ids) // 4, n, sequence, at, ids))
                    at += len(ids) // 4
                sequence += 1
            return len(rows)

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, PIECE_ARROW, strict=True)], schema=PIECE_ARROW)

        for block in T.blocks(batches, "text"):
            for doc_id, x in zip(block["doc_id"].to_pylist(), encoder.encode(block["text"]), strict=True):
                if put(packer.add(doc_id, x + end)) >= 2000:
                    yield batch()
        if put(packer.drain(True)):
            yield batch()

    return docs.select("doc_id", "text").mapInArrow(run, PIECE)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece of all documents."""
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
