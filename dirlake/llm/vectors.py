"""Embeddings as integer vectors, for the operators that need exact arithmetic."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integer components lie within these bounds, so that sums of squares and of rows stay exact in 64 bits.
LARGEST = 1 << 24


def usable(embedding: str = "embedding") -> Column:
    """Whether a vector is there and all its components are finite numbers; an empty one is usable."""
    return F.coalesce(F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(column: pa.Array, scale: float = 256) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of all components of a list column without nulls, one vector after the other, and the n + 1 offsets."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return np.clip(np.floor(flat * scale), -LARGEST, LARGEST).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def dense(flat: np.ndarray, offsets: np.ndarray, width: int = 0) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones end with zeros."""
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out
