"""Words and hashes of whole Arrow text columns, computed on bytes with numpy inside Spark tasks.

Hash of a byte string: sum of (byte + 1) * BASE^position modulo the prime 2^61 - 1, taken from prefix sums, so that the
hash of any span costs one subtraction and one product; a finaliser then spreads the bits. Equal spans have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once. A longer document makes a block of its own, which is hashed by pieces of PIECE_BYTES.
BLOCK_BYTES = 1 << 20
PIECE_BYTES = 1 << 20
PRIME = np.uint64((1 << 61) - 1)
BASE = 0x9E3779B97F4A7C15 % int(PRIME)
#: Bytes whose sums are exact in 64 bits.
EXACT = 1 << 22
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Places of the words in a shingle get their own odd factors.
PLACES = np.random.default_rng(20240301).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def reduced(x: np.ndarray) -> np.ndarray:
    """64-bit numbers modulo PRIME."""
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.minimum(x, x - PRIME)  # below PRIME the difference wraps to a large number


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, from halves of 32 bits."""
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    a_low, a_high, b_low, b_high = a & low, a >> half, b & low, b >> half
    middle = a_high * b_low + a_low * b_high
    a_low *= b_low
    out = (a_low & PRIME) + (a_low >> np.uint64(61))
    out += (middle & np.uint64((1 << 29) - 1)) << half
    out += middle >> np.uint64(29)
    a_high *= b_high
    out += a_high << np.uint64(3)
    return reduced(out)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, int(PRIME))):
        p = np.ones(n, np.uint64)
        size = 1
        while size < n:
            p[size : 2 * size] = product(p[:size], np.uint64(pow(base, size, int(PRIME))))
            size *= 2
        out.append(p)
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo PRIME for i < n."""
    a, b = _powers(1 << max(21, int(n).bit_length()))
    return a[:n], b[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i], modulo PRIME, the unshifted hash of data[i:j]."""
    out = np.zeros(len(data) + 1, np.uint64)
    own = powers(len(data))[0]
    for at in range(0, len(data), EXACT):
        s = slice(at, min(len(data), at + EXACT))
        value = data[s].astype(np.uint64) + np.uint64(1)
        high = np.cumsum(value * (own[s] >> np.uint64(32)))
        value *= own[s] & np.uint64(0xFFFFFFFF)
        low = np.cumsum(value, out=value)  # below 2^62
        low += (high & np.uint64((1 << 29) - 1)) << np.uint64(32)
        low += high >> np.uint64(29)
        low += out[at]
        out[at + 1 : s.stop + 1] = reduced(low)
    return out


def span_sums(sums: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
    """Hashes of spans before their bits are spread: that of a + b is that of a plus BASE^len(a) times that of b."""
    gap = sums[ends] - sums[starts]
    return product(np.minimum(gap, gap + PRIME), powers(len(sums))[1][starts])


def span_hashes(sums: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
    return mix(span_sums(sums, starts, ends))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, one value after the other, and the n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    size = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, data = column.buffers()
    if places is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(places, size)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most limit bytes in the named text column each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def letters(separators: Iterable[int]) -> np.ndarray:
    """For each byte value: whether it belongs to a word."""
    out = np.ones(256, bool)
    out[list(separators)] = False
    return out


def cut_at_spaces(data: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[np.ndarray]:
    """Pieces of a text in UTF-8, cut before ASCII white space; of limit bytes at most, unless there is none for as long."""
    at = 0
    while len(data) - at > limit:
        low, to = at + max(1, limit // 2), at + limit
        space = np.nonzero(WHITE[data[low:to]])[0]
        if len(space):
            to = low + int(space[-1])
        else:
            while to < len(data) and not WHITE[data[to : to + limit]].any():
                to += limit
            to = to + int(WHITE[data[to : to + limit]].argmax()) if to < len(data) else len(data)
        yield data[at:to]
        at = to
    yield data[at:]


WHITE = np.zeros(256, bool)
WHITE[[9, 10, 13, 32]] = True
#: Words are all but the bytes of these ASCII characters; bytes of other characters are always part of words.
SPACED = letters([0x20, *range(0x09, 0x0E)])
ALNUM = letters([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word (A-Z as a-z), and the starts and ends of the words in data; words end where their text ends.

    Besides what it returns this takes memory for one piece of data; a word that goes on in the next piece is put together.
    """
    found: list[tuple] = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
    for at in range(0, len(data), PIECE_BYTES):
        sums, starts, ends = piece_words(data[at : at + PIECE_BYTES], offsets - at, table)
        starts += at
        ends += at
        before = found[-1]
        if len(starts) and len(before[2]) and starts[0] == at == before[2][-1] and offsets[np.searchsorted(offsets, at)] != at:
            size = pow(BASE, int(at - before[1][-1]), int(PRIME))
            before[0][-1] = (int(before[0][-1]) + size * int(sums[0])) % int(PRIME)
            before[2][-1] = ends[0]
            sums, starts, ends = sums[1:], starts[1:], ends[1:]
        if len(starts):
            found.append((sums, starts, ends))
    sums, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
    return mix(sums), starts, ends


def piece_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums (not spread), starts and ends of what lies in data of the words."""
    data = LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[np.searchsorted(offsets, 0) : np.searchsorted(offsets, len(data), side="right")]] = True
    starts = np.nonzero(inside[1:] & (~inside[:-1] | edge))[0]
    ends = np.nonzero(inside[:-1] & (~inside[1:] | edge))[0]
    return span_sums(prefix_sums(data), starts, ends), starts, ends


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size words, at its first word; runs are not kept apart by text."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out += hashes[j : j + n] * PLACES[j]
    return mix(out + PLACES[63 - size])


def firsts(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The n + 1 places in the list of words where each text's words begin."""
    return np.searchsorted(starts, offsets)
