"""Token ids of whole texts by the tokenizers library, inside Spark tasks.

For tokenizers whose pre-tokenizer drops white space and never joins its two sides (word_bpe_49k.json), a text's ids are
those of its pre-tokens in order. Texts of ASCII and Latin-1 letters are cut into pre-tokens here, by the tokenizer's
own pattern, on whole blocks at once; the library encodes each distinct pre-token, whose ids are then remembered.
Texts with any other character, or with strings that could be added tokens, go to the library whole. Tests compare
the result with encoding each text by the library alone.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import text as T

#: Pre-tokens remembered by a worker; beyond, it starts anew.
MEMO_WORDS = 600_000
_SPACE, _LETTER, _DIGIT, _OTHER, _FOREIGN = range(5)
CLASS = np.full(256, _FOREIGN, np.uint8)
CLASS[[9, 10, 13, 32]] = _SPACE
CLASS[33:127] = _OTHER
CLASS[48:58] = _DIGIT
CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER


def classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes of texts and the class of each. Both bytes of a Latin-1 letter are letters."""
    kind, low = CLASS[data], T.LOWER[data]
    lead = np.nonzero(data[:-1] == 0xC3)[0]
    second = data[lead + 1]
    ok = (second >= 0x80) & (second <= 0xBF)
    lead, second = lead[ok], second[ok]
    sign = (second == 0x97) | (second == 0xB7)  # the signs for times and divided by
    kind[lead] = kind[lead + 1] = np.where(sign, _OTHER, _LETTER)
    upper = (second <= 0x9E) & ~sign
    low[lead[upper] + 1] += 0x20
    return low, kind


def pretoken_starts(low: np.ndarray, kind: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin: runs of letters, single digits, runs of others; 's 't 're 've 'm 'll 'd at a run's start."""
    start = np.ones(len(kind), bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT) | edge[1:-1]
    start[kind == _SPACE] = False
    q = np.nonzero((low[:-1] == 39) & start[:-1] & (kind[1:] == _LETTER) & ~edge[1:-1])[0]
    if len(q):
        c, after = low[q + 1], np.minimum(q + 2, len(low) - 1)
        d = np.where((q + 2 < len(low)) & ~edge[q + 2], low[after], 0)
        pair = ((c == 114) | (c == 118)) & (d == 101) | (c == 108) & (d == 108)
        n = np.where(np.isin(c, [115, 116, 109, 100]), 1, np.where(pair, 2, 0))
        q, n = q[n > 0], n[n > 0]
        start[q + 1] = False
        rest = q + 1 + n
        rest = rest[rest < len(low)]
        start[rest[kind[rest] != _SPACE]] = True
    return start


class WordEncoder:
    """Texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if "'s|'t|'re|'ve|'m|'ll|'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" not in json.dumps(spec["pre_tokenizer"]) or any(not x["content"].startswith("<|") for x in spec["added_tokens"]):
            raise ValueError("this tokenizer cuts texts by another pattern")
        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for x, i in self.tokenizer.get_vocab().items() if x.endswith(spec["model"]["end_of_word_suffix"])]] = True
        self.forget()

    def forget(self) -> None:
        """Known pre-tokens: their hashes in order, their bytes, and where their ids begin and end in one array."""
        self.keys, self.begin, self.size, self.ids = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)
        self.known = np.empty(0, object)

    def learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Encodes pre-tokens in one text; each ends with the one token that closes a word."""
        ids = np.array(self.tokenizer.encode(b" ".join(words).decode(), add_special_tokens=False).ids, np.uint32)
        ends = np.nonzero(self.ends[ids])[0] + 1
        if len(ends) != len(words):
            raise ValueError("pre-tokens and ends of words differ in number")
        begin = np.concatenate([[0], ends[:-1]])
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.known = np.insert(self.known, at, np.array([*words, b""], object)[:-1])
        self.begin = np.insert(self.begin, at, begin + len(self.ids))
        self.size = np.insert(self.size, at, ends - begin)
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, column: pa.Array) -> list[bytes]:
        """Ids of each text of a string column; null counts as empty. A long text is encoded by pieces, cut before white space."""
        data, offsets = T.text_bytes(column)
        if not len(data) or np.diff(offsets).max() <= T.PIECE_BYTES:
            return self.encode_block(column)
        texts = (data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))
        return [b"".join(self.encode_block(pa.array([x.tobytes()], pa.binary()).cast(pa.string()))[0] for x in T.cut_at_spaces(text, T.PIECE_BYTES)) for text in texts]

    def encode_block(self, column: pa.Array) -> list[bytes]:
        data, offsets = T.text_bytes(column)
        out = [b""] * len(column)
        if not len(data):
            return out
        low, kind = classes(data)
        added = np.concatenate([(low[:-1] == 60) & (low[1:] == 124), [False]])
        odd = np.concatenate([[0], np.cumsum((kind == _FOREIGN) | added)])
        whole = np.nonzero(odd[offsets[1:]] > odd[offsets[:-1]])[0]
        for i, e in zip(whole, self.tokenizer.encode_batch_fast(column.take(pa.array(whole)).to_pylist(), add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts = np.nonzero(pretoken_starts(low, kind, edge))[0]
        plain = np.ones(len(column), bool)
        plain[whole] = False
        starts = starts[plain[np.searchsorted(offsets, starts, side="right") - 1]]
        space = np.append(np.nonzero((kind == _SPACE) | edge[:-1])[0], len(data))
        after = space[np.searchsorted(space, starts, side="right")]
        ends = np.minimum(np.append(starts[1:], len(data)), after)
        keys, first, back = np.unique(T.span_hashes(T.prefix_sums(low), starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > MEMO_WORDS:
            self.forget()
        k = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = self.keys[k] != keys if len(self.keys) else np.ones(len(keys), bool)
        raw = low.tobytes()
        own = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        if new.any():
            self.learn(keys[new], [x for x, n in zip(own, new.tolist(), strict=True) if n])
            k = np.searchsorted(self.keys, keys)
        if any(x != y for x, y in zip(own, self.known[k].tolist(), strict=True)) or ((ends - starts) != (ends - starts)[first][back]).any():  # equal hashes of different strings
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([x or "" for x in column.to_pylist()], add_special_tokens=False)]
        k = k[back]
        size = self.size[k]
        until = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.begin[k] - until[:-1], size) + np.arange(until[-1])].astype("<u4", copy=False).tobytes()
        bounds = (until[np.searchsorted(starts, offsets)] * 4).tolist()
        for i in np.nonzero(plain)[0].tolist():
            out[i] = ids[bounds[i] : bounds[i + 1]]
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
