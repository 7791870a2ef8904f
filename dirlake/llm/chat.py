"""Operator 3: conversations as training text and tokens, with a loss mask.

Each turn is a run of segments: marks, which become reserved ids above the vocabulary, and texts, which are encoded on
their own, so that no token spans a mark. The loss mask is the running sum of +1 where an assistant's text begins and
-1 where it ends. Strings in a text that equal a mark, also with backslashes after their first character, get one more
backslash there; taking one away gives the text again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T

#: Marks, in the order of their reserved ids.
MARKS = ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[END]")
#: Opening and closing mark of the known roles; the name of any other stands between [ROLE] and [/ROLE].
ROLES = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
_ENDS = "|".join(re.escape(m[1:]) for m in MARKS)
_PLAIN, _ESCAPED = re.compile(rf"([<\[])(\\*(?:{_ENDS}))"), re.compile(rf"([<\[])\\(\\*(?:{_ENDS}))")
TURN = "conv_id long, place long, turn long, role string, formatted string, first_token long, ids array<int>, loss array<boolean>"
TURN_ARROW = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("first_token", pa.int64()), ("ids", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_()))])
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
READ_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def escape(x: str) -> str:
    return _PLAIN.sub(r"\1\\\2", x)


def unescape(x: str) -> str:
    return _ESCAPED.sub(r"\1\2", x)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t, t.get_vocab_size()


def segments(role: str, text: str) -> tuple[list[str], list[bool]]:
    """Marks and escaped texts in turn order, and which of them are marks."""
    if role in ROLES:
        opening, closing = ROLES[role]
        return [opening, escape(text), closing], [True, False, True]
    return ["[ROLE]", escape(role), "[/ROLE]", escape(text), "[END]"], [True, False, True, False, True]


def format_chats(turns: DataFrame, tokenizer: str) -> DataFrame:
    """One row a turn: formatted text, token ids, loss mask, and the turn's place and first token in its conversation.

    turns has conv_id, turn, role, text; other columns are left out. Rows go by turn (null first); rows of the same
    turn by role and text; repeated rows are turns of their own. A null text or role counts as empty, an unknown role
    is kept by name, and rows without conv_id form a conversation of their own. Only texts of the role assistant are
    under the loss mask. A conversation of any length streams through its task, sorted by Spark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, vocabulary = _tokenizer(tokenizer)
        mark_ids = {m: vocabulary + i for i, m in enumerate(MARKS)}
        at: tuple | None = None
        place = first = 0
        for block in T.blocks(batches, "text"):
            rows = block.to_pylist()
            parts = [segments(r["role"] or "", r["text"] or "") for r in rows]
            texts = iter(coder.encode_batch_fast([s for segs, marks in parts for s, m in zip(segs, marks, strict=True) if not m], add_special_tokens=False))
            out = []
            for r, (segs, marks) in zip(rows, parts, strict=True):
                if at != (r["conv_id"],):
                    at, place, first = (r["conv_id"],), 0, 0
                ids = [[mark_ids[s]] if m else next(texts).ids for s, m in zip(segs, marks, strict=True)]
                ends = np.cumsum([len(x) for x in ids])
                change = np.zeros(ends[-1] + 1, np.int64)
                if r["role"] == "assistant":
                    np.add.at(change, [ends[0], ends[1]], [1, -1])
                out.append({"conv_id": r["conv_id"], "place": place, "turn": r["turn"], "role": r["role"] or "", "formatted": "".join(segs), "first_token": first, "ids": [i for x in ids for i in x], "loss": (np.cumsum(change)[:-1] > 0).tolist()})
                place, first = place + 1, first + int(ends[-1])
            yield pa.RecordBatch.from_pylist(out, TURN_ARROW)

    by = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").repartition("conv_id")
    return by.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, TURN)


def read_turn(ids: list[int], loss: list[bool], coder, vocabulary: int) -> tuple[str, str, str]:
    """Role, text and text under the mask, from a turn's ids alone."""
    a = np.array(ids)
    at = np.nonzero(a >= vocabulary)[0]
    marks = [MARKS[i - vocabulary] for i in a[at]]
    texts = [unescape(coder.decode(a[x + 1 : y].tolist(), skip_special_tokens=False)) for x, y in zip(at, at[1:], strict=False)]
    role = next((r for r, m in ROLES.items() if list(m) == marks), None)
    return texts[0] if role is None else role, texts[-1], unescape(coder.decode(a[np.array(loss, bool)].tolist(), skip_special_tokens=False))


def read_chats(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """Per conversation, from what format_chats returned: turns, digests of turns and of loss text, lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, vocabulary = _tokenizer(tokenizer)
        at, out = None, []
        n, turns, loss, loss_chars, chars = 0, hashlib.sha256(), hashlib.sha256(), 0, 0
        for block in T.blocks(batches, "formatted"):
            for r in block.to_pylist():
                if at != (r["conv_id"],):
                    if at:
                        out.append((at[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    at, n, turns, loss, loss_chars, chars = (r["conv_id"],), 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                role, text, learnt = read_turn(r["ids"], r["loss"], coder, vocabulary)
                n, loss_chars, chars = n + 1, loss_chars + len(learnt), chars + len(r["formatted"])
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(learnt.encode())
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(READ_ARROW.names, x, strict=True)) for x in out], READ_ARROW)
                out = []
        if at:
            yield pa.RecordBatch.from_pylist([dict(zip(READ_ARROW.names, (at[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars), strict=True))], READ_ARROW)

    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(run, READ)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are control strings, formatted and read back."""
    import public_tokenizers

    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    path = public_tokenizers.path("byte_bpe_50k.json")
    return read_chats(format_chats(turns, path), path)
