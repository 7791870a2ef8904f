"""The prefix trie against a brute-force version."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from dirlake.llm import trie


def brute_trie(rows, family=5, most=9):
    """Nodes of rows (conv_id, turn, role, text), as sorted tuples; without a family conversations stay as they are."""
    own = collections.defaultdict(list)
    for c, *x in rows:
        if c is not None:
            own[c].append((x[0] is not None, x[0] or 0, x[1] or "", x[2] or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most if family else 0
        convs[c] = (own.get(c - int(math.fmod(c, family)), [])[:h] + turns[h:]) if family else turns
    members = collections.defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    below = collections.defaultdict(lambda: [0, 0, 0])  # children, leaves, saved
    for n in members:
        if n:
            below[n[:-1]][0] += 1
    for n, m in members.items():
        saved, leaf = (len(m) - 1) * len(n[-1][1].encode()) if n else 0, n not in below or not below[n][0]
        for d in range(len(n) + 1):
            below[n[:d]][1] += leaf
            below[n[:d]][2] += saved
    digest = lambda n, m: hashlib.sha256(",".join(str(c) for c in m if tuple(convs[c]) == n).encode()).hexdigest()
    return sorted(((m[0], len(n), members[n[:-1]][0] if n else None, len(m), *below[n], digest(n, m)) for n, m in members.items()), key=repr)


def conversations(n, seed):
    r = random.Random(seed)
    words = ["", "a", "b", "é🙂", "a,b"]
    rows = [(c, t, r.choice(["user", "assistant"]), r.choice(words)) for c in range(n) for t in range(r.choice([0, 1, 3, 8, 12, 14]))]
    rows += [(c, t, "user", "same") for c in range(n, n + 40) for t in range(10)]  # copies
    rows += [(1000, t, "user", "x" * (t % 3)) for t in range(60)]
    rows += [(2001, None, None, None), (2001, None, "user", "b"), (2001, 3, "user", "b"), (2001, 3, "user", "b"), (2002, 1, "", "u"), (2003, 1, "u", ""), (None, 1, "user", "x"), (None, None, None, None)]
    rows += [(70000, t, "user", "same") for t in range(10)] + [(140000 + c, t, "user", "same") for c in range(3) for t in range(10)]
    return rows


@pytest.mark.parametrize("family", [0, 5])
def test_trie(spark, monkeypatch, family):
    monkeypatch.setattr(trie, "PIECE", 4)  # long conversations are cut into many pieces
    rows = conversations(60, family)
    df = spark.createDataFrame([(*x, 1, "d") for x in rows], "conv_id long, turn long, role string, text string, depth int, total string").repartition(3)
    got = trie.prefix_trie(df, trie.shared_starts) if family else trie.prefix_trie(df)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(rows, family)


def test_collisions_are_split(spark):
    """Turns of a few bits make groups of different prefixes; lanes are added until each group is of one."""
    rows = conversations(12, 3)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for modulus in (2, 5):
        got = trie.prefix_trie(df, lanes=1, modulus=modulus)
        assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(rows, 0)


def test_groups_are_verified(spark, monkeypatch):
    """With bases of 1 a fingerprint doesn't know the order of turns: groups collide though turns don't."""
    real = trie.base
    monkeypatch.setattr(trie, "base", lambda lane: 1 if lane == 0 else real(lane))
    rows = [(1, 1, "u", "a"), (1, 2, "u", "b"), (1, 3, "u", "c"), (2, 1, "u", "b"), (2, 2, "u", "a"), (2, 3, "u", "c"), (3, 1, "u", "a")]
    got = trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), lanes=1)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(rows, 0)


def test_awkward_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.prefix_trie(spark.createDataFrame([], schema), trie.shared_starts).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], schema)).count() == 0
    for rows in ([(6, 1, "user", "x")], [(c, 1, "user", "é" * 100_000) for c in range(5)], [(c, t, None, None) for c in (-5, -3, 0, 4) for t in range(9)]):
        got = trie.prefix_trie(spark.createDataFrame(rows, schema), trie.shared_starts)
        assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(rows)


def test_prefix_sums():
    terms = np.array([trie.P - 1] * 9 + [5], np.uint64)
    first = np.array([1, 0, 0, 1, 0, 0, 0, 0, 0, 0], bool)
    sums = trie.prefix_sums(terms, first)
    want, s = [], 0
    for x, f in zip(terms.tolist(), first.tolist(), strict=True):
        s = (0 if f else s) + x
        want.append(s % trie.P)
    assert sums.tolist() == want
    assert trie.powers(1, 5, 7).tolist() == [pow(trie.base(1), 5 + i, trie.P) for i in range(7)]
