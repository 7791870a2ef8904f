"""Exact top-k search and vector codes against brute force on small, awkward rows."""

import hashlib

import numpy as np
import pytest

from dirlake.llm import codebooks, topk

BAD = [None, [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, float("-inf")]]


def whole(v):
    return [int(np.floor(np.float64(256) * x)) for x in v]


def brute_top(rows, k, every):
    """(query_id, rank, vec_id, score) of rows (vec_id, vector), sorted."""
    kept = [(i, whole(v)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in kept:
        if q is not None and q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i is None, i or 0, i) for i, w in kept if i != q)
            out += [(q, n, i, -s) for n, (s, _, _, i) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind,block,group", [("float", 7, 3), ("double", 1000, 1000)])
def test_top_k(spark, kind, block, group):
    r = np.random.default_rng(5)
    x = np.where(r.random((120, 12)) < 0.7, 0, r.integers(-3, 4, (120, 12))) / 4  # sparse, with many ties
    x[:, 3] = r.normal(size=120).astype(np.float32)
    rows = [(i, [float(np.float32(v)) for v in vec]) for i, vec in enumerate(x)]
    rows += [(200 + i, v) for i, v in enumerate(BAD)] + [(210, []), (211, [2.0]), (None, rows[0][1]), (None, [1.0] * 12), (50, rows[7][1]), (60, rows[60][1]), (-10, rows[3][1]), (300, [1000.0] * 12), (301, [-60000.0] * 12), (302, [0.0] * 12)]
    df = spark.createDataFrame([(*v, "x", 1) for v in rows], f"vec_id long, embedding array<{kind}>, block string, cell int").repartition(5)
    got = topk.top_k(df, every=10, block_rows=block, group_rows=group)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_top(rows, 5, 10)
    few = df.where("vec_id in (0, 1, 2)")
    assert sorted(map(tuple, topk.top_k(few).collect()), key=repr) == brute_top(rows[:3], 5, 50)
    assert topk.top_k(df.where("vec_id = 0")).count() == 0 and topk.top_k(df.limit(0)).count() == 0


def test_best_over_blocks():
    """The k best of many blocks with equal scores are those of the smallest ids."""
    best = topk.Best(np.array([5]), 3)
    for ids in ([9, 30, 31], [5, 8, 40], [1, 2, 50]):
        block = topk.unpacked(topk.postings(np.array(ids), np.zeros(3, bool), np.ones((3, 4), np.int64)))
        best.add(block, np.ones((1, 4), np.int64))
    assert best.vec[0].tolist() == [1, 2, 8] and best.score[0].tolist() == [4, 4, 4]


def test_exponion_is_exact():
    r = np.random.default_rng(11)
    for spread, width in ((3, 2), (40, 4), (1 << 24, 3)):
        book = r.integers(-spread, spread + 1, (64, width))
        book[10] = book[50]
        parts = r.integers(-spread, spread + 1, (500, width))
        parts[:64] = book
        far = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
        for start in (np.zeros(500, np.int64), r.integers(0, 64, 500), far.argmax(axis=1)):
            best, dist = codebooks.nearest(parts, start, book, codebooks.neighbours(book))
            assert (best == far.argmin(axis=1)).all() and (dist == far.min(axis=1)).all()


def brute_codes(rows, parts, entries, rounds):
    """(vec_id, code, error, label_error) and the codebooks of rows (vec_id, vector, label)."""
    kept = [(i, whole(v), label, v) for i, v, label in rows if v and len(v) % parts == 0 and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda x: (x[0] is None, x[0] or 0, x[3]))
    kept = [x for x in kept if len(x[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _, _ in kept]
    books = [[list(x[p]) for x in cut[:entries]] for p in range(parts)]
    for n in range(rounds + 1):
        found = [[min((sum((a - b) ** 2 for a, b in zip(x[p], e, strict=True)), i) for i, e in enumerate(books[p])) for p in range(parts)] for x in cut]
        if n < rounds:
            for p in range(parts):
                for i in range(len(books[p])):
                    own = [x[p] for x, f in zip(cut, found, strict=True) if f[p][1] == i]
                    if own:
                        books[p][i] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    errors = [sum(d for d, _ in f) for f in found]
    label = lambda k: sum(e for e, x in zip(errors, kept, strict=True) if x[2] == k)
    return sorted([(x[0], [i for _, i in f], e, label(x[2])) for x, f, e in zip(kept, found, errors, strict=True)], key=repr), books


@pytest.mark.parametrize("kind,rounds", [("float", 2), ("double", 3), ("float", 0)])
def test_compress(spark, kind, rounds):
    r = np.random.default_rng(8)
    x = r.normal(size=(90, 12)).astype(np.float32) / 10
    rows = [(i, [float(v) for v in vec], int(i % 3) if i % 4 else None) for i, vec in enumerate(x)]
    rows += [(100 + i, v, 0) for i, v in enumerate(BAD)] + [(110, [], 0), (111, [1.0] * 8, 1), (112, [1.0] * 7, 1), (None, rows[2][1], None), (3, rows[4][1], 2), (3, rows[4][1], 2), (-5, rows[9][1], 9), (113, [0.0] * 12, 1)]
    df = spark.createDataFrame([(*v, 7) for v in rows], f"vec_id long, embedding array<{kind}>, label int, code int").repartition(4)
    coded, books = codebooks.compress(df, 4, 10, rounds)
    want, own = brute_codes(rows, 4, 10, rounds)
    got = codebooks.label_errors(coded).select("vec_id", "code", "error", "label_error").collect()
    assert sorted(map(tuple, got), key=repr) == want
    assert books.tolist() == own and codebooks.digest(books) == hashlib.sha256(",".join(str(c) for b in own for e in b for c in e).encode()).hexdigest()
    few, small = codebooks.compress(df.where("vec_id in (1, 2)"), 4, 10, rounds)
    assert sorted(x.error for x in few.collect()) == [0, 0] and small.shape == (4, 2, 3)
    none, empty = codebooks.compress(df.where("vec_id > 1000"), 4, 10, rounds)
    assert codebooks.label_errors(none).count() == 0 and empty.size == 0
