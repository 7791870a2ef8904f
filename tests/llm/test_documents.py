"""Operators on documents against brute-force versions on small, awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dirlake.llm import decontamination, jaccard, langid, lines, lm, packing, substrings, token_files, tokens
from dirlake.llm.components import components
from dirlake.llm.storage import shared_dir

TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string"


def words(x, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (x or "").translate(TABLE))


def corpus(seed=1, n=60):
    """Random words, near and exact copies, nulls, empty, white, short and long texts, repeated rows and ids."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(300)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two three four"), (5, "One two\nthree  four"), (6, "É " * 40), (7, " ".join(vocabulary * 12))]
    base = [[r.choice(vocabulary) for _ in range(r.randint(30, 120))] for _ in range(8)]
    for i in range(10, 10 + n):
        own = list(r.choice(base)) if r.random() < 0.7 else [r.choice(vocabulary) for _ in range(r.randint(1, 90))]
        for _ in range(r.choice([0, 0, 1, 1, 2, 6])):
            own[r.randrange(len(own))] = r.choice(vocabulary)
        rows.append((i, r.choice([" ", " ", "\n"]).join(own)))
    return [*rows, rows[20], (rows[21][0], rows[22][1])]


def roots(pairs, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(330)] + [(i, i + 1) for i in range(500, 540)] + [(600, j) for j in range(601, 660)] + [(700, 700)]
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == roots(edges, {x for e in edges for x in e})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], DOCS + ", node string, n int").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_documents(df).collect())
    sets = []
    for _, x in rows:
        w = words(x)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = roots(links, range(len(rows)))
    least = collections.defaultdict(lambda: math.inf)
    for i, (doc_id, _) in enumerate(rows):
        least[root[i]] = min(least[root[i]], doc_id)
    assert got == sorted((rows[i][0], len(sets[i]), least[root[i]]) for i in range(len(rows)))
    assert len(links) > 20


def test_jaccard_templates(spark):
    """Documents that share a long template but aren't similar: no pair of groups is made; similar ones among them link."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    template = [word() for _ in range(170)]
    rows = []
    for i in range(300):
        own = [word() for _ in range(30)]
        rows += [(4 * i, " ".join(template + own)), (4 * i + 1, " ".join(template + own + [word()]))] if i % 3 == 0 else [(4 * i, " ".join(template + own))]
    made = []
    pairs = jaccard.group_pairs

    def counted(entries, percent):
        made.append((entries.count(), pairs(entries, percent).count()))
        return pairs(entries, percent)

    jaccard.group_pairs = counted
    try:
        got = {x.doc_id: x.component_id for x in jaccard.similar_documents(spark.createDataFrame(rows, DOCS)).collect()}
    finally:
        jaccard.group_pairs = pairs
    assert got == {i: i - i % 4 for i, _ in rows}
    assert made[0][1] <= made[0][0]


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_group_pairs(spark, percent):
    r = random.Random(percent)
    rows = [(r.randrange(6), g, n, r.randrange(n), r.randrange(3), 2) for g, n in ((g, r.randint(1, 60)) for g in range(200))]
    got = jaccard.group_pairs(spark.createDataFrame(rows, "key long, grp long, n long, place long, low long, high long"), percent).collect()
    ok = lambda a, b: a[0] == b[0] and min(a[2] - a[3], b[2] - b[3]) * (100 + percent) >= percent * (a[2] + b[2]) and not a[4] == b[4] == 2
    assert sorted(tuple(sorted(x)) for x in got) == sorted((a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and ok(a, b))


def test_sets_are_dealt_whole(monkeypatch):
    """Whatever is dealt at once, each row has the same hashes, at its own place."""
    rows = corpus(3, n=200)
    table = pa.table({"doc_id": [i for i, _ in rows], "text": pa.array([x for _, x in rows], pa.string())})
    found = {}
    for dealt in (1, 2000, 1 << 20):
        monkeypatch.setattr(jaccard, "DEALT", dealt)
        groups = list(jaccard.dealt_sets(table.to_batches(max_chunksize=7), "text", 5))
        found[dealt] = [(ids[k], h[d == k].tolist()) for ids, h, d in groups for k in range(len(ids))]
        assert (len(groups) > 1) == (dealt < 1 << 20)
        assert all((np.diff(d) >= 0).all() for _, _, d in groups)
    assert [i for i, _ in found[1]] == [i for i, _ in rows]
    assert found[1] == found[2000] == found[1 << 20]


def test_jaccard_no_rows_and_null_ids(spark):
    assert jaccard.similar_documents(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (None, "x y"), (None, "x y")]
    got = jaccard.similar_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == [(4, 4), (None, 4), (None, None), (None, None)]


def brute_spans(rows, length, first):
    seen = collections.defaultdict(list)
    raw = [(x or "").encode() for _, x in rows]
    for i, b in enumerate(raw):
        for at in range(len(b) - length + 1):
            seen[b[at : at + length]].append((rows[i][0], i, at))
    gone = [bytearray(len(b)) for b in raw]
    for places in seen.values():
        for _, i, at in sorted(places)[1:] if first else places if len(places) > 1 else []:
            gone[i][at : at + length] = b"\1" * length
    return sorted((rows[i][0], len(b), sum(gone[i]), len(re.findall(b"\1+", bytes(gone[i]))), bytes(x for x, g in zip(b, gone[i], strict=True) if not g)) for i, b in enumerate(raw))


@pytest.mark.parametrize(("first", "length", "gram"), [(False, 20, 5), (True, 20, 5), (False, 60, 13)])
def test_substrings(spark, first, length, gram):
    r = random.Random(length)
    rows = [(i, "".join(r.choice("ab") for _ in range(r.randint(0, 90)))) for i in range(40)]
    rows += [(50 + i, rows[i][1][5:60] + "-" + rows[i + 1][1]) for i in range(20)] + [(90, "a" * 300), (91, None), (92, ""), (93, "é" * 40)]
    df = spark.createDataFrame([(*x, 1) for x in rows], DOCS + ", key int")
    got = substrings.remove_repeats(df, length=length, gram=gram, keep_first=first).collect()
    assert sorted((x.doc_id, x.n_bytes, sum(b - a for a, b in x.removed), len(x.removed), bytes(x.kept)) for x in got) == brute_spans(rows, length, first)


@pytest.mark.parametrize(("first", "hot"), [(False, 4096), (True, 4096), (False, 3), (True, 3)])
def test_substrings_of_full_length(spark, first, hot):
    """Passages of 300 to 1,500 bytes in many surroundings, at the length that op2_suffix_dedup takes."""
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdefghij kl\né") for _ in range(n))
    passages = [text(n) for n in (300, 396, 400, 404, 470, 900, 1500)]
    rows = [(i, text(r.randint(0, 500)).join(r.choice(passages)[r.choice([0, 0, 7]) :] for _ in range(r.randint(0, 3)))) for i in range(60)]
    rows = [(i, text(r.randint(0, 300)) + x + text(r.randint(0, 300))) for i, x in rows] + [(70, "ab" * 500), (71, "ab" * 480 + "c"), (None, passages[5])]
    if first:
        rows = rows[:-1]  # brute_spans orders ids that are not null
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = substrings.remove_repeats(df, keep_first=first, hot=hot).collect()
    key = lambda x: (x[0] is None, x[0] or 0)
    got = sorted(((x.doc_id, x.n_bytes, sum(b - a for a, b in x.removed), len(x.removed), bytes(x.kept)) for x in got), key=key)
    want = brute_spans([(i, x) for i, (_, x) in enumerate(rows)], 400, first)
    assert [x[1:] for x in got] == [x[1:] for x in want]
    assert sum(x[3] > 0 for x in got) > 20


def test_longest_factors():
    r = random.Random(2)
    for length in (3, 8, 20, 45):
        data = np.array([r.choice(b"ab") for _ in range(200)], np.uint8)
        starts = np.array(sorted(r.sample(range(200 - length + 1), 100)))
        order, levels = substrings.suffix_order(data, starts, length)
        raw = data.tobytes()
        assert order.tolist() == sorted(starts.tolist(), key=lambda i: (raw[i : i + length], i))
        match = lambda i, j: next((n for n in range(length) if raw[i + n] != raw[j + n]), length)  # noqa: B023, E731
        for previous in (True, False):
            got = substrings.longest_factors(data, order, levels, length, previous)
            assert got.tolist() == [max((match(i, j) for j in order if (j < i if previous else j > i)), default=0) for i in order]


def test_substrings_equal_rows_keep_first(spark):
    rows = [(1, "x" * 10 + "abcdefghij" * 3)] * 2 + [(2, "y" * 10 + "abcdefghij" * 3)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, DOCS), length=30, gram=8).collect()
    assert sorted((x.doc_id, bytes(x.kept)) for x in got) == [(1, rows[0][1].encode())] * 2 + [(2, b"y" * 10)]


def test_substrings_repeated_rows(spark):
    rows = [(1, "x" * 10 + "abcdefghij" * 3)] * 2 + [(None, None)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, DOCS), length=30, gram=8, keep_first=False).collect()
    assert sorted((x.n_bytes, len(x.kept)) for x in got) == [(0, 0), (40, 0), (40, 0)]
    assert substrings.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination(spark, block_bytes):
    rows = corpus(3)
    alnum = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    items = [(1, "  ".join(words(rows[30][1], alnum)[:14])), (2, " ".join(words(rows[31][1], alnum)[5:12])), (3, "One, two!"), (4, None), (5, "..."), (6, "É"), (1, "one"), (None, "four")]
    windows = collections.defaultdict(set)
    for item, x in items:
        w = words(x, alnum)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[i : i + size])] |= {str(item)} - {"None"}
    want = []
    for doc_id, x in rows:
        w, hit, found = words(x, alnum), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if (own := tuple(w[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[own]
        want.append((doc_id, len(w), len(hit), sorted(found)))
    df = spark.createDataFrame([(*x, 1) for x in rows], DOCS + ", passages int")
    out, name = decontamination.find_passages(df, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    assert name == "passages_" and out.columns == ["doc_id", "text", "passages", "passages_"]
    got = [(r.doc_id, r[name].n_words, sum(r[name].spans[1::2]) - sum(r[name].spans[::2]), r[name]["items"]) for r in out.collect()]
    assert sorted(got) == sorted(want)


def test_windows_that_collide(monkeypatch):
    """Windows of one hash are told by their words; those of equal words are one."""
    r = np.random.default_rng(1)
    words_of = r.integers(0, 3, 300).astype(np.uint64)
    begin = np.arange(0, 290)
    want = collections.defaultdict(list)
    for i in begin.tolist():
        want[words_of[i : i + 5].tobytes()].append(i)
    for shingles in (decontamination.T.shingles, lambda hashes, size: np.zeros(len(hashes) - size + 1, np.uint64)):
        monkeypatch.setattr(decontamination.T, "shingles", shingles)
        index, inverse = decontamination.distinct_windows(words_of, begin, 5)
        assert len(index) == len(want) and all(len(set(inverse[x].tolist())) == 1 for x in want.values())


def test_repeated_items(spark):
    """A passage of very many items, and items that are copies."""
    text = " ".join(f"w{i}" for i in range(14))
    items = [(i, text) for i in range(300)] + [(300 + i, f"own{i} " + text) for i in range(40)] + [(7, text), (None, text)]
    docs = [(1, "x " + text + " y"), (2, " ".join(text.split()[:9])), (3, "own3 " + text)]
    out, name = decontamination.find_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: r[name] for r in out.collect()}
    assert got[1].spans == [1, 15] and got[2].spans == [] and got[3].spans == [0, 15]
    assert got[1]["items"] == sorted(str(i) for i in range(340)) == got[3]["items"]


def test_decontamination_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    out, name = decontamination.find_passages(spark.createDataFrame([(1, "a")], DOCS), none)
    assert out.first()[name].n_words == 1 and out.first()[name].spans == []
    assert decontamination.find_passages(spark.createDataFrame([], DOCS), none)[0].count() == 0


ODD = ["<|endoftext|> a", "x<|EndOfText|>y", "Σίσυφος ΣΑΣ", "İstanbul", "é É", "'S it's we'LL don't!!'s..'re", "a\tb c\x1cd", "中文 ١٢", "²³ ÷×", "", "  ", "_a_b__9a'd", "\x85x\x00y\x7f", "a" * 3000 + " '" * 100]


def test_encoder():
    coder = tokens.WordEncoder(tokens.default_path())
    r = random.Random(2)
    texts = ODD + ["".join(r.choice("aAbB'!.,<|>stréÉßÿ×9² \n\tΣ中́") for _ in range(r.randint(0, 40))) for _ in range(3000)] + [None]
    want = [np.array(e.ids, "<u4").tobytes() for e in coder.tokenizer.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert coder.encode(pa.array(texts)) == want
    assert coder.encode(pa.array(texts[5:9])) == want[5:9] and coder.encode(pa.array([], pa.string())) == []


def test_codes():
    r = np.random.default_rng(1)
    for ids in (np.array([0, 255, 256, 65535, 65536, 2**32 - 1]), r.integers(0, 60000, 5000), np.array([], np.int64), np.array([7])):
        levels, goes_on, ranks = token_files.to_codes(ids)
        assert (token_files.from_codes(levels, goes_on) == ids).all()
        assert [token_files.token_at(levels, goes_on, ranks, i) for i in range(len(ids))] == ids.tolist()


def encoded(rows, end):
    t = tokens.word_encoder(tokens.default_path()).tokenizer
    return [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4").tobytes()) for i, x in rows]


def test_token_files(spark):
    rows = corpus(5) + list(enumerate(ODD, 100))
    path = shared_dir(spark, "t")
    token_files.write_tokens(spark.createDataFrame([(*x, 1) for x in rows], DOCS + ", part int").repartition(5), path, tokens.default_path())
    got = [(r.doc_id, r.start, bytes(r.ids)) for r in token_files.read_tokens(spark, path).collect()]
    want, at = [], 0
    for i, ids in encoded(sorted(rows, key=lambda x: (x[0], x[1] is not None, (x[1] or "").encode())), 1):
        want.append((i, at, ids))
        at += len(ids) // 4
    assert sorted(got) == sorted(want)
    flat = np.concatenate([np.frombuffer(x, "<u4") for _, _, x in want])
    for i in (0, 1, len(flat) // 2, len(flat) - 1):
        assert token_files.read_token(spark, path, i) == flat[i]
    with pytest.raises(IndexError):
        token_files.read_token(spark, path, len(flat))
    path = shared_dir(spark, "t")
    token_files.write_tokens(spark.createDataFrame([], DOCS), path, tokens.default_path())
    assert token_files.read_tokens(spark, path).count() == 0


@pytest.mark.parametrize(("size", "max_open"), [(64, 1000), (64, 3), (4096, 1000)])
def test_packing(spark, size, max_open):
    rows = [(i, x) for i, (_, x) in enumerate(corpus(6))]
    got = packing.pack(spark.createDataFrame([(*x, 1) for x in rows], DOCS + ", ids int").repartition(3), tokens.default_path(), size=size, max_open=max_open).collect()
    documents, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        documents[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length > 0
    for i, ids in encoded(rows, 2):
        own = sorted(documents[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == ids and all(r.doc_tokens == len(ids) // 4 for r in own)
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist()
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist()
        total = sum(r.length for r in own)
        assert total == size or total < size and total & (total - 1) == 0
    assert packing.pack(spark.createDataFrame([], DOCS), tokens.default_path()).count() == 0


def test_sum_of_squares():
    packer = packing.Packer(10, 100)
    for i, n in enumerate([6, 3, 3, 4]):
        list(packer.add(i, b"\0" * 4 * n))
    assert packer.count[[6, 3, 9, 7]].tolist() == [0, 0, 1, 1]


def brute_lines(rows):
    places = collections.defaultdict(list)
    for i, x in rows:
        for at, line in enumerate((x or "").split("\n")):
            if line := line.strip(" \t\r").lower():
                places[line].append((i, at))
    ids = list(places)
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in ids]
    root = roots([(i, j) for i in range(len(ids)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])], range(len(ids)))
    first = {}
    for k, x in enumerate(ids):
        first[root[k]] = min([*places[x], first.get(root[k], (math.inf, 0))])
    return {p for k, x in enumerate(ids) for p in places[x]} - set(first.values())


def test_lines(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(16, 40))] for _ in range(30)]
    rows = [(0, None), (1, ""), (2, "short\nshort\n\n"), (3, "\n" * 50)]
    for i in range(4, 70):
        own = []
        for _ in range(r.randint(1, 6)):
            line = list(r.choice(base))
            if r.random() < 0.4:
                line[r.randrange(len(line))] = r.choice(vocabulary)
            own.append(" ".join(line) + r.choice(["", "\r", " "]))
        rows.append((i, "\n".join(own)))
    df = spark.createDataFrame([(*x, 1, 2) for x in [*rows, rows[9]]], DOCS + ", key int, removed int")
    out, name = lines.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "key", "removed", "removed_"]
    got = out.collect()
    assert len(got) == len(rows) + 1
    gone, want = {(x.doc_id, i) for x in got for i in x[name]}, brute_lines(rows)
    assert not gone - want and len(gone) >= 0.98 * len(want) and len(want) > 100
    text = dict(rows)
    for x in got:
        kept = None if text[x.doc_id] is None else "\n".join(y for i, y in enumerate(text[x.doc_id].split("\n")) if i not in x[name])
        assert x.text == kept
    assert lines.dedup_lines(spark.createDataFrame([], DOCS))[0].count() == 0


def gone_lines(spark, rows, **settings):
    out, name = lines.dedup_lines(spark.createDataFrame(rows, DOCS), **settings)
    return {(x.doc_id, i) for x in out.collect() for i in x[name]}


def test_lines_of_equal_shingles(spark):
    """Lengths say nothing where the shingles are the same."""
    rows = [(1, "ha " * 10 + "\n" + "=" * 24), (2, "ha " * 20), (3, "=" * 60)]
    assert gone_lines(spark, rows) == {(2, 0), (3, 0)}


def test_lines_scattered_edits(spark):
    """Recall of pairs just above the threshold."""
    r = random.Random(11)
    rows = []
    while len(rows) < 1600:
        x = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(r.randint(12, 60)))
        y = list(x)
        for _ in range(max(1, round(len(x) / 46))):
            y[r.randrange(len(y))] = r.choice("abcdefghijklmnopqrstuvwxyz")
        y = "".join(y)
        a, b = ({z[i : i + 5] for i in range(len(z) - 4)} for z in (x, y))
        if x != y and 80 <= 100 * len(a & b) / len(a | b) < 83:
            rows += [(len(rows), x), (len(rows) + 1, y)]
    gone = gone_lines(spark, rows)
    assert all(i % 2 and at == 0 for i, at in gone) and len(gone) >= 0.99 * 800


def scattered(r, letters, lengths):
    """A line without spaces, and the line with an edit in some 46 letters."""
    x = [r.choice(letters) for _ in range(r.randint(*lengths))]
    y = list(x)
    for _ in range(max(1, round(len(x) / 46))):
        y[r.randrange(len(y))] = r.choice(letters)
    return "".join(x), "".join(y)


def alike(x, y):
    a, b = ({z[i : i + 5] for i in range(len(z) - 4)} for z in (x, y))
    return len(a & b) / max(1, len(a | b))


def test_lines_without_spaces(spark):
    r = random.Random(12)
    han, rows = [chr(0x4E00 + i) for i in range(2000)], []
    while len(rows) < 1200:
        x, y = scattered(r, r.choice([han, "0123456789abcdef"]), (60, 300))
        if x != y and alike(x, y) >= 0.8:
            rows += [(len(rows), x), (len(rows) + 1, y)]
    rest = "".join(r.choice(han) for _ in range(60))
    gone = gone_lines(spark, rows)
    assert all(i % 2 and at == 0 for i, at in gone) and len(gone) >= 0.99 * 600
    front = [(1, "1" + rest), (2, "2" + rest)]
    assert alike(front[0][1], front[1][1]) >= 0.8 and gone_lines(spark, front) == {(2, 0)}


def brute_all_lines(rows):
    """Line numbers that go if every non-blank line counts."""
    places = collections.defaultdict(list)
    for i, x in rows:
        for at, line in enumerate((x or "").split("\n")):
            if line := line.strip(" \t\r").lower():
                places[line].append((i, at))
    ids = list(places)
    root = roots([(i, j) for i in range(len(ids)) for j in range(i) if alike(ids[i], ids[j]) >= 0.8], range(len(ids)))
    first = {}
    for k, x in enumerate(ids):
        first[root[k]] = min([*places[x], first.get(root[k], (math.inf, 0))])
    return {p for k, x in enumerate(ids) for p in places[x]} - set(first.values())


def test_short_lines(spark, tmp_path):
    r = random.Random(13)
    rows = [(0, "}\n\n \n}"), (1, "abcde\nabcdé\n=====\n======"), (2, "今日は天気がとても良いので散歩に行く。"), (3, "今日は天気がとても良いので散歩に行く。"), (4, "01" * 40), (5, "10" * 80)]
    for i in range(10, 260):
        letters = r.choice(["abcdefgh ", [chr(0x4E00 + k) for k in range(500)]])
        x = "".join(r.choice(letters) for _ in range(r.randint(3, 48)))
        rows += [(2 * i, x), (2 * i + 1, r.choice([x, r.choice(letters) + x[1:], x + r.choice(letters), x[:-1] + r.choice(letters)]))]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    gone = {(x.doc_id, i) for x in lines.op7_line_dedup(spark, str(tmp_path)).collect() for i in x.removed}
    want = brute_all_lines(rows)
    assert not gone - want and len(gone) >= 0.98 * len(want) and len(want) > 150
    assert {(0, 3), (1, 3), (3, 0), (5, 0)} <= gone


def test_lines_of_families(spark):
    """Variants of lines that aren't there themselves, and short lines with a character more."""
    r = random.Random(15)
    letters, rows = "abcdefghijklmnopqrstuvwxyz     ", []
    for _ in range(12):
        base = [r.choice(letters) for _ in range(r.randint(150, 300))]
        for _ in range(20):
            x = list(base)
            for _ in range(r.randint(1, len(x) // 50)):
                x[r.randrange(len(x))] = r.choice(letters)
            rows.append((len(rows), "".join(x).strip()))
    for _ in range(150):
        x = "".join(r.choice(letters) for _ in range(r.randint(8, 60)))
        rows += [(len(rows), x), (len(rows) + 1, r.choice([x + "x", "y" + x, x + "xy"]))]
    gone, want = gone_lines(spark, rows, min_chars=1), brute_all_lines(rows)
    assert not gone - want and len(gone) >= 0.98 * len(want) and len(want) > 300


@pytest.mark.parametrize("letters", ["01", "acgt", "0123456789"])
def test_lines_of_few_letters(spark, letters):
    """Recall where few shingles of five characters are there: pairs at 0.8 or more, against all pairs."""
    r = random.Random(len(letters))
    rows, n = [], 0
    for length in (100, 200, 300, 1200) if letters != "01" else (40, 48):
        for k in range(30):
            head = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(12)) if k % 2 else ""
            x = [r.choice(letters) for _ in range(length)]
            y = list(x)
            for _ in range(max(1, length // 60)):
                y[r.randrange(length)] = r.choice(letters)
            rows += [(n, head + "".join(x)), (n + 1, head + "".join(y))]
            n += 2
    if letters == "01":
        for length in (200, 300):  # as lines of two letters have all shingles, each group is one component
            rows += [(n + k, f"{chr(97 + k % 26) * 3}{'xyz'[k % 3]}" * 8 + "".join(r.choice(letters) for _ in range(length))) for k in range(60)]
            n += 60
    gone, want = gone_lines(spark, rows), brute_all_lines(rows)
    assert not gone - want and len(gone) >= 0.9 * len(want) and len(want) >= 50


def test_lines_are_compared_once(spark, monkeypatch):
    """No pair of lines is compared in both directions, or again in the second round."""
    pairs, keep = [], lines.written

    def kept(df, name, *rest):
        out = keep(df, name, *rest)
        if name == "line-pairs":
            pairs.extend(tuple(sorted(r)) for r in out.collect())
        return out

    monkeypatch.setattr(lines, "written", kept)
    r, rows = random.Random(5), []
    for _ in range(6):
        words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(30)]
        for _ in range(16):  # a family of lines that share some parts, most of them too few
            own = [w if r.random() < 0.85 else "".join(r.choice("klmnop") for _ in range(6)) for w in words]
            rows.append((len(rows), " ".join(own)))
    gone, want = gone_lines(spark, rows), brute_all_lines(rows)
    assert gone <= want and pairs and len(pairs) == len(set(pairs))


def test_lines_that_collide(spark, monkeypatch):
    """Different lines of one number: none goes for another's sake."""
    monkeypatch.setattr(lines, "line_id", lambda line: F.pmod(F.xxhash64(line), F.lit(16)))
    r = random.Random(21)
    rows = [(i, "\n".join("".join(r.choice("abcdefgh ") for _ in range(30)) for _ in range(4))) for i in range(60)] + [(99, "one line"), (100, "one line")]
    gone, want = gone_lines(spark, rows), brute_all_lines(rows)
    assert gone <= want


def brute_phrases(sample, text):
    """Greedy longest matches within lanes of symbols."""
    n = 0
    for at in range(0, len(text), langid.LANE):
        lane, i = text[at : at + langid.LANE], 0
        while i < len(lane):
            j = i + 1
            while j < len(lane) and lane[i : j + 1] in sample:
                j += 1
            n, i = n + 1, j
    return n


def test_phrases():
    r = random.Random(3)
    samples = {k: "".join(r.choice(a) for _ in range(400)) for k, a in (("a", "abc "), ("b", "bcd "))}
    model = langid.fit(samples)
    texts = ["".join(r.choice("abcdx ") for _ in range(n)) for n in (0, 1, 5, 256, 257, 900)]
    symbols, sizes = langid.folded(model.fold, texts)
    as_text = lambda s: "".join(map(chr, s.tolist()))
    inside = [as_text(langid.folded(model.fold, [x])[0]) for x in samples.values()]
    ends = np.cumsum(sizes)
    want = [[brute_phrases(s, as_text(symbols[e - n : e])) for s in inside] for n, e in zip(sizes, ends, strict=True)]
    assert langid.phrases(model, symbols, sizes).tolist() == want


def test_language(spark):
    model = langid.fit({"en": "the cat and the dog went to the house of the man " * 20, "de": "der hund und die katze gingen in das haus des mannes " * 20})
    rows = [(1, "The dog went and the cat"), (2, "Die Katze und der Hund"), (3, None), (4, ""), (5, "123 !!"), (6, "кот"), (6, "кот"), (7, "the house " * 30000)]
    out, name = langid.identify(spark.createDataFrame([(*x, 1) for x in rows], DOCS + ", language int"), model)
    got = [(r.doc_id, r[name].lang_pred, r[name].score) for r in out.collect()]
    assert {(i, p) for i, p, _ in got if i != 6} == {(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (7, "en")}
    assert len(got) == 8 and all(0 <= s <= 1 for _, _, s in got)
    nothing, name = langid.identify(spark.createDataFrame(rows, DOCS), langid.fit(langid.sample(spark.createDataFrame([], "text string, lang string, key long"))))
    assert {r[name].lang_pred for r in nothing.collect()} == {"und"}
    labelled = spark.createDataFrame([("a b", None, 1), (None, "en", 2), ("c", "en", 3), ("d", "de", 4)], "text string, lang string, key long")
    assert langid.sample(labelled) == {"de": " d", "en": " c"}


@pytest.mark.parametrize("dense", [langid.DENSE, 0])
def test_language_large_alphabets(monkeypatch, dense):
    """Two languages of one large alphabet and the same spacing, beside one of a small alphabet."""
    monkeypatch.setattr(langid, "DENSE", dense)
    r = random.Random(5)
    han, small = [chr(0x4E00 + i) for i in range(600)], [chr(0x430 + i) for i in range(32)] + [chr(0x61 + i) for i in range(26)] + ["ä", "ö", "ü", "é"]
    vocabulary = {"a": ["".join(r.sample(han, 3)) for _ in range(150)], "b": ["".join(r.sample(han, 3)) for _ in range(150)], "en": ["".join(r.choice(small) for _ in range(5)) for _ in range(150)]}
    say = lambda k, n: " ".join(r.choice(vocabulary[k]) for _ in range(n))
    model = langid.fit({k: say(k, 4000 if k == "en" else 700) for k in vocabulary})
    texts = [(k, say(k, 30)) for k in vocabulary for _ in range(20)]
    symbols, sizes = langid.folded(model.fold, [x for _, x in texts])
    found = langid.phrases(model, symbols, sizes) * np.array(model.bits)
    assert [model.languages[k] for k in found.argmin(axis=1)] == [k for k, _ in texts]
    assert [x.keys is None for x in model.tables] == [dense > 0] * 3


def test_language_held_out(spark):
    """Accuracy on documents that weren't learnt from."""
    folder = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in langid.op8_language_id(spark, folder).collect() if r.held_out]
    assert {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_lm(spark):
    rows = corpus(7)
    docs = [[*words(x), "</s>"] for _, x in rows]
    unigrams, pairs = collections.Counter(), collections.Counter()
    for w in docs[:50]:
        unigrams.update(w)
        pairs.update(zip(["<s>", *w], w, strict=False))
    total, vocabulary = sum(unigrams.values()), len(unigrams)
    followed, contexts = collections.Counter(v for _, v in pairs), collections.defaultdict(lambda: [0, 0, 0, 0])
    for (u, _), c in pairs.items():
        contexts[u][0] += c
        contexts[u][min(c, 3)] += 1
    d = lm.discounts([sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)])
    e = lm.discounts([sum(c == k for c in followed.values()) for k in (1, 2, 3, 4)])
    grade = lambda c, x: x[min(c, 3) - 1] if c else 0
    left = sum(grade(c, e) for c in followed.values()) / len(pairs)

    def probability(u, v):
        lower = (followed[v] - grade(followed[v], e)) / len(pairs) + left / (vocabulary + 1)
        if u not in contexts:
            return lower
        n, *kinds = contexts[u]
        return (pairs[u, v] - grade(pairs[u, v], d)) / n + sum(a * b for a, b in zip(d, kinds, strict=True)) / n * lower

    for u in ("<s>", "one", "never seen"):
        assert abs(sum(probability(u, v) for v in unigrams) + probability(u, "unknown") - 1) < 1e-9
    model = lm.train(spark.createDataFrame([(x, 1) for _, x in rows[:50]], "text string, a int").repartition(3))
    got = lm.score(spark.createDataFrame([(*x, 1) for x in rows], DOCS + ", part int"), model).collect()
    want = [(i, len(w), sum(unigrams[x] > 0 for x in w), total, sum(math.log10((unigrams[x] + 1) / (total + vocabulary + 1)) for x in w), sum(math.log10(probability(u, v)) for u, v in zip(["<s>", *w], w, strict=False))) for (i, _), w in zip(rows, docs, strict=True)]
    for a, b in zip(sorted(map(tuple, got)), sorted(want), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9)


def test_lm_of_many_parts(spark):
    """The number of parts changes no score."""
    df = spark.createDataFrame(corpus(8), DOCS)
    few, many = (sorted(map(tuple, lm.score(df, lm.train(df.select("text"), part_bytes=n)).collect())) for n in (1 << 20, 500))
    for a, b in zip(few, many, strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-12)


def test_lm_without_training(spark):
    none = lm.train(spark.createDataFrame([], "text string"))
    got = lm.score(spark.createDataFrame([(1, "a b"), (2, None)], DOCS), none).collect()
    assert [(r.n_tokens, r.n_known, r.base_score, r.score) for r in got] == [(3, 0, 0, 0), (1, 0, 0, 0)]
    with pytest.raises(ValueError, match="no mounted path"):
        lm.train(spark.createDataFrame([], "text string"), folder="hdfs://x/y")


def thue_morse(n=1024):
    x = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_strings_that_collide_modulo_powers_of_two(spark):
    from dirlake.llm import text as T

    x, y = thue_morse()
    hashes, _, _ = T.words(*T.text_bytes(pa.array([x, y, x])), T.SPACED)
    assert hashes[0] != hashes[1] and hashes[0] == hashes[2]
    df = spark.createDataFrame([(1, x), (2, y)], DOCS)
    assert {r.component_id for r in jaccard.similar_documents(df).collect()} == {1, 2}
    coder = tokens.WordEncoder(tokens.default_path())
    assert coder.encode(pa.array([x, y])) == [i for _, i in ((0, np.array(coder.tokenizer.encode(z, add_special_tokens=False).ids, "<u4").tobytes()) for z in (x, y))]
    out, name = decontamination.find_passages(df, spark.createDataFrame([(7, x)], "item_id long, text string"))
    assert {r.doc_id: r[name]["items"] for r in out.collect()} == {1: ["7"], 2: []}
    got = lm.score(df, lm.train(df.where("doc_id = 1").select("text"))).collect()
    assert {r.doc_id: r.n_known for r in got} == {1: 2, 2: 1}


def test_sums_of_long_texts(monkeypatch):
    """Sums carried on from one exact stretch to the next."""
    from dirlake.llm import text as T

    data = np.frombuffer(b"abcab\xff\x00abcab", np.uint8)
    whole = T.prefix_sums(data)
    monkeypatch.setattr(T, "EXACT", 3)
    assert (T.prefix_sums(data) == whole).all()
    p, want = int(T.PRIME), 0
    for i, c in enumerate(data.tolist()):
        want = (want + (c + 1) * pow(T.BASE, i, p)) % p
    assert int(whole[-1]) == want


def test_hashes_of_words():
    from dirlake.llm import text as T

    texts = ["Ab cd", None, "", "ab\ncd", "xab"]
    hashes, starts, ends = T.words(*T.text_bytes(pa.array(texts)), T.SPACED)
    assert (hashes[0], hashes[1]) == (hashes[2], hashes[3]) and len(set(hashes.tolist())) == 3
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0" and (ends > starts).all()


def test_words_by_pieces(monkeypatch):
    """Words, runs and token ids are the same however small the pieces of a text."""
    from dirlake.llm import text as T

    r = random.Random(31)
    texts = [None, "", "x" * 50, *("".join(r.choice("abÉ \n,9") for _ in range(n)) for n in (1, 7, 40, 300)), "ab " * 30, "", "end"]
    block = T.text_bytes(pa.array(texts))
    whole = [[x.tolist() for x in T.words(*block, table)] for table in (T.SPACED, T.ALNUM)]
    runs = [x.tolist() for x in substrings.anchored_runs(*block, 12, 4)]
    coder = tokens.WordEncoder(tokens.default_path())
    ids = coder.encode(pa.array(texts + ODD))
    for piece in (1, 2, 3, 7, 16, 64):
        monkeypatch.setattr(T, "PIECE_BYTES", piece)
        assert [[x.tolist() for x in T.words(*block, table)] for table in (T.SPACED, T.ALNUM)] == whole
        assert [x.tolist() for x in substrings.anchored_runs(*block, 12, 4)] == runs
        assert coder.encode(pa.array(texts + ODD)) == ids
        assert all(b"".join(x.tobytes() for x in T.cut_at_spaces(np.frombuffer((t or "").encode(), np.uint8), piece)) == (t or "").encode() for t in texts)


def test_lm_of_long_texts(spark, monkeypatch):
    rows = corpus(12)
    df = spark.createDataFrame(rows, DOCS)

    def scores():
        return sorted((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in lm.score(df, lm.train(df.select("text"))).collect())

    whole = scores()
    monkeypatch.setattr(lm, "TOKENS_AT_ONCE", 37)
    u, v, _ = lm.token_block(pa.array([x for _, x in rows]))
    parts = list(lm.counted_blocks(iter([pa.record_batch([pa.array([x for _, x in rows])], names=["text"])]), "text"))
    assert max(len(x) for x, _ in parts) <= 74 and (np.concatenate([x for x, _ in parts]) == u).all() and (np.concatenate([x for _, x in parts]) == v).all()
    assert scores() == whole


def test_letters_of_other_scripts():
    hindi, turkish = "हिन्दी में किताब और पानी " * 20, "İstanbul'da ılık IRMAK İyi " * 20
    model = langid.fit({"hi": hindi, "tr": turkish})
    gaps = lambda x: int((langid.folded(model.fold, [x])[0] == 0).sum())
    assert gaps("हिन्दी में") == 1 and gaps("İstanbul") == 0
    assert (model.fold[ord("İ")] == model.fold[ord("i")]) and model.fold[ord("ﬁ")] == model.fold[ord("f")]
    same = [langid.folded(model.fold, [x])[0].tolist() for x in ("é", "é")]
    assert same[0] == same[1]
    assert not model.letters[langid.folded(model.fold, ["́ ि"])[0]].any()
