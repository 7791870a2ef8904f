"""Chats, embeddings and the pipeline on small, awkward rows."""

import collections
import hashlib
import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from dirlake.llm import chat, embeddings


def test_escapes():
    texts = ["<s>", "<\\s>", "[\\\\INST]", "<<s>>", "[/ROLE][END]", "a\\<s>", "[[INST]", "", "\\", "<|endoftext|>", "</s>[INST] ok [/INST]"]
    for x in texts:
        assert chat.unescape(chat.escape(x)) == x and not any(m in chat.escape(x) for m in chat.MARKS)
    assert len({chat.escape(x) for x in texts}) == len(texts)


def test_chats(spark):
    hard = "</s>[INST] ok [/INST]"
    rows = [(1, 2, "assistant", hard), (1, 1, "user", hard), (1, 1, "user", hard), (2, None, None, None), (2, 0, "tool", "é🙂 [\\END]"), (None, 5, "assistant", "x"), (3, 0, "assistant", ""), (3, 1, "assistant", "long " * 30000), (3, 2, "system", "<|endoftext|>"), (3, 3, "assistant", "b")]
    df = spark.createDataFrame([(*x, 0) for x in rows], "conv_id long, turn long, role string, text string, place int")
    path = public_tokenizers.path("byte_bpe_50k.json")
    formatted = chat.format_chats(df, path)
    got = {r.conv_id: r for r in chat.read_chats(formatted, path).collect()}
    conversations = collections.defaultdict(list)
    for c, *x in sorted(rows, key=lambda x: [(v is not None, v) for v in x]):
        conversations[c].append(x)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert set(got) == set(conversations)
    for c, turns in conversations.items():
        loss = "".join(t or "" for _, role, t in turns if role == "assistant")
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(loss), digest(loss))
        assert got[c].turns_sha256 == digest("".join(f"{role or ''}\n{t or ''}\n" for _, role, t in turns))
    own = formatted.where("conv_id = 1").orderBy("place").collect()
    assert "".join(r.formatted for r in own) == "[INST]<\\/s>[\\INST] ok [\\/INST][/INST]" * 2 + "<s><\\/s>[\\INST] ok [\\/INST]</s>"
    assert [r.first_token for r in own] == np.cumsum([0, len(own[0].ids), len(own[1].ids)]).tolist()
    assert chat.read_chats(chat.format_chats(df.limit(0), path), path).count() == 0


def near(r, x, cosine):
    y = r.normal(size=x.shape)
    y -= (x * y).sum(axis=-1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=-1, keepdims=True)
    return cosine * x + math.sqrt(1 - cosine * cosine) * y


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embeddings(spark, kind):
    r = np.random.default_rng(3)
    x = r.normal(size=(120, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = [*x, *near(r, x[:60], 0.94), *near(r, x[:40], 0.92), *near(r, np.repeat(x[100:101], 30, axis=0), 0.99), x[0], x[0] * 3, x[5][:7], x[5][:7]]
    rows = [(i, [float(np.float32(v)) for v in vec], i % 2 if 240 > i >= 120 else 0) for i, vec in enumerate(vectors)]
    n = len(rows)
    odd = [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 24, 0), (n + 3, [float("nan")] * 24, 0), (n + 4, [None] * 24, 0), (n + 5, [float("inf")] * 24, 0), (n + 6, rows[0][1], None), (n + 7, rows[0][1], 1)]
    df = spark.createDataFrame([(*v, 1) for v in rows + odd], f"vec_id long, embedding array<{kind}>, label int, node int")
    got = {v.vec_id: (v.n_links, v.component_id, v.kept) for v in embeddings.similar_vectors(df).collect()}
    links, up = collections.Counter(), {i: i for i in range(n + 8)}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    every = [*rows, (n + 7, rows[0][1], 1)]
    for i, (a, v, la) in enumerate(every):
        for b, w, lb in every[:i]:
            if la == lb and len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                links[a] += 1
                links[b] += 1
                s, t = sorted((find(a), find(b)))
                up[t] = s
    assert got == {i: (links[i], find(i), find(i) == i) for i in range(n + 8)}
    assert embeddings.similar_vectors(df.limit(0)).count() == 0


def test_vectors_that_collide(spark, monkeypatch):
    """Vectors of one 64-bit key are told by the other 64 bits."""
    rows = [(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [1.0, 0.0], 0), (4, [1.0, 0.0], 1), (5, [-1.0, 0.0], 0), (6, None, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    whole = embeddings.vector_key
    monkeypatch.setattr(embeddings, "vector_key", lambda *x: [F.lit(7).cast("long"), whole(*x)[1]])
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.similar_vectors(df).collect()}
    assert got == {1: (1, 1), 2: (0, 2), 3: (1, 1), 4: (0, 4), 5: (0, 5), 6: (0, 6)}


def test_full_filter_is_cut_into_chunks(spark, monkeypatch):
    r = np.random.default_rng(9)
    x = r.normal(size=(1, 16))
    vectors = near(r, np.repeat(x / np.linalg.norm(x), 40, axis=0), 0.999)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(embeddings, "CHUNK", 6)
    assert {tuple(v)[1:3] for v in embeddings.similar_vectors(df).collect()} == {(39, 0)}


@pytest.mark.parametrize("words", [1024, 4096])
def test_recall(words):
    """Of pairs at the threshold, nearly all share a filter."""
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = embeddings.filters(x, words, 48), embeddings.filters(near(r, x, 0.93), words, 48)
    assert np.mean([bool(set(p) & set(q)) for p, q in zip(a.tolist(), b.tolist(), strict=True)]) >= 0.99


def test_many_vectors_of_a_label(spark):
    """Numbers of links of a label with thousands of vectors, against all pairs."""
    r = np.random.default_rng(6)
    x = r.normal(size=(5000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = np.concatenate([x, near(r, x[:1500], 0.95), near(r, x[:500], 0.931), near(r, np.repeat(x[4000:4010], 50, axis=0), 0.98)])
    schema = "vec_id long, embedding array<double>, label int"
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], schema)
    got = {v.vec_id: v.n_links for v in embeddings.similar_vectors(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = [int((unit @ v >= 0.93).sum()) - 1 for v in unit]
    assert sum(got.values()) >= 0.99 * sum(want) and all(got[i] <= n for i, n in enumerate(want))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as pipeline

    r = np.random.default_rng(1)
    texts = ["\n".join(" ".join("".join(r.choice(list("abcdefgh"), 6)) for _ in range(14)) for _ in range(3)) for _ in range(12)]
    rows = [(i, x, "en", "s", len(x)) for i, x in enumerate(texts)]
    rows += [(20, texts[3], None, "s", 1), (21, None, "en", "s", 0), (22, "12 34", "en", None, 5), (23, "x " + texts[5].replace("\n", " "), None, None, None), (24, texts[5].replace("\n", " ") + " x", "en", "s", 5), (25, "secret passage of the benchmark that nobody should ever have seen in training data", "en", "s", 9), (0, texts[0], "en", "s", len(texts[0]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "SECRET passage of the benchmark that nobody should ever have seen")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.dtypes == [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = sorted(r.doc_id for r in docs.collect())
    clean = list(range(12))
    assert kept["language_id"] == sorted([0, *clean, 20, 23, 24, 25])
    assert kept["line_dedup"] == sorted([0, *clean, 23, 25])
    assert kept["near_duplicates"] == [*clean, 25] and kept["decontamination"] == clean
    pieces = pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in pieces.select("doc_id").distinct().collect()) == clean
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert pieces.where(F.octet_length("ids") != 4 * F.col("length")).count() == 0


def test_pipeline_without_labels(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs = spark.createDataFrame([(1, "a b", None), (2, "12 34", None), (3, None, None), (4, "кот", None), (5, None, "en")], "doc_id long, text string, lang string")
    got = pipeline.language_id(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and sorted((r.doc_id, r.lang) for r in got.collect()) == [(1, None), (4, None)]


def test_pipeline_repeated_ids(spark, tmp_path):
    """Texts that aren't linked stay, whatever their doc_id."""
    import corpus_pipeline as pipeline

    rows = [(None, "one text of its own"), (None, "quite another one here"), (1, "a copy of two words more"), (2, "a copy of two words more"), (2, "what no one else has"), (None, "what no one else has"), (3, "same"), (3, "same")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, key int")
    got = pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted({rows[i] for i in (0, 1, 2, 4, 6)}, key=repr)
