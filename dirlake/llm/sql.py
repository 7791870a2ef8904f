"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOW}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS to_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.to_id = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY 1) m USING (doc_id)"""

MARKED = "regexp_replace({}, '([<\\[])(\\\\*(?:s>|/s>|SYS\\]|/SYS\\]|INST\\]|/INST\\]|ROLE\\]|/ROLE\\]|END\\]))', '\\1\\\\\\2', 'g')"
OP3 = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
cast(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS bigint) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
cast(sum(length({MARKED.format('text')}) + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 18 + length({MARKED.format('role')}) END) AS bigint) AS formatted_chars FROM t GROUP BY conv_id"""

OP4 = """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: cast(x AS double)) AS e FROM embeddings
WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id, vec_id AS to_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.to_id = l.a),
m AS (SELECT vec_id, min(to_id) AS component_id FROM r GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1) USING (vec_id)"""

ALNUM = f"regexp_extract_all({LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP5 = f"""WITH w AS (SELECT doc_id, {ALNUM} AS ws FROM documents), b AS (SELECT item_id, {ALNUM} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS win FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS win FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
m AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item FROM m WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, cast(len(ws) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(cast(conv_id AS varchar), ''), lambda c: ord(c)::BIGINT)),
lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT)"""
OP11 = f"""WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS origin, {CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
u AS (SELECT c.conv_id, place, role, text, 0 AS own FROM c JOIN t ON t.conv_id = c.origin WHERE place <= h UNION ALL SELECT conv_id, place, role, text, 1 FROM c JOIN t USING (conv_id) WHERE place > h),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS depth, role, text FROM u),
k AS (SELECT conv_id, 0::BIGINT AS depth, sha256('') AS id, NULL::VARCHAR AS up, 0::BIGINT AS bytes FROM c
UNION ALL SELECT k.conv_id, r.depth, sha256(k.id || length(r.role) || ':' || r.role || r.text), k.id, octet_length(encode(r.text)) FROM k JOIN r ON r.conv_id = k.conv_id AND r.depth = k.depth + 1),
e AS (SELECT conv_id, max(depth) AS total FROM k GROUP BY 1),
n AS (SELECT id, any_value(up) AS up, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved, max(total) = any_value(depth) AS leaf, string_agg(cast(conv_id AS varchar), ',' ORDER BY conv_id) FILTER (WHERE depth = total) AS ends FROM k JOIN e USING (conv_id) GROUP BY id),
s AS (SELECT a.id, sum(saved) AS saved, sum(leaf::INT) AS leaves FROM n d JOIN k a ON a.conv_id = d.conv_id AND a.depth <= d.depth GROUP BY a.id),
h AS (SELECT up AS id, count(*) AS n FROM n WHERE up IS NOT NULL GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(h.n, 0) AS n_children, cast(leaves AS bigint) AS n_leaves, cast(s.saved AS bigint) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN s USING (id) LEFT JOIN h USING (id) LEFT JOIN n p ON p.id = n.up"""

USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
WHOLE = f"SELECT vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS double)) AS bigint)) AS e FROM embeddings WHERE {USABLE}"
OP12 = f"""WITH v AS ({WHOLE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, cast(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2])), 0) AS bigint) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS integer) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5"""


def op13() -> str:
    """Assignments and means of two rounds, written out."""
    steps = [f"v AS ({WHOLE})", "p AS (SELECT vec_id, label, k, list_slice(e, k * (len(e) // 16) + 1, (k + 1) * (len(e) // 16)) AS x FROM v, range(16) t(k))", "b0 AS (SELECT k, i, x AS c FROM (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS i FROM p) WHERE i < 64)"]
    for n in range(3):
        steps.append(f"d{n} AS (SELECT vec_id, label, p.k, i, x, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN b{n} b ON p.k = b.k)")
        steps.append(f"a{n} AS (SELECT vec_id, any_value(label) AS label, k, min_by(i, (d, i)) AS i, any_value(x) AS x, min(d) AS d FROM d{n} GROUP BY vec_id, k)")
        steps.append(f"m{n} AS (SELECT k, i, list(m ORDER BY j) AS c FROM (SELECT k, i, j, cast(floor(sum(y) / count(*)) AS bigint) AS m FROM (SELECT k, i, unnest(x) AS y, unnest(range(len(x))) AS j FROM a{n}) GROUP BY ALL) GROUP BY k, i)")
        steps.append(f"b{n + 1} AS (SELECT k, i, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN m{n} m USING (k, i))")
    steps.append("r AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', cast(i AS integer)), '' ORDER BY k) AS code, cast(sum(d) AS bigint) AS error FROM a2 GROUP BY vec_id)")
    steps.append("h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, i)) AS codebooks_sha256 FROM b2)")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, cast(sum(error) OVER (PARTITION BY label) AS bigint) AS label_error, codebooks_sha256 FROM r, h"


ORACLE_SQL = {"op1_ngram_jaccard": OP1, "op3_chat_format": OP3, "op4_embedding_dedup": OP4, "op5_decontamination": OP5, "op11_prefix_trie": OP11, "op12_exact_topk": OP12, "op13_vector_codes": op13()}
