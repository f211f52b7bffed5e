"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .licences import template_rows

SPACES = "[^\\x20\\x09-\\x0D]+"
LETTERS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def repeats(docs: str, window: int, key: str, count: str, spans: str, kept: str) -> str:
    """docs: rows doc_id, n (number of units), u (list of units); key: the window that starts at unit p."""
    return f"""WITH docs AS ({docs}), w AS (SELECT doc_id, p, {key} AS key FROM docs, LATERAL (SELECT unnest(range(1, n - {window - 2})) AS p)),
f AS (SELECT doc_id, p AS i, CAST(min(doc_id) OVER (PARTITION BY key) < doc_id AS INT) AS starts FROM w),
un AS (SELECT doc_id, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM docs),
c AS (SELECT doc_id, i, x, coalesce(max(starts) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW), 0) AS gone FROM un LEFT JOIN f USING (doc_id, i)),
o AS (SELECT *, CAST(gone > lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS INT) AS opens FROM c),
s AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, CAST(sum(opens) AS BIGINT) AS n_spans, {kept} AS sha FROM o GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS {count}, coalesce(n_removed, 0) AS n_removed, {spans} coalesce(sha, sha256('')) AS kept_sha256 FROM docs LEFT JOIN s USING (doc_id)"""


BYTES = "SELECT doc_id, len(x) // 2 AS n, x, [x[2 * i - 1 : 2 * i] for i in range(1, len(x) // 2 + 1)] AS u FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents)"
WORDS = f"SELECT doc_id, len(u) AS n, u FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACES}') AS u FROM documents)"

OP1 = repeats(BYTES, 50, "md5(substr(x, 2 * p - 1, 100))", "n_bytes", "coalesce(n_spans, 0) AS n_spans,", "sha256(unhex(string_agg(x, '' ORDER BY i) FILTER (gone = 0)))")
OP8 = repeats(WORDS, 13, "array_to_string(u[p : p + 12], chr(31))", "n_words", "", "sha256(string_agg(x, ' ' ORDER BY i) FILTER (gone = 0))")

OP2 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{LETTERS}') AS u FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{LETTERS}') AS u FROM benchmark),
pat AS (SELECT DISTINCT item_id, least(13, len(u)) AS m, array_to_string(u[p : p + least(13, len(u)) - 1], ' ') AS key FROM i, LATERAL (SELECT unnest(range(1, len(u) - least(13, len(u)) + 2)) AS p) WHERE len(u) > 0),
len_ AS (SELECT DISTINCT m FROM pat),
w AS (SELECT doc_id, m, p, array_to_string(u[p : p + m - 1], ' ') AS key FROM d, len_, LATERAL (SELECT unnest(range(1, len(u) - m + 2)) AS p)),
h AS (SELECT doc_id, w.m, p, item_id FROM w JOIN pat USING (m, key)),
hits AS (SELECT doc_id, count(DISTINCT p + j) AS n_hit FROM h, range(0, 13) t(j) WHERE j < m GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY 1)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(u) AS contaminated FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)"""

OP3 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 20"""

OP4 = f"""WITH RECURSIVE r AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{SPACES}')) AS BIGINT) AS size, md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM r GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(k - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 3 AS cap FROM s),
o AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(weight) OVER () AS weights, coalesce(sum(cap) OVER a, 0) AS stopped, coalesce(sum(weight) OVER a, 0) AS gone FROM w WINDOW a AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - stopped) / (weights - gone) AS rest FROM o),
t AS (SELECT source, source_size, k, least(cap, weight * (SELECT arg_min(rest, struct_pack(a := cap / weight, b := k)) FROM l WHERE rest <= cap / weight)) AS target FROM l),
q AS (SELECT r.*, t.source_size, t.k, t.target, sum(size) OVER (PARTITION BY t.k ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
c AS (SELECT doc_id, k, key, size, CAST(e * source_size + upto AS DOUBLE) / target AS finish FROM q, range(0, 3) x(e) WHERE size > 0),
g AS (SELECT doc_id, k, size, sum(size) OVER (ORDER BY finish, k, key, doc_id ROWS UNBOUNDED PRECEDING) AS reached FROM c),
n AS (SELECT doc_id, k, CAST(sum(size) AS BIGINT) AS taken FROM g WHERE reached <= (SELECT sum(size) FROM r) GROUP BY 1, 2)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(n.taken, 0) AS taken FROM q LEFT JOIN n ON n.doc_id = q.doc_id AND n.k = q.k"""

OP7 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{SPACES}') AS u FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(u[p : p + 4], ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, greatest(len(u) - 4, 1) + 1)) AS p) WHERE len(u) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
l AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM l JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * m >= 75 * (a.n + b.n - m)),
r AS (SELECT doc_id AS node, doc_id AS reach FROM d UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.reach)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(reach) AS component_id FROM r GROUP BY 1) c USING (doc_id)"""

TEMPLATES = ", ".join(f"({a}, '{b}', {c}, {d}, {e}, '{f}', '{g}')" for a, b, c, d, e, f, g in template_rows())

OP6 = f"""WITH t(template, label, phrase, words, i, one, two) AS (VALUES {TEMPLATES}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{LETTERS}') AS u FROM documents),
g AS (SELECT r, p - 1 AS place, u[p] AS one, u[p + 1] AS two FROM d, LATERAL (SELECT unnest(range(1, len(u))) AS p)),
v AS (SELECT r, template, label, phrase, words, place - i AS diagonal, i, place FROM g JOIN t USING (one, two)),
l AS (SELECT r, template, label, phrase, words, diagonal, list(DISTINCT i) AS ats, min(place) AS low, max(place) AS high FROM v GROUP BY 1, 2, 3, 4, 5, 6),
m AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w <= 2 THEN 0 ELSE 1 END AS apart FROM l WHERE NOT phrase WINDOW w AS (PARTITION BY r, template ORDER BY diagonal)),
n AS (SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal) AS island FROM m),
s AS (SELECT r, template, label, words, island, len(list_distinct(flatten(list(ats)))) AS hits, min(low) AS low, max(high) AS high FROM n GROUP BY 1, 2, 3, 4, 5),
f AS (SELECT r, label, diagonal AS start, true AS base, CAST(1 AS DOUBLE) AS share FROM l WHERE phrase AND len(ats) = words - 1
UNION ALL SELECT r, label, low, false, hits / CAST(words - 1 AS DOUBLE) FROM s WHERE hits / CAST(words - 1 AS DOUBLE) >= 0.7 AND high + 2 - low <= 1.5 * words + 1),
a AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM f GROUP BY 1)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score FROM d LEFT JOIN a USING (r)"""

ORACLES: dict[str, str] = {
    "op1_suffix_array_dedup": OP1,
    "op2_wu_manber_decontamination": OP2,
    "op3_top_inner_products": OP3,
    "op4_fair_queue_mixing": OP4,
    "op6_licence_diagonals": OP6,
    "op7_near_duplicates": OP7,
    "op8_phrase_dedup": OP8,
}
