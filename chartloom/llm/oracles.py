"""Check SQL (DuckDB) of the operator queries that SQL can express."""

from __future__ import annotations

_WORDS = "list_filter(string_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"

TOP_K = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE {_FINITE}),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

REPEATS = f"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS t, generate_subscripts(ws, 1) AS p FROM d),
win AS (SELECT doc_id, p, n, string_agg(t, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS k FROM w),
whole AS (SELECT * FROM win WHERE p <= n - 34),
again AS (SELECT doc_id, p FROM whole WHERE k IN (SELECT k FROM whole GROUP BY k HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS p FROM again),
kept AS (SELECT w.doc_id, count(g.p) AS n_removed, string_agg(t, ' ' ORDER BY w.p) FILTER (g.p IS NULL) AS words FROM w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.p = w.p GROUP BY w.doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

_COMPONENTS = """reach AS (SELECT id, id AS r FROM ids UNION SELECT l.b, r FROM reach JOIN links l ON l.a = reach.id),
component AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)"""

NEAR_DUPLICATES = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS t, generate_subscripts(ws, 1) AS p FROM d),
win AS (SELECT doc_id, p, n, string_agg(t, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS k FROM w),
sh AS (SELECT DISTINCT doc_id, k FROM win WHERE p <= greatest(n - 4, 1)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL),
one AS (SELECT a, b FROM pair JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
links AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one), ids AS (SELECT doc_id AS id FROM d), {_COMPONENTS}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN size USING (doc_id) JOIN component ON id = d.doc_id"""

VECTOR_LINKS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
ids AS (SELECT vec_id AS id FROM embeddings), {_COMPONENTS}, n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT id AS vec_id, coalesce(n_links, 0) AS n_links, component_id, id = component_id AS kept FROM component LEFT JOIN n ON a = id"""

SOURCE_AUDIT = """WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
t AS (SELECT id, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept k USING (lang) GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
full_c AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // ((sum(n) OVER (PARTITION BY lang, source)) + 5 * v) AS p FROM full_c JOIN v USING (lang)),
l AS (SELECT lang, term, sum(n) AS n FROM full_c GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // ((sum(n) OVER (PARTITION BY lang)) + 5 * v) AS q FROM l JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p - q)::BIGINT AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50"""

# the control strings of the template, with any number of backslashes behind their first sign
_ESCAPED = r"""regexp_replace(regexp_replace(text, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?(?:SYS|INST|ROLE|TEXT)\])', '[\\\1', 'g')"""

CHATS = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length({_ESCAPED}) + CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 16 WHEN 'assistant' THEN 8
  ELSE 20 + length({_ESCAPED.replace("text", "role", 1)}) END AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


def _cluster_sql(clusters: int = 8, rounds: int = 10) -> str:
    """Rounds one after another; c0, c1, ... have the centroids, a0, a1, ... the assignments."""
    parts = [f"""v AS (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND {_FINITE})""",
             f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), q) - 1 AS c, q FROM v WHERE vec_id IS NOT NULL QUALIFY c < {clusters})"]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT id, vec_id, v.q, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT v.*, c.c, list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{i} c) v GROUP BY ALL)""")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT c, list(m ORDER BY j) AS q FROM (SELECT c, j, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
  FROM (SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS j FROM a{i}) GROUP BY c, j) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(s{i}.q, c{i}.q) AS q FROM c{i} LEFT JOIN s{i} USING (c))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, a.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c"""


CLUSTERS = _cluster_sql()
