"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

_DECONTAMINATE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), g AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM g),
p AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, lengths)
), h AS (SELECT doc_id, p.n, i, item_id FROM p JOIN g ON p.n = g.n AND p.gram = g.gram),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


_SPAN = """
  SELECT doc_id, text, {ord} AS ord, '{kind}' AS kind, m[i] AS v, {value} AS val, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT doc_id, text, m, g, vals, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS vals, string_split_regex(text, '{pattern}') AS g FROM d))
"""


def _secret_sql() -> str:
    from survperf.llm import secrets as S

    token = "[A-Za-z0-9+/_-]{32,}={0,2}"
    quoted = lambda p: p.replace("'", "''")
    spans = {"assign": (S.ASSIGN, 2), "access": (S.ACCESS, 0), "hex": (S.HEX, 0), "token": (token, 0), "user": (S.USER, 0), "endpoint": (S.ENDPOINT, 0)}
    rows = " UNION ALL ".join(_SPAN.format(ord=i, kind=k, pattern=quoted(p), group=g, value="vals[i]") for i, (k, (p, g)) in enumerate(spans.items()))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS (SELECT doc_id, ord, kind, s, s + length(v) AS e, v, val FROM ({rows})),
kept AS (
  SELECT *, kind IN ('assign', 'hex', 'token') AS secret, kind IN ('assign', 'access', 'hex') AS strong FROM found
  WHERE (kind <> 'assign' OR length(val) >= 6) AND (kind <> 'token' OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')))
),
parts AS (SELECT * FROM kept k WHERE strong OR NOT EXISTS (SELECT 1 FROM kept t WHERE t.doc_id = k.doc_id AND t.strong AND t.s <= k.s AND k.e <= t.e)),
shown AS (
  SELECT * FROM parts p WHERE strong OR EXISTS (SELECT 1 FROM parts q WHERE q.doc_id = p.doc_id AND q.secret <> p.secret AND q.s - p.e <= {S.REACH} AND p.s - q.e <= {S.REACH})
),
lists AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord, e) FILTER (strong) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord, e) AS spans FROM shown GROUP BY 1
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN lists USING (doc_id)
"""


def _license_sql() -> str:
    from survperf.llm import licenses as L

    words = "regexp_extract_all(translate(coalesce(TEXT, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + L.WORD + "')"
    grams = f"list_distinct(list_transform(range(1, greatest(len(w) - {L.SHINGLE - 1}, 0) + 1), lambda i: array_to_string(w[i:i + {L.SHINGLE - 1}], ' ')))"
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in L.TEMPLATES.items())
    return f"""
WITH t AS (SELECT name, {grams} AS g FROM (SELECT name, {words.replace("TEXT", "body")} AS w FROM (VALUES {rows}) v(name, body))),
d AS (SELECT doc_id, {grams} AS g FROM (SELECT doc_id, {words.replace("TEXT", "text")} AS w FROM documents)),
m AS (SELECT doc_id, name, len(list_intersect(t.g, d.g)) / len(t.g) AS share FROM d, t WHERE list_has_any(d.g, t.g))
SELECT d.doc_id, coalesce(n, 0) AS n_licenses, coalesce(names, '') AS licenses, coalesce(round(best, 6), 0) AS best_share
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names, max(share) AS best FROM m WHERE share >= {L.CONTAINED} GROUP BY 1) USING (doc_id)
"""


def _crc32(text: str) -> str:
    """Unsigned crc32 of a UTF-8 string, a step a bit."""
    byte = "list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))"
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda o: CAST('0x' || o AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: {byte}), 4294967295)"


def _trie_sql() -> str:
    return f"""
WITH raw AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS j, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
),
sizes AS (SELECT c, max(j) AS n FROM raw GROUP BY 1),
convs AS (SELECT s.c, s.c - s.c % 20 AS b, {_crc32("CAST(s.c AS VARCHAR)")} % 4 AS h FROM sizes s),
took AS (SELECT convs.*, least(h, coalesce(n, 0)) AS k FROM convs LEFT JOIN sizes s ON s.c = b),
turns AS (
  SELECT t.c, j AS d, role, text FROM took t JOIN raw r ON r.c = b AND j <= k
  UNION ALL SELECT t.c, j - h + k, role, text FROM took t JOIN raw r ON r.c = t.c AND j > h
),
paths AS (SELECT c, d, text, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY c ORDER BY d) AS p FROM turns UNION ALL SELECT c, 0, '', '' FROM convs),
ends AS (SELECT p, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, max_by(p, d) AS p FROM paths GROUP BY c) GROUP BY p),
nodes AS (SELECT p, d, min(c) AS c, count(*) AS n, (count(*) - 1) * len(regexp_extract_all(min(text), '[^\x20\x09-\x0D]+')) AS own FROM paths GROUP BY p, d),
kids AS (SELECT p[1:64 * (d - 1)] AS p, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY 1),
below AS (SELECT n.p[1:64 * i] AS p, sum(CAST(kids IS NULL AS BIGINT)) AS leaves, sum(own) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM nodes) n LEFT JOIN kids k ON k.p = n.p GROUP BY 1)
SELECT n.c AS conv_id, n.d AS depth, u.c AS parent_conv_id, n.n AS n_convs, coalesce(kids, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes u ON n.d > 0 AND u.d = n.d - 1 AND u.p = n.p[1:64 * (n.d - 1)] LEFT JOIN kids k ON k.p = n.p LEFT JOIN ends e ON e.p = n.p JOIN below b ON b.p = n.p
"""


def _spelling_sql() -> str:
    return f"""
WITH RECURSIVE runs AS (
  SELECT d, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r
  FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents)
),
once AS (SELECT d, r, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT *, {_crc32("d || ':' || r")} AS h FROM once),
spelled AS (SELECT CASE WHEN h % 97 = 0 THEN r[1:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
blanks AS (SELECT word, n, i, word[1:i - 1] AS a, word[i + 1:] AS b FROM places),
shorter AS (SELECT DISTINCT x.word AS long, x.n AS long_n, w.word AS short, w.n AS short_n FROM blanks x JOIN words w ON w.word = x.a || x.b),
near AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM blanks x JOIN blanks y USING (i, a, b) WHERE x.word <> y.word
  UNION ALL SELECT long, short, short_n FROM shorter UNION ALL SELECT short, long, long_n FROM shorter
),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS top_n FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 2 * w.n THEN top_n END AS form_n,
    (SELECT min(other) FROM near WHERE near.word = w.word AND other_n = top_n AND top_n >= 2 * w.n) AS form
  FROM words w LEFT JOIN best b ON b.word = w.word
),
chain AS (SELECT word, word AS stop FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.stop WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.stop FROM chain c JOIN forms f ON f.word = c.stop WHERE f.form IS NULL)
SELECT f.word, form, stop AS root, n, n_near, form_n FROM forms f JOIN ends USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_spelling": _spelling_sql(), "op13_trie": _trie_sql(), "op2_decontaminate": _DECONTAMINATE, "op4_secrets": _secret_sql(), "op8_licenses": _license_sql()}
