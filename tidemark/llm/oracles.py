"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACHED = "l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r(a, b) AS (SELECT {id}, {id} FROM {table} UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)"

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
{_REACHED.format(id="doc_id", table="documents")}
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, coalesce(k, 0) AS n_links
FROM (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS k FROM l GROUP BY a) USING (doc_id)
"""

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
u AS (SELECT doc_id, w[i] AS word, i, CASE WHEN i + 34 <= len(w) THEN array_to_string(w[i : i + 34], ' ') END AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
f AS (SELECT doc_id, word, i, g IS NOT NULL AND count(*) OVER (PARTITION BY g) > 1 AS twice FROM u),
c AS (SELECT doc_id, word, i, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

NEARDUP = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) > 0),
p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.9),
{_REACHED.format(id="vec_id", table="embeddings")}
SELECT vec_id, coalesce(k, 0) AS n_links, c AS component_id, c = vec_id AS kept
FROM (SELECT a AS vec_id, min(b) AS c FROM r GROUP BY a) LEFT JOIN (SELECT a AS vec_id, count(*) AS k FROM l GROUP BY a) USING (vec_id)
"""

_ASSIGN = """(?i:(password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = [(0, _ASSIGN), (1, "AKIA[A-Z0-9]+"), (2, "[0-9a-f]+"), (3, "[A-Za-z0-9/+=]+"), (4, "https?://[A-Za-z0-9.-]+(?::[0-9]+)?"), (5, "[A-Za-z0-9./-]+")]
_FOUND = " UNION ALL ".join(
    f"SELECT r, {k} AS k, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS f, {f"regexp_extract_all(t, '{p}', 2)" if k == 0 else "NULL"} AS v FROM d" for k, p in _KINDS
)
_BESIDE = "EXISTS (SELECT 1 FROM {of} y WHERE y.r = x.r AND {is_} AND greatest(x.s - y.e, y.s - x.e) <= 400)"
_LISTED = "string_agg(['assign', 'access', 'hex', 'key', 'endpoint'][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e)"

#: Matches and the gaps before them give positions; parts are linked by their distance.
SECRETS = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT r, k, i, f[i] AS f, v[i] AS v, len(g[i]) AS g FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM ({_FOUND}))),
p AS (SELECT r, k, f, v, sum(g + len(f)) OVER (PARTITION BY r, k ORDER BY i) AS e FROM m),
q AS (SELECT r, k, e - len(f) AS s, e, f, split_part(f, '/', 1) AS host FROM p
      WHERE CASE k WHEN 0 THEN len(v) >= 12 WHEN 1 THEN len(f) >= 18 WHEN 2 THEN len(f) >= 16 WHEN 3 THEN len(f) = 40 AND NOT contains(f, '=') WHEN 5 THEN regexp_matches(host, '\.amazonaws\.com[.-]?$') ELSE true END),
w AS (SELECT r, least(k, 4) AS k, CAST(s AS BIGINT) AS s, CAST(CASE k WHEN 5 THEN s + len(host) ELSE e END AS BIGINT) AS e FROM q),
a AS (SELECT *, {_BESIDE.format(of="w", is_="y.k = 1")} AS access, {_BESIDE.format(of="w", is_="y.k = 0")} AS secret FROM w x),
z AS (SELECT *, k < 3 OR access OR (k = 4 AND secret) OR (k = 3 AND {_BESIDE.format(of="a", is_="y.k = 4 AND y.access")}) AS listed FROM a x),
n AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, {_LISTED} FILTER (k < 3) AS base, {_LISTED} FILTER (listed) AS spans FROM z GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN n USING (r)
"""

#: Bytes as hexadecimal digits, cut into pieces first: a substring deep in a long text would be slow.
SUFFIXES = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT r, c, substr(h, 400 * c + 1, 498) AS p FROM (SELECT r, h, unnest(range(0, len(h) // 400 + 1)) AS c FROM d)),
s AS (SELECT r, 200 * c + i AS a, substr(p, 2 * i + 1, 100) AS g FROM (SELECT *, unnest(range(0, least(200, greatest(len(p) // 2 - 49, 0)))) AS i FROM c)),
f AS (SELECT g, min(coalesce(doc_id, 9223372036854775807)) AS first FROM s JOIN d USING (r) GROUP BY g HAVING count(*) > 1),
m AS (SELECT r, a, CASE WHEN a <= lag(a) OVER (PARTITION BY r ORDER BY a) + 50 THEN 0 ELSE 1 END AS fresh FROM s JOIN f USING (g) JOIN d USING (r) WHERE first < coalesce(doc_id, 9223372036854775807)),
i AS (SELECT r, min(a) AS a, max(a) + 50 AS b FROM (SELECT r, a, sum(fresh) OVER (PARTITION BY r ORDER BY a) AS n FROM m) GROUP BY r, n),
g AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM i),
k AS (SELECT r, sum(b - a) AS n, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM g JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""

def _centroids(rounds: int = 10) -> str:
    """Rounds one after the other, each with exact floors of integer means."""
    nearest = "SELECT r, i, v, min_by({{}}, (d, k)) AS k, min(d) AS d FROM (SELECT v.r, v.i, v.v, c.k, list_sum(list_transform(list_zip(v.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{n} c) GROUP BY r, i, v"
    steps = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id AS i, list_transform(embedding, lambda x: floor(1024 * greatest(-131072, least(131072, x::DOUBLE)))::BIGINT) AS v FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || i) NULLS LAST, v) - 1 AS k, v AS c FROM v QUALIFY k < 8)",
    ]
    for n in range(rounds):
        steps.append(f"a{n} AS MATERIALIZED ({nearest.format(n=n).format('k')})")
        steps.append(f"m{n} AS (SELECT k, j, sum(v[j]) AS s, count(*) AS n FROM (SELECT k, v, unnest(range(1, 65)) AS j FROM a{n}) GROUP BY k, j)")
        steps.append(f"c{n + 1} AS MATERIALIZED (SELECT k, coalesce(f, c) AS c FROM c{n} LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS f FROM m{n} GROUP BY k) USING (k))")
    steps.append(f"z AS MATERIALIZED ({nearest.format(n=rounds).format('k')})")
    return "WITH " + ",\n".join(steps) + (
        "\nSELECT i AS vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,"
        f" sha256(array_to_string(c, ',')) AS centroid_sha256 FROM z JOIN c{rounds} USING (k)"
    )


CENTROIDS = _centroids()

#: crc32 by its table, which a rule of eight steps makes.
_CRC = "xor(4294967295, list_reduce(list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda h: CAST(ascii(h) AS BIGINT)), lambda c, b: xor(c >> 8, crc.t[1 + (xor(c, b) & 255)]), CAST(4294967295 AS BIGINT)))"
_EIGHT = "list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)"

TRIE = rf"""
WITH crc AS (SELECT list_transform(range(256), lambda i: {_EIGHT}) AS t),
o AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, s, conv_id - conv_id % 20 AS base, CAST({_CRC.format(x="conv_id")} % 4 AS INTEGER) AS h FROM o, crc),
w AS (SELECT h.conv_id, list_concat(CASE WHEN b.s IS NULL THEN [] ELSE b.s[1 : h.h] END, h.s[h.h + 1 :]) AS s FROM h LEFT JOIN o b ON b.conv_id = h.base),
p AS (SELECT conv_id, d, sha256(CAST(len(s[1 : d]) AS VARCHAR) || coalesce(array_to_string(list_transform(s[1 : d], lambda x: sha256(x.r) || sha256(x.t)), ''), '')) AS k,
      CASE WHEN d > 0 THEN len({_WORDS.format(text="s[d].t")}) ELSE 0 END AS words, d = len(s) AS last FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM w)),
n AS (SELECT k, any_value(d) AS d, min(conv_id) AS c, count(*) AS n, any_value(words) AS words, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS e FROM p GROUP BY k),
u AS (SELECT DISTINCT x.k, y.k AS up, y.d AS d FROM p x JOIN p y ON x.conv_id = y.conv_id AND y.d <= x.d),
g AS (SELECT up AS k, count(*) AS children FROM u JOIN n USING (k) WHERE n.d = u.d + 1 GROUP BY up),
t AS (SELECT u.up AS k, count(*) FILTER (g.children IS NULL) AS leaves, sum((n.n - 1) * n.words) AS saved FROM u JOIN n USING (k) LEFT JOIN g USING (k) GROUP BY u.up),
a AS (SELECT u.k, m.c FROM u JOIN n USING (k) JOIN n m ON m.k = u.up WHERE m.d = n.d - 1)
SELECT n.c AS conv_id, n.d AS depth, a.c AS parent_conv_id, n.n AS n_convs, coalesce(g.children, 0) AS n_children, t.leaves AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, n.e AS ends_sha256
FROM n JOIN t USING (k) LEFT JOIN g USING (k) LEFT JOIN a USING (k)
"""
