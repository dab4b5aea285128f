"""The registered queries by brute force in DuckDB's dialect: other ways to the same rows, without sketches, lists or tiles."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + ", '[^\\x20\\x09-\\x0D]+')"
_VECTORS = """r AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT i, vec_id, e, len(e) AS dim, sqrt(list_inner_product(e, e)) AS norm FROM r WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0)"""
#: From links (a, b) both ways between rows: the rows that each reaches.
_REACH = "reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)"

EMBEDDINGS = f"""WITH RECURSIVE {_VECTORS}, links AS (SELECT x.i AS a, y.i AS b FROM ok x JOIN ok y ON x.dim = y.dim AND x.i <> y.i WHERE list_inner_product(x.e, y.e) / (x.norm * y.norm) >= 0.95::DOUBLE),
{_REACH}, least AS (SELECT a, min(vec_id) AS low FROM reach JOIN r ON r.i = b GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(low, vec_id), vec_id) AS component_id, vec_id IS NOT DISTINCT FROM coalesce(least(low, vec_id), vec_id) AS kept FROM r LEFT JOIN least ON least.a = r.i LEFT JOIN n ON n.a = r.i"""

MINHASH = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS common FROM e x JOIN e y ON x.sh = y.sh AND x.doc_id < y.doc_id AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 80 GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * common >= 80 * (na + nb - common)), links AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
{_REACH}, least AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(low, doc_id)) AS kept FROM s LEFT JOIN least ON a = doc_id"""

LINES = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
w AS (SELECT *, {_WORDS.format('line')} AS w FROM l),
g AS (SELECT row_number() OVER () AS k, w, len(w) AS n, min((doc_id, no)) AS earliest FROM w WHERE len(w) > 0 GROUP BY w),
lv AS (SELECT k, w, n, earliest, unnest([n, n - 1]) AS level FROM g WHERE n >= 8),
h AS (SELECT k, w, n, earliest, level, unnest([1, 2]) AS side, unnest([array_to_string(w[1:level // 2], ' '), array_to_string(w[n - level + level // 2 + 1:n], ' ')]) AS half FROM lv),
c AS (SELECT DISTINCT x.k AS k, y.k AS other FROM h x JOIN h y USING (level, side, half) WHERE x.k <> y.k AND y.earliest < x.earliest AND abs(x.n - y.n) <= 1),
t AS (SELECT c.k, CASE WHEN a.n <= b.n THEN a.w ELSE b.w END AS short, CASE WHEN a.n <= b.n THEN b.w ELSE a.w END AS long FROM c JOIN g a ON a.k = c.k JOIN g b ON b.k = c.other),
f AS (SELECT *, coalesce(list_min(list_filter(range(1, len(short) + 1), lambda i: short[i] <> long[i])), len(short) + 1) AS m FROM t),
near AS (SELECT DISTINCT k FROM f WHERE list_slice(short, CASE WHEN len(long) = len(short) THEN m + 1 ELSE m END, len(short)) = list_slice(long, m + 1, len(long))),
kept AS (SELECT w.doc_id, w.no, w.line FROM w LEFT JOIN g ON g.w = w.w LEFT JOIN near ON near.k = g.k WHERE len(w.w) = 0 OR ((w.doc_id, w.no) = g.earliest AND near.k IS NULL)),
d AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY no) AS left_ FROM kept GROUP BY doc_id),
o AS (SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(left_, '') END AS t FROM documents LEFT JOIN d USING (doc_id))
SELECT doc_id, len(string_split(t, chr(10))) AS n_lines, length(t) AS n_chars_left, sha256(t) AS text_sha256 FROM o"""

#: Every string of 50 bytes (100 hexadecimal digits) with the least document that holds it.
REPEATS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 100)) AS s FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS i FROM d WHERE len(x) >= 100)),
m AS (SELECT s, min(doc_id) AS low FROM s GROUP BY s),
c AS (SELECT s.doc_id, s.i, s.i - 1 - coalesce(lag(s.i) OVER (PARTITION BY s.doc_id ORDER BY s.i), -1000) >= 50 AS new FROM s JOIN m USING (s) WHERE m.low < s.doc_id),
g AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM c),
r AS (SELECT doc_id, g, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY ALL),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM r),
t AS (SELECT k.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(x, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS kept, max(b) AS last FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept || substr(x, 2 * last + 1), x))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""
