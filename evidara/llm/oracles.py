"""SQL that a second engine (DuckDB) runs on the same tables, for the training-data queries that SQL can express."""

from __future__ import annotations

P1 = r"""
WITH d AS (SELECT DISTINCT doc_id, text, encode(text) AS raw FROM documents WHERE doc_id IS NOT NULL AND text <> ''),
h AS (SELECT DISTINCT d.doc_id, d.text, d.raw, o.byte_offset FROM d JOIN (
  SELECT doc_id, byte_offset FROM headings UNION ALL SELECT doc_id, 0 FROM documents) o USING (doc_id)
  WHERE o.byte_offset = 0 OR (o.byte_offset > 0 AND o.byte_offset < octet_length(d.raw))),
s AS (SELECT doc_id, text, raw, byte_offset, lead(byte_offset) OVER (PARTITION BY doc_id, text ORDER BY byte_offset) AS stop FROM h)
SELECT DISTINCT doc_id, byte_offset FROM s
WHERE length(decode(raw[byte_offset + 1 : coalesce(stop, octet_length(raw))])) > 4000
"""

P2 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, hash(ws[i], ws[i + 1], ws[i + 2]) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT c.a AS doc_id_a, c.b AS doc_id_b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b
WHERE c.c >= 0.6 * (x.n + y.n - c.c)
"""

P3 = r"""
WITH c AS (SELECT search_id, document_id, seq, max(bm25_score) AS b, -min(vector_distance) AS v, max(rerank_score) AS r
  FROM candidates GROUP BY 1, 2, 3),
g AS (SELECT search_id, document_id, seq, coalesce(b, '-inf'::DOUBLE) AS b, coalesce(v, '-inf'::DOUBLE) AS v, coalesce(r, '-inf'::DOUBLE) AS r FROM c)
SELECT x.search_id, x.document_id, x.seq FROM g x
WHERE NOT EXISTS (SELECT 1 FROM g y WHERE y.search_id = x.search_id AND (y.document_id, y.seq) <> (x.document_id, x.seq)
  AND (x.b > y.b)::INT + (x.v > y.v)::INT + (x.r > y.r)::INT < 2)
"""

P4 = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 300),
w AS (SELECT doc_id, i - 1 AS s, md5_number(substring(text, i, 300)) AS h
  FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM d)),
m AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
x AS (SELECT DISTINCT w.doc_id, w.s FROM w SEMI JOIN m ON w.h = m.h),
i AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 300 THEN 0 ELSE 1 END AS new FROM x),
k AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS isle FROM i)
SELECT doc_id, CAST(min(s) AS INTEGER) AS span_start, CAST(max(s) + 300 AS INTEGER) AS span_end FROM k GROUP BY doc_id, isle
"""

P6 = r"""
WITH c AS (SELECT id, max(vector::FLOAT[]) AS v FROM chunks WHERE vector IS NOT NULL AND list_max(list_transform(vector, lambda x: abs(x))) > 0 GROUP BY id),
u AS (SELECT id, list_transform(v, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(v, lambda y: y::DOUBLE * y)))) AS v FROM c),
p AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.v, b.v) AS cos FROM u a JOIN u b ON a.id <> b.id),
r AS (SELECT a, b, cos, row_number() OVER (PARTITION BY a ORDER BY round(cos, 12) DESC, b) AS n FROM p WHERE cos >= 0.9)
SELECT x.a AS id_a, x.b AS id_b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a
WHERE x.n <= 10 AND y.n <= 10 AND x.a < x.b AND x.cos >= 0.95
"""

P7 = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+') || coalesce(regexp_extract_all(lower(description), '\p{L}+'), [])) AS term
  FROM documents WHERE text IS NOT NULL UNION ALL
  SELECT doc_id, unnest(regexp_extract_all(lower(description), '\p{L}+')) FROM documents WHERE text IS NULL),
n AS (SELECT doc_id, term, count(*) AS n FROM t WHERE length(term) >= 5 GROUP BY 1, 2),
f AS (SELECT term FROM n GROUP BY term HAVING count(*) <= 6)
SELECT doc_id, term FROM n SEMI JOIN f USING (term) WHERE n >= 3
"""

P8 = r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS ws FROM eval_items),
g AS (SELECT DISTINCT item_id, array_to_string(ws[k : k + 9], ' ') AS gram FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 8)) AS k FROM i WHERE len(ws) >= 10)),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents),
x AS (SELECT doc_id, array_to_string(ws[k : k + 9], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 8)) AS k FROM d WHERE len(ws) >= 10))
"""
P8_FOUND = P8 + "SELECT DISTINCT doc_id, item_id FROM x JOIN g USING (gram)"
P8_ITEMS = P8 + "SELECT item_id, count(DISTINCT doc_id) AS documents, count(*) AS windows FROM x JOIN g USING (gram) GROUP BY item_id"

P9 = r"""
WITH t AS (SELECT lower(trim(source)) AS source, sum(target_share) AS target_share, max(max_repeats) AS max_repeats FROM mix_targets GROUP BY 1),
w AS (SELECT doc_id, lower(trim(source)) AS source, max(coalesce(len(regexp_extract_all(text, '\S+')), 0)) AS n FROM documents GROUP BY 1, 2),
s AS (SELECT source, sum(n) AS n FROM w SEMI JOIN t USING (source) GROUP BY source)
SELECT t.source FROM t LEFT JOIN s USING (source) WHERE t.max_repeats * coalesce(s.n, 0) < t.target_share * (SELECT sum(n) FROM s)
"""


P2_GROUPS = f"""
WITH RECURSIVE pairs AS ({P2.strip()}),
ends AS (SELECT doc_id_a AS a, doc_id_b AS b FROM pairs UNION ALL SELECT doc_id_b, doc_id_a FROM pairs),
reach(node, other) AS (SELECT a, b FROM ends UNION SELECT r.node, e.b FROM reach r JOIN ends e ON r.other = e.a),
ids AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL),
lists AS (SELECT a, count(DISTINCT b) AS links FROM ends GROUP BY a),
firsts AS (SELECT node, min(other) AS first FROM reach GROUP BY node),
own AS (SELECT doc_id, text, len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS n FROM documents),
same AS (SELECT text, min(doc_id) AS first FROM own WHERE n >= 3 GROUP BY text)
SELECT i.doc_id, least(i.doc_id, coalesce(f.first, i.doc_id)) AS group_id, coalesce(l.links, 0) AS links, coalesce(s.first, i.doc_id) AS class_id
FROM ids i LEFT JOIN firsts f ON f.node = i.doc_id LEFT JOIN lists l ON l.a = i.doc_id JOIN own o ON o.doc_id = i.doc_id LEFT JOIN same s ON s.text = o.text
""".replace("\\\\", "\\")

P3_RANKING = r"""
WITH c AS (SELECT search_id, document_id, seq, max(bm25_score) AS g0, max(-vector_distance) AS g1, max(rerank_score) AS g2 FROM candidates
  WHERE search_id IS NOT NULL AND document_id IS NOT NULL AND seq IS NOT NULL GROUP BY 1, 2, 3),
one AS (SELECT search_id, CASE WHEN count(DISTINCT collection) = 1 THEN max(collection) END AS collection FROM candidates GROUP BY 1),
u AS (SELECT max(bm25_weight) AS ub, max(vector_weight) AS uv FROM search_settings WHERE collection IS NULL),
o AS (SELECT collection, max(bm25_weight) AS ob, max(vector_weight) AS ov FROM search_settings WHERE collection IS NOT NULL GROUP BY 1),
wt AS (SELECT search_id, coalesce(ob, ub, 0.5) AS w0, coalesce(ov, uv, 0.5) AS w1 FROM one LEFT JOIN o USING (collection) CROSS JOIN u),
long AS (SELECT search_id, document_id, seq, 0 AS i, g0 AS g, w0 AS w FROM c JOIN wt USING (search_id)
  UNION ALL SELECT search_id, document_id, seq, 1, g1, w1 FROM c JOIN wt USING (search_id) UNION ALL SELECT search_id, document_id, seq, 2, g2, 1.0 FROM c),
q AS (SELECT *, quantile_disc(g, 0.05) OVER p AS a, quantile_disc(g, 0.95) OVER p AS z FROM long WINDOW p AS (PARTITION BY search_id, i)),
k AS (SELECT *, CASE WHEN g IS NOT NULL THEN least(greatest(g, a), z) END AS c FROM q),
m AS (SELECT *, min(c) OVER p AS lo, max(c) OVER p AS hi, sqrt(sum(c * c) OVER p) AS norm FROM k WINDOW p AS (PARTITION BY search_id, i)),
d AS (SELECT search_id, document_id, seq, sqrt(sum(coalesce(power(w * (coalesce(c, lo) - lo) / CASE WHEN norm > 0 THEN norm END, 2), 0))) AS far,
  sqrt(sum(coalesce(power(w * (coalesce(c, lo) - hi) / CASE WHEN norm > 0 THEN norm END, 2), 0))) AS near FROM m GROUP BY 1, 2, 3),
r AS (SELECT *, CASE WHEN far + near > 0 THEN far / (far + near) ELSE 0.5 END AS closeness FROM d)
SELECT search_id, document_id, seq, row_number() OVER (PARTITION BY search_id ORDER BY round(closeness, 12) DESC, document_id, seq) AS rank, round(closeness, 6) AS closeness FROM r
"""

P4_SHARES = f"""
WITH spans AS ({P4.strip()}),
n AS (SELECT doc_id, max(length(text)) AS n FROM documents GROUP BY 1),
held AS (SELECT doc_id, count(*) AS spans, sum(span_end - span_start) AS held FROM spans GROUP BY 1)
SELECT n.doc_id, coalesce(spans, 0) AS spans, round(coalesce(held / n, 0), 6) AS share FROM n LEFT JOIN held USING (doc_id)
"""

P7_TERMS = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{L}+') || regexp_extract_all(lower(coalesce(description, '')), '\p{L}+')) AS term FROM documents),
n AS (SELECT doc_id, term, count(*)::DOUBLE AS n FROM t WHERE length(term) >= 5 GROUP BY 1, 2),
f AS (SELECT term, sum(n) AS total, count(*) AS df FROM n GROUP BY 1),
x AS (SELECT doc_id, term, n, df, total, sum(n) OVER (PARTITION BY doc_id) AS size, (SELECT sum(n) FROM n) AS every FROM n JOIN f USING (term)),
g AS (SELECT *, 2 * (n * ln(n * every / (size * total))
  + CASE WHEN size > n THEN (size - n) * ln((size - n) * every / (size * (every - total))) ELSE 0 END
  + CASE WHEN total > n THEN (total - n) * ln((total - n) * every / ((every - size) * total)) ELSE 0 END
  + CASE WHEN every - size - total + n > 0 THEN (every - size - total + n) * ln((every - size - total + n) * every / ((every - size) * (every - total))) ELSE 0 END) AS g FROM x),
s AS (SELECT doc_id, term, n::BIGINT AS n, df, greatest(g, 0) * CASE WHEN n * every >= total * size THEN 1 ELSE -1 END AS score FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM s)
SELECT doc_id, rank, term, n, df, round(score, 6) AS score FROM r WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1, "p2_found": P2, "p3_found": P3, "p2_groups": P2_GROUPS, "p3_ranking": P3_RANKING, "p4_found": P4, "p4_shares": P4_SHARES, "p6_found": P6, "p7_found": P7, "p7_terms": P7_TERMS, "p8_found": P8_FOUND, "p8_items": P8_ITEMS, "p9_found": P9}
