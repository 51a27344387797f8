"""SQL that a second engine (DuckDB) runs on the same tables, for the queries of the catalogue that SQL can express."""

from __future__ import annotations

from evidara.functions.columns import STOPWORDS
from evidara.operators.descriptors import FILLERS
from evidara.operators.retrieval import B, K1

WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"


def words(x: str) -> str:
    return f"coalesce({WORDS.format(x)}, [])"


def terms(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"list_filter(list_distinct({words(x)}), lambda w: length(w) > 2 AND NOT list_contains([{stop}], w))"


CORPUS = "corpus AS (SELECT DISTINCT ON (collection, document_id, seq) * FROM chunks WHERE text IS NOT NULL)"
ASKED = f"asked AS (SELECT item_id AS query_id, unnest({terms('question')}) AS term FROM eval_items WHERE question IS NOT NULL)"
NAMES = "names AS (SELECT document_id, min(name) AS name FROM documents GROUP BY 1)"


def bm25(rows: str = "corpus", key: str = "collection, document_id, seq", index: str = "", asked: str = "asked") -> str:
    """CTEs up to scored(query_id, index, key, score)."""
    comma = f"{index}, " if index else ""
    on = f" AND x.{index} = y.{index}" if index else ""
    return f"""
own AS (SELECT {comma}{key}, {words('framed')} AS w FROM {rows}),
flat AS (SELECT {comma}{key}, len(w) AS dl, unnest(w) AS term FROM own WHERE len(w) > 0),
post AS (SELECT {comma}{key}, term, count(*) AS tf, any_value(dl) AS dl FROM flat GROUP BY ALL),
size AS (SELECT {comma}count(*) AS n, avg(len(w)) AS avgdl FROM own WHERE len(w) > 0 {f'GROUP BY {index}' if index else ''}),
met AS (SELECT * FROM post SEMI JOIN {asked} USING (term)),
dfs AS (SELECT {comma}term, count(*) AS df FROM met GROUP BY ALL),
part AS (SELECT m.*, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * dl / avgdl)) AS part
  FROM met m JOIN dfs USING ({comma}term) {f'JOIN size USING ({index})' if index else 'CROSS JOIN size'}),
scored AS (SELECT query_id, {comma}{key}, sum(part) AS score FROM part JOIN {asked} USING (term) GROUP BY ALL)"""


def top(source: str, k: int, by: str, order: str, name: str = "rank") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS {name} FROM {source}) WHERE {name} <= {k}"


def hits(k: int) -> str:
    return f"""WITH {CORPUS}, {ASKED}, {NAMES}, {bm25()},
best AS ({top('scored', k, 'query_id', 'round(score, 9) DESC, collection, document_id, seq')}),
hits AS (SELECT b.*, c.* EXCLUDE (collection, document_id, seq), coalesce(n.name, b.document_id) AS name FROM best b JOIN corpus c USING (collection, document_id, seq) LEFT JOIN names n ON n.document_id = b.document_id)"""


def ranges(k: int = 50, fold: str = "sum(score)", source: str = "hits") -> str:
    return f"""{hits(k)},
flagged AS (SELECT *, CASE WHEN seq = lag(seq) OVER w + 1 AND coalesce(lag(end_reason) OVER w, '') <> 'heading' THEN 0 ELSE 1 END AS new FROM {source}
  WINDOW w AS (PARTITION BY query_id, collection, document_id ORDER BY seq)),
isles AS (SELECT *, sum(new) OVER (PARTITION BY query_id, collection, document_id ORDER BY seq) AS isle FROM flagged),
ranges0 AS (SELECT query_id, collection, document_id, isle, any_value(name) AS name, min(seq) AS seq_start, max(seq) AS seq_end, min(char_start) AS char_start, max(char_end) AS char_end,
  min(line_start) AS line_start, max(line_end) AS line_end, min(page_start) AS page_start, max(page_end) AS page_end, arg_max(end_reason, seq) AS end_reason,
  count(*) AS hits, {fold} AS score, arg_max(seq, score * 1000000 - seq) AS best_seq FROM isles GROUP BY ALL),
ranges AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, name, seq_start, collection) AS rank FROM ranges0)"""


FOLDS = {"sum": "sum(score)", "max": "max(score)", "harmonic": "2 * max(score) * sum(score) / (max(score) + sum(score))"}
SHOW_RANGES = "SELECT query_id, rank, collection, document_id, name, seq_start, seq_end, char_start, char_end, hits, best_seq, round(score, 6) AS score FROM ranges"

VASKED = f"vq AS (SELECT id AS query_id, question, query_vector AS v FROM search_questions WHERE query_vector IS NOT NULL AND trim(question) <> ''), vasked AS (SELECT query_id, unnest({terms('question')}) AS term FROM vq)"
L2 = "list_sum(list_transform(list_zip({0}, {1}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"
HALVES = f"""WITH {CORPUS}, {VASKED}, ids AS (SELECT id, min(framed) AS framed FROM corpus GROUP BY id), {bm25(rows='ids', key='id', asked='vasked')},
lex AS ({top('scored', 50, 'query_id', 'round(score, 9) DESC, id')}),
vecs AS (SELECT id, max(vector::FLOAT[]) AS vector FROM corpus WHERE vector IS NOT NULL GROUP BY id),
dist AS (SELECT query_id, id, {L2.format('v', 'vector')} AS distance FROM vq CROSS JOIN vecs),
vec AS ({top('dist', 50, 'query_id', 'round(distance, 9), id')})"""

SHINGLES = f"""{hits(15)},
w AS (SELECT query_id, rank AS item, {words('text')} AS w FROM hits),
v AS (SELECT query_id, item, list_distinct(w) AS v FROM w),
vf AS (SELECT query_id, item, len(v) AS n, unnest(v) AS v FROM v),
both_have AS (SELECT x.query_id, x.item AS a, y.item AS b, any_value(x.n) AS va, any_value(y.n) AS vb, count(*) AS m FROM vf x JOIN vf y ON x.query_id = y.query_id AND x.v = y.v AND x.item < y.item GROUP BY 1, 2, 3),
s AS (SELECT query_id, item, list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) AS s FROM w),
f AS (SELECT query_id, item, len(s) AS n, unnest(s) AS s FROM s),
common AS (SELECT x.query_id, x.item AS a, y.item AS b, count(*) AS c FROM f x JOIN f y ON x.query_id = y.query_id AND x.s = y.s AND x.item < y.item GROUP BY 1, 2, 3),
overlap AS (SELECT query_id, a, b, CASE WHEN len(y.s) >= 5 THEN coalesce(c, 0) / len(y.s) ELSE 0 END AS "into", CASE WHEN len(x.s) >= 5 THEN coalesce(c, 0) / len(x.s) ELSE 0 END AS "over",
  CASE WHEN len(x.s) >= 5 AND len(y.s) >= 5 THEN m / (va + vb - m) ELSE 0 END AS alike
  FROM both_have o LEFT JOIN common USING (query_id, a, b) JOIN s x ON x.query_id = o.query_id AND x.item = o.a JOIN s y ON y.query_id = o.query_id AND y.item = o.b)"""
DECISIONS = f"""{SHINGLES}, h AS (SELECT query_id, rank AS item, collection, document_id, seq, char_start, char_end, score, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS g, len({words('text')}) AS n FROM hits),
pairs AS (SELECT o.*, x.document_id = y.document_id AND x.collection = y.collection AND abs(x.seq - y.seq) <= 1 AS touching, x.g = y.g AND x.n >= 7 AS exact,
  CASE WHEN x.document_id = y.document_id AND x.collection <> y.collection THEN
    CASE WHEN x.char_start <= y.char_start AND y.char_end <= x.char_end THEN -1 WHEN y.char_start <= x.char_start AND x.char_end <= y.char_end THEN 1 ELSE 0 END ELSE 0 END AS nested
  FROM overlap o JOIN h x ON x.query_id = o.query_id AND x.item = o.a JOIN h y ON y.query_id = o.query_id AND y.item = o.b),
kind AS (SELECT *, CASE WHEN touching THEN 0 WHEN exact THEN 1 WHEN nested < 0 THEN 2 WHEN nested > 0 THEN 3 WHEN "over" > 0.8 AND "into" <= 0.8 THEN 4 WHEN "into" > 0.8 AND "over" <= 0.8 THEN 5
  WHEN ("into" > 0.8 AND "over" > 0.8) OR alike > 0.5 THEN 6 ELSE 0 END AS k FROM pairs),
decided AS (SELECT query_id, a, b, CASE k WHEN 1 THEN 'duplicate' WHEN 6 THEN 'equivalent' ELSE 'contained' END AS relation, k IN (3, 4) AS swap,
  CASE WHEN k <= 3 THEN 1.0 WHEN k = 4 THEN "over" WHEN k = 5 THEN "into" ELSE greatest(least("into", "over"), alike) END AS similarity FROM kind WHERE k > 0)"""
# the fold, one result a step: lead holds the slots' leaders, under what has been folded
FOLD = f"""{DECISIONS.replace('WITH ', 'WITH RECURSIVE ', 1)},
d AS (SELECT query_id, b, list({{'a': a, 'relation': relation, 'swap': swap, 'similarity': similarity}}) AS met FROM decided GROUP BY 1, 2),
steps AS (SELECT h.query_id, item, score, coalesce(met, []) AS met FROM h LEFT JOIN d ON d.query_id = h.query_id AND d.b = h.item),
fold(query_id, item, lead, score, under) AS (
  SELECT query_id, 0::BIGINT, []::BIGINT[], []::DOUBLE[], []::STRUCT(item BIGINT, lead BIGINT, relation VARCHAR, similarity DOUBLE)[] FROM h GROUP BY query_id
  UNION ALL
  SELECT query_id, item,
    CASE WHEN mode = 'new' THEN list_append(lead, item) WHEN mode = 'swap' THEN list_filter(list_transform(lead, lambda l: CASE WHEN l = held[1].a THEN item ELSE l END), lambda l: l = item OR NOT list_contains(list_transform(held, lambda x: x.a), l)) ELSE lead END,
    CASE WHEN mode = 'new' THEN list_append(score, own) WHEN mode = 'swap' THEN list_transform(list_filter(list_zip(lead, score), lambda z: z[1] = held[1].a OR NOT list_contains(list_transform(held, lambda x: x.a), z[1])), lambda z: z[2]) ELSE score END,
    CASE WHEN mode = 'under' THEN list_append(under, {{'item': item, 'lead': best.a, 'relation': best.relation, 'similarity': best.similarity}})
      WHEN mode = 'swap' THEN under || list_transform(held, lambda x: {{'item': x.a, 'lead': item, 'relation': x.relation, 'similarity': x.similarity}}) ELSE under END
  FROM (SELECT *, CASE WHEN len(repeats) > 0 THEN 'under' WHEN len(held) > 0 THEN 'swap' WHEN len(lead) < 10 THEN 'new' ELSE 'none' END AS mode,
      list_filter(repeats, lambda x: x.similarity = list_max(list_transform(repeats, lambda y: y.similarity)))[1] AS best
    FROM (SELECT *, list_filter(held, lambda x: NOT x.swap) AS repeats
      FROM (SELECT f.query_id, s.item, s.score AS own, f.lead, f.score, f.under,
          list_transform(list_filter(list_transform(f.lead, lambda l: list_filter(s.met, lambda m: m.a = l)), lambda z: len(z) > 0), lambda z: z[1]) AS held
        FROM fold f JOIN steps s ON s.query_id = f.query_id AND s.item = f.item + 1)))),
last AS (SELECT DISTINCT ON (query_id) * FROM fold ORDER BY query_id, item DESC),
slots AS (SELECT query_id, unnest(lead) AS item, generate_subscripts(lead, 1) AS slot, unnest(score) AS score FROM last),
folded AS (SELECT query_id, unnest(under, recursive := true) FROM last),
root(query_id, item, lead, root) AS (SELECT query_id, item, lead, lead FROM folded UNION ALL SELECT r.query_id, r.item, r.lead, f.lead FROM root r JOIN folded f ON f.query_id = r.query_id AND f.item = r.root),
top AS (SELECT r.* FROM root r JOIN slots s ON s.query_id = r.query_id AND s.item = r.root)"""


def trend(table: str, series: str, unit: str, start: str, end: str, value: str = "1", ts: str = "ts") -> str:
    return f"""WITH c AS (SELECT date_trunc('{unit}', {ts}::TIMESTAMP) AS bucket, coalesce({series}, 'none') AS key, sum({value}) AS n FROM {table} WHERE {ts} >= TIMESTAMP '{start}' AND {ts} < TIMESTAMP '{end}' GROUP BY ALL),
t AS (SELECT key, sum(n) AS total FROM c GROUP BY 1),
r AS (SELECT key, row_number() OVER (ORDER BY total DESC, key) AS place, count(*) OVER () AS n_all FROM t),
m AS (SELECT key, CASE WHEN n_all > 6 AND place >= 6 THEN 'other' ELSE key END AS series, least(place, 6) AS rank FROM r),
f AS (SELECT bucket, series, rank, sum(n) AS n FROM c JOIN m USING (key) GROUP BY ALL),
cal AS (SELECT unnest(range(TIMESTAMP '{start}', TIMESTAMP '{end}', INTERVAL 1 {unit})) AS bucket),
g AS (SELECT bucket, series, rank, coalesce(n, 0) AS n FROM cal CROSS JOIN (SELECT DISTINCT series, rank FROM m) LEFT JOIN f USING (bucket, series, rank))
SELECT bucket, series, rank, n::BIGINT AS n, (sum(n) OVER (PARTITION BY bucket ORDER BY rank DESC))::BIGINT AS stacked FROM g"""


SIGNALS = """bars AS (SELECT * FROM (VALUES ('fern-64', 0.79, 0.885), ('fern-64q', 0.75, 0.86)) t(embedding, weak, answered)),
sig AS (SELECT q.id AS question_id, q.search_id, q.question, q.review, s.session_id, s.ts, s.collections,
  CASE WHEN s.error IS NOT NULL THEN NULL WHEN q.agent_verdict IS NOT NULL THEN 'reported'
    WHEN coalesce(s.scoped, 0) <> 0 THEN NULL WHEN s.result_count = 0 THEN 'empty' WHEN q.uncovered = 1 THEN 'uncovered'
    WHEN list_max(q.similarities)::DOUBLE < b.weak THEN 'weak' WHEN list_max(q.similarities)::DOUBLE < b.answered THEN 'borderline' END AS signal
  FROM search_questions q JOIN searches s ON s.id = q.search_id LEFT JOIN bars b USING (embedding)),
gaps AS (SELECT * FROM sig WHERE signal IS NOT NULL AND review IS NULL)"""
TOPICS = f"""topics AS (SELECT *, first_value(question_id) OVER (PARTITION BY list_sort(list_distinct({words('question')})) ORDER BY ts DESC, question_id DESC) AS topic_id FROM gaps)"""
STOPPED = ", ".join("'" + w.replace("'", "''") + "'" for w in FILLERS)


def class_terms(key: str, text: str = "text", source: str = "corpus") -> str:
    """CTEs up to n(key, term, tf)."""
    breaks, word = r"""[.,;:!?()\[\]{}<>"|=/\\–—“”]|\n\s*\n""", r"[\p{L}\p{N}_]"
    return f"""clauses AS (SELECT {key}, unnest(regexp_split_to_array(regexp_replace({text}, '({word})-[ \\t]*\\n[ \\t]*({word})', '\\1\\2', 'g'), '{breaks}')) AS clause FROM {source}),
w AS (SELECT {key}, list_transform(regexp_extract_all(clause, '{word}+(?:[''’]{word}+)*'), lambda x: replace(lower(x), '’', chr(39))) AS w FROM clauses),
marked AS (SELECT {key}, w, list_transform(w, lambda x: length(x) >= 3 AND NOT list_contains([{STOPPED}], x) AND regexp_matches(x, '\\p{{L}}')) AS ok FROM w),
t AS (SELECT {key}, unnest(list_filter(w, lambda x, i: ok[i]) || list_transform(list_filter(range(1, len(w)), lambda i: ok[i] AND ok[i + 1]), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM marked),
n AS (SELECT {key}, term, count(*) AS tf FROM t GROUP BY ALL)"""


CLASS_TERMS = class_terms("collection")
CANDIDATES = f"""WITH {CORPUS}, {CLASS_TERMS}, z AS (SELECT collection, sum(tf) AS size FROM n GROUP BY 1), c AS (SELECT count(*) AS classes FROM z), spread AS (SELECT term, count(*) AS m FROM n GROUP BY 1),
x AS (SELECT collection, term, tf, classes < 2 OR m <= 0.5 * classes AS fine, sqrt(tf / size) * ln(1 + (classes - m + 0.5) / (m + 0.5)) AS weight FROM n JOIN z USING (collection) JOIN spread USING (term) CROSS JOIN c),
y AS (SELECT *, fine AND tf >= 2 AS often, count(*) FILTER (fine AND tf >= 2 AND NOT contains(term, ' ')) OVER o AS few, bool_or(fine) OVER o AS any_ FROM x WINDOW o AS (PARTITION BY collection)),
kept AS (SELECT collection, term, tf, weight FROM y WHERE CASE WHEN NOT any_ THEN true WHEN few >= 6 THEN often ELSE fine END)"""
LABELLED = "l AS (SELECT embedding AS profile, round(list_max(similarities)::DOUBLE, 4) AS s, uncovered = 0 AS yes FROM search_questions q JOIN searches x ON x.id = q.search_id WHERE embedding IS NOT NULL AND list_max(similarities) IS NOT NULL)"
UNIT = "list_transform({0}, lambda x: x::DOUBLE / sqrt(list_sum(list_transform({0}, lambda y: y::DOUBLE * y::DOUBLE))))"


def mean(key: str) -> str:
    return f"""u AS (SELECT {key}, {UNIT.format('embedding')} AS v FROM embeddings),
p AS (SELECT {key}, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM u),
m AS (SELECT {key}, pos, avg(x) AS x, count(*) AS rows FROM p GROUP BY ALL)"""


RUNS = f"""WITH {CORPUS},
o AS (SELECT collection, document_id, seq, headings, char_start, char_end, row_number() OVER (PARTITION BY collection, document_id ORDER BY seq) AS nth FROM corpus),
e AS (SELECT *, unnest(range(0, len(headings) + 1)) AS depth FROM o),
p AS (SELECT *, headings[1 : depth] AS path FROM e),
f AS (SELECT *, CASE WHEN lag(path) OVER w = path AND lag(nth) OVER w = nth - 1 THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY collection, document_id, depth ORDER BY seq)),
i AS (SELECT *, sum(new) OVER (PARTITION BY collection, document_id, depth ORDER BY seq) AS isle FROM f),
g AS (SELECT collection, document_id, depth, isle, any_value(path) AS path, min(seq) AS seq_start, max(seq) AS seq_end, min(char_start) AS char_start, max(char_end) AS char_end FROM i GROUP BY ALL),
runs AS (SELECT *, row_number() OVER (PARTITION BY collection, document_id ORDER BY seq_start, depth) - 1 AS position FROM g)"""


VALUED = f"""{ranges(10)}, x AS (SELECT *, unnest([1, 2, 3]) AS steps FROM ranges),
d AS (SELECT query_id, collection, document_id, seq_start, 'before' AS side, steps, seq_start - steps AS seq FROM x WHERE seq_start - steps >= 1
UNION ALL SELECT query_id, collection, document_id, seq_start, 'after', steps, seq_end + steps FROM x WHERE coalesce(end_reason, '') <> 'heading'),
words_of AS (SELECT item_id AS query_id, {terms('question')} AS ts FROM eval_items WHERE question IS NOT NULL),
ref AS (SELECT query_id, CASE WHEN len(ts) > 0 THEN len(list_intersect(ts, {words('text')})) / len(ts) ELSE 0 END AS s FROM hits JOIN words_of USING (query_id)),
mid AS (SELECT query_id, median(s) AS m, max(s) AS t FROM ref GROUP BY 1),
near AS (SELECT d.*, CASE WHEN len(ts) > 0 THEN len(list_intersect(ts, {words('c.text')})) / len(ts) ELSE 0 END AS s, (coalesce(c.end_reason, '') <> 'heading')::INT AS goes
  FROM d JOIN corpus c USING (collection, document_id, seq) JOIN words_of USING (query_id)),
v AS (SELECT near.*, CASE WHEN t > m THEN greatest(-1, least(1, (s - m) / (t - m))) WHEN s >= m THEN 1.0 ELSE -1.0 END AS value FROM near JOIN mid USING (query_id))"""
PLACED = f"""{RUNS}, {ranges(50).split('WITH ', 1)[1].replace(CORPUS + ',', '', 1)},
ends AS (SELECT collection, document_id, min(seq_start) AS d_start, max(seq_end) AS d_end FROM runs GROUP BY 1, 2),
asked_at AS (SELECT r.query_id, r.rank, r.score, r.rank > 1 AND r.char_end - r.char_start < 300 AS alone, r.char_end - r.char_start AS chars, r.collection, r.document_id, s.position, s.depth, s.path,
  max(s.depth) OVER (PARTITION BY r.query_id, r.collection, r.document_id, r.seq_start) AS deepest, s.char_end - s.char_start <= 12000 AND s.depth > 0 AND NOT (s.seq_start = d_start AND s.seq_end = d_end) AS fits
  FROM ranges r JOIN runs s ON s.collection = r.collection AND s.document_id = r.document_id AND r.seq_start BETWEEN s.seq_start AND s.seq_end
  JOIN ends e ON e.collection = r.collection AND e.document_id = r.document_id),
placed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY CASE WHEN fits AND depth < deepest THEN 0 ELSE 1 END, CASE WHEN fits AND depth < deepest THEN depth ELSE -depth END) AS nth FROM asked_at) WHERE nth = 1),
grouped AS (SELECT query_id, collection, document_id, position, min(rank) AS best, max(score) AS score, count(*) AS ranges, count(*) FILTER (NOT alone) AS standing FROM placed GROUP BY ALL),
groups AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best, collection, document_id, position) AS rank FROM grouped WHERE standing > 0) WHERE rank <= 10)"""
BUDGET = f"""{PLACED.replace('WITH ', 'WITH RECURSIVE ', 1)},
held AS (SELECT p.query_id, g.rank AS g, p.rank AS r, 300 + chars AS cost, alone FROM placed p JOIN groups g USING (query_id, collection, document_id, position)),
bests AS (SELECT query_id, g, min(r) AS r FROM held WHERE NOT alone GROUP BY 1, 2),
turns AS (SELECT query_id, g, r, cost, 0 AS phase, r AS place, false AS always FROM held WHERE r = 20
  UNION ALL SELECT o.query_id, o.g, o.r, o.cost, 1, o.g, o.g = min(o.g) OVER (PARTITION BY o.query_id) FROM held o JOIN bests USING (query_id, g, r)
  UNION ALL SELECT query_id, g, r, cost, 2, r, false FROM held),
steps AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY phase, place) AS n FROM turns),
walk(query_id, n, spent, kept, opened) AS (
  SELECT DISTINCT query_id, 0::BIGINT, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM held
  UNION ALL
  SELECT w.query_id, s.n, CASE WHEN t THEN spent + c ELSE spent END, CASE WHEN t THEN list_append(kept, s.r) ELSE kept END, CASE WHEN t THEN list_append(opened, s.g) ELSE opened END
  FROM walk w JOIN steps s ON s.query_id = w.query_id AND s.n = w.n + 1,
    LATERAL (SELECT s.cost + CASE WHEN list_contains(opened, s.g) THEN 0 ELSE 600 END AS c) x,
    LATERAL (SELECT NOT list_contains(kept, s.r) AND (s.phase < 2 OR list_contains(opened, s.g)) AND (s.always OR spent + x.c <= 12000) AS t) y),
last AS (SELECT DISTINCT ON (query_id) * FROM walk ORDER BY query_id, n DESC)"""


INFO = f"""WITH {CORPUS}, m AS (SELECT DISTINCT collection, document_id, status FROM chunks JOIN documents USING (document_id)),
a AS (SELECT collection, count(DISTINCT document_id) AS documents, count(DISTINCT document_id) FILTER (status <> 'imported') AS pending FROM m GROUP BY 1),
b AS (SELECT collection, count(*) AS chunks, count(DISTINCT (document_id, part)) AS parts, count(vector) AS vectors FROM corpus GROUP BY 1),
info AS (SELECT collection, documents, pending, coalesce(chunks, 0) AS chunks, coalesce(parts, 0) AS parts, coalesce(vectors, 0) AS vectors FROM a LEFT JOIN b USING (collection))"""
WEAK = """WITH bars AS (SELECT * FROM (VALUES ('fern-64', 0.79), ('fern-64q', 0.75)) t(embedding, bar)),
w AS (SELECT q.id, q.search_id, coalesce(list_max(q.similarities)::DOUBLE < bar, false) AS weak FROM search_questions q JOIN searches s ON s.id = q.search_id LEFT JOIN bars USING (embedding))"""


def oracle_sql() -> dict[str, str]:
    full = "collection, document_id, seq"
    span = "document_id, char_start, char_end"
    per = f"WITH {CORPUS}, {ASKED}, {bm25(key='document_id, seq', index='collection')}"

    def spans(k: int) -> str:
        return f"""{per}, best AS ({top('scored', k, 'query_id, collection', 'round(score, 9) DESC, document_id, seq', 'r')}),
s AS (SELECT query_id, collection, document_id, seq, round(b.score, 6) AS score, char_start, char_end FROM best b JOIN corpus USING ({full})),
one AS (SELECT DISTINCT ON (query_id, {span}) * FROM s ORDER BY query_id, {span}, score DESC, collection)"""

    out = {
        "bm25_topk": f"WITH {CORPUS}, {ASKED}, {bm25()} SELECT query_id, {full}, round(score, 6) AS score, rank FROM ({top('scored', 25, 'query_id', f'round(score, 9) DESC, {full}')})",
        "bm25_per_collection": f"{per} SELECT query_id, {full}, round(score, 6) AS score, rank FROM ({top('scored', 5, 'query_id, collection', 'round(score, 9) DESC, document_id, seq')})",
        "postings_stats": f"WITH {CORPUS}, w AS (SELECT {full}, unnest({words('framed')}) AS term FROM corpus), p AS (SELECT {full}, term, count(*) AS tf FROM w GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS uses FROM p GROUP BY 1",
        "knn_l2_topk": f"WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 100 = 0), x AS (SELECT query_id, vec_id AS id, {L2.format('v', 'embedding')} AS distance FROM q CROSS JOIN embeddings) SELECT query_id, id, round(distance, 6) AS distance, rank, round(1 / (1 + distance), 6) AS score FROM ({top('x', 10, 'query_id', 'round(distance, 9), id')})",
        "rrf_hybrid": f"""{HALVES}, u AS (SELECT query_id, id, rank, 0 AS half FROM vec UNION ALL SELECT query_id, id, rank, 1 FROM lex),
f AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(half * 1000 + rank) AS first FROM u GROUP BY 1, 2)
SELECT query_id, id, round(score, 6) AS score, rank FROM ({top('f', 25, 'query_id', 'round(score, 12) DESC, first, id')})""",
        "linear_hybrid": f"""{HALVES}, v AS (SELECT query_id, id, rank, CASE WHEN max(distance) OVER w > min(distance) OVER w THEN (max(distance) OVER w - distance) / (max(distance) OVER w - min(distance) OVER w) ELSE 0 END AS v FROM vec WINDOW w AS (PARTITION BY query_id)),
b AS (SELECT query_id, id, rank, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS b FROM lex WINDOW w AS (PARTITION BY query_id)),
j AS (SELECT query_id, id, 0.7::DOUBLE * coalesce(v, 0) + (1 - 0.7::DOUBLE) * coalesce(b, 0) AS score, CASE WHEN v.rank IS NOT NULL THEN v.rank ELSE 1000 + b.rank END AS first FROM v FULL JOIN b USING (query_id, id))
SELECT query_id, id, round(score, 6) AS score, rank FROM ({top('j', 25, 'query_id', 'round(score, 12) DESC, first, id')})""",
        "ranked_halves_multi_collection": f"{spans(10)} SELECT query_id, rank, collection, {span}, score FROM ({top('one', 25, 'query_id', f'score DESC, {span}')})",
        "first_per_span": f"WITH {CORPUS} SELECT DISTINCT ON ({span}) {span}, collection, seq FROM corpus ORDER BY {span}, collection, seq",
        "global_text_page": f"{spans(60)} SELECT query_id, rank, collection, {span}, score FROM ({top('one', 30, 'query_id', f'score DESC, {span}, collection')}) WHERE rank > 10",
        "leaving_anti": f"WITH c0 AS (SELECT DISTINCT ON ({full}) * FROM chunks WHERE text IS NOT NULL), corpus AS (SELECT * FROM c0 WHERE document_id NOT IN (SELECT document_id FROM documents WHERE status <> 'imported' AND document_id IS NOT NULL)), {ASKED}, {bm25()} SELECT query_id, {full}, round(score, 6) AS score, rank FROM ({top('scored', 10, 'query_id', f'round(score, 9) DESC, {full}')})",
        "scoped_sections": f"WITH {CORPUS} SELECT c.collection, c.document_id, c.seq FROM corpus c JOIN corpus w ON w.collection = c.collection AND w.document_id = c.document_id AND w.seq = 2 WHERE list_has_any(c.section_ids, w.section_ids)",
        "citations": f"""WITH {CORPUS}, {NAMES} SELECT {full}, concat_ws(' ', coalesce(name, document_id),
'p.' || page_start || CASE WHEN page_end <> page_start THEN '-' || page_end ELSE '' END, 'L' || line_start || CASE WHEN line_end <> line_start THEN '-' || line_end ELSE '' END) AS citation, array_to_string(headings, ' > ') AS header FROM corpus LEFT JOIN names USING (document_id)""",
        "row_scores": "WITH c AS (SELECT DISTINCT * FROM candidates), r AS (SELECT *, 1 / (1 + exp(-rerank_score)) AS rel FROM c) SELECT search_id, document_id, seq, round(coalesce(rel, bm25_score, 1 / (1 + vector_distance), 0), 6) AS score, round(ln(rel) - ln(1 - rel), 4) AS back FROM r",
        "top_documents": f"{hits(50)}, o AS (SELECT query_id, document_id, seq, max(score) AS score, any_value(name) AS name FROM hits GROUP BY 1, 2, 3), b AS (SELECT query_id, document_id, any_value(name) AS name, sum(score) AS score, count(*) AS hits FROM o GROUP BY 1, 2) SELECT query_id, document_id, name, round(score, 6) AS score, hits, rank FROM ({top('b', 10, 'query_id', 'round(score, 9) DESC, name, document_id')})",
        "fragments": f"WITH {CORPUS} SELECT {full}, (char_end - char_start < 300 OR len({words('text')}) < 7) AND NOT coalesce(start_reason IN ('heading', 'document') AND end_reason IN ('heading', 'document'), FALSE) AS fragment FROM corpus",
        "neighbour_demand": f"""{ranges(10)}, x AS (SELECT *, unnest([1, 2, 3]) AS steps FROM ranges)
SELECT query_id, collection, document_id, seq_start, 'before' AS side, steps, seq_start - steps AS seq FROM x WHERE seq_start - steps >= 1
UNION ALL SELECT query_id, collection, document_id, seq_start, 'after', steps, seq_end + steps FROM x WHERE coalesce(end_reason, '') <> 'heading'""",
        "fill_value": "WITH c AS (SELECT DISTINCT * FROM candidates WHERE bm25_score IS NOT NULL), m AS (SELECT *, median(bm25_score) OVER w AS mid, max(bm25_score) OVER w AS best FROM c WINDOW w AS (PARTITION BY search_id)) SELECT search_id AS query_id, document_id, seq, round(bm25_score, 6) AS bm25_score, round(CASE WHEN best > mid THEN greatest(-1, least(1, (bm25_score - mid) / (best - mid))) WHEN bm25_score >= 1.0 THEN 1 ELSE -1 END, 6) AS value FROM m",
        "term_overlap": f"{hits(25)}, t AS (SELECT h.query_id, {full}, {terms('e.question')} AS t, {words('h.text')} AS w FROM hits h JOIN eval_items e ON e.item_id = h.query_id) SELECT query_id, {full}, round(CASE WHEN len(t) > 0 THEN len(list_intersect(t, w)) / len(t) ELSE 0 END, 6) AS overlap FROM t",
        "neighbour_values": f"{VALUED} SELECT query_id, collection, document_id, seq, seq_start, side, steps, round(value, 6) AS value FROM v",
        "best_run": f"""{VALUED},
o AS (SELECT *, min(goes) OVER w AS open, row_number() OVER w AS n, round(sum(value) OVER w, 9) AS total FROM v WINDOW w AS (PARTITION BY query_id, collection, document_id, seq_start, side ORDER BY steps)),
k AS (SELECT * FROM o WHERE open = 1 AND n = steps)
SELECT query_id, collection, document_id, seq_start, side, arg_max(steps, total * 1000 - steps) AS steps, round(max(total), 6) AS total FROM k GROUP BY 1, 2, 3, 4, 5 HAVING max(total) > 0""",
        "exact_duplicates": f"WITH o AS (SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS g FROM documents WHERE len({words('text')}) >= 7), k AS (SELECT g, min(doc_id) AS first, count(DISTINCT doc_id) AS copies FROM o GROUP BY 1 HAVING count(DISTINCT doc_id) > 1) SELECT DISTINCT doc_id, first, copies FROM o JOIN k USING (g)",
        "shingle_containment": f'{SHINGLES} SELECT query_id, a, b, round("into", 6) AS "into", round("over", 6) AS "over", round(alike, 6) AS alike FROM overlap',
        "fold_decisions": f"{DECISIONS} SELECT query_id, a, b, relation, swap, round(similarity, 6) AS similarity FROM decided",
        "leader_fold": f"""{FOLD} SELECT query_id, item, slot, NULL AS lead, NULL AS relation, NULL AS similarity, round(score, 6) AS score FROM slots
          UNION ALL SELECT query_id, item, NULL, lead, relation, round(similarity, 6), round(h.score, 6) FROM folded JOIN h USING (query_id, item)""",
        "fold_tree": f"""{FOLD} SELECT t.query_id, t.item, t.lead, t.root, CASE WHEN t.lead < t.item THEN coalesce(round(o."into", 6), 0) ELSE coalesce(round(o."over", 6), 0) END AS words,
          CASE WHEN x.document_id = y.document_id THEN round(greatest(0, least(x.char_end, y.char_end) - greatest(x.char_start, y.char_start)) / least(x.char_end - x.char_start, y.char_end - y.char_start), 6) END AS chars
          FROM top t JOIN h x ON x.query_id = t.query_id AND x.item = t.item JOIN h y ON y.query_id = t.query_id AND y.item = t.lead
          LEFT JOIN overlap o ON o.query_id = t.query_id AND o.a = least(t.item, t.lead) AND o.b = greatest(t.item, t.lead)""",
        "fold_places": f"{FOLD} SELECT s.query_id, s.slot, s.item, count(t.item) AS places FROM slots s LEFT JOIN top t ON t.query_id = s.query_id AND t.root = s.item GROUP BY ALL",
        "section_runs": f"{RUNS} SELECT collection, document_id, position, depth, array_to_string(path, ' > ') AS path, seq_start, seq_end, char_start, char_end FROM runs",
        "section_groups": f"{PLACED} SELECT query_id, collection, document_id, position, round(score, 6) AS score, ranges, standing, rank FROM groups",
        "documents_needed": f"""{ranges(50)}, r AS (SELECT *, rank > 1 AND char_end - char_start < 300 AS alone FROM ranges),
          o AS (SELECT *, CASE WHEN NOT alone AND row_number() OVER (PARTITION BY query_id, collection, document_id ORDER BY alone, rank) = 1 THEN 1 ELSE 0 END AS new FROM r),
          s AS (SELECT *, coalesce(sum(new) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM o)
          SELECT DISTINCT query_id, collection, document_id FROM s WHERE seen < 5""",
        "budget_within": f"{BUDGET} SELECT o.query_id, o.g AS group_rank, o.r AS rank, list_contains(l.kept, o.r) AS kept FROM held o JOIN last l USING (query_id)",
        "map_candidates": f"""{RUNS}, {hits(50).split('WITH ', 1)[1].replace(CORPUS + ',', '', 1)},
          ends AS (SELECT collection, document_id, min(seq_start) AS d_start, max(seq_end) AS d_end FROM runs GROUP BY 1, 2),
          asked_at AS (SELECT h.query_id, h.rank, h.score, h.document_id, s.depth, s.char_start, s.char_end, max(s.depth) OVER w AS deepest,
            s.char_end - s.char_start <= 12000 AND s.depth > 0 AND NOT (s.seq_start = d_start AND s.seq_end = d_end) AS fits
            FROM hits h JOIN runs s ON s.collection = h.collection AND s.document_id = h.document_id AND h.seq BETWEEN s.seq_start AND s.seq_end
            JOIN ends e ON e.collection = h.collection AND e.document_id = h.document_id WHERE h.vector IS NOT NULL WINDOW w AS (PARTITION BY h.query_id, h.rank)),
          placed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY CASE WHEN fits AND depth < deepest THEN 0 ELSE 1 END, CASE WHEN fits AND depth < deepest THEN depth ELSE -depth END) AS nth FROM asked_at) WHERE nth = 1)
          SELECT query_id, document_id, char_start AS s_char_start, char_end AS s_char_end, min(rank) AS first, count(*) AS chunks, round(sum(score), 6) AS score FROM placed GROUP BY ALL""",
        "validated_questions": """WITH q AS (SELECT search_id, list(question ORDER BY position, question) FILTER (question IS NOT NULL) AS qs FROM search_questions GROUP BY 1),
          t AS (SELECT search_id, list_filter(list_transform(coalesce(qs, []), lambda x: trim(x, ' ')), lambda x: length(x) > 0) AS ts FROM q),
          p AS (SELECT search_id, list_filter(ts, lambda x, i: list_position(ts, x) = i) AS parts FROM t),
          c AS (SELECT p.*, CASE WHEN length(trim(context, ' ')) > 0 THEN trim(context, ' ') END AS context FROM p JOIN searches s ON s.id = p.search_id)
          SELECT search_id AS request_id, array_to_string(parts, '|') AS parts, context, CASE WHEN len(parts) < 1 OR len(parts) > 5 THEN 'number of questions'
            WHEN list_max(list_transform(parts, lambda x: length(x))) > 500 THEN 'length of a question' WHEN length(context) > 200 THEN 'length of the context' END AS problem,
            CASE WHEN len(parts) <= 10 THEN ceil(10 / greatest(1, len(parts)))::INT END AS depth FROM c""",
        "key_lookup": f"WITH {CORPUS} SELECT {full} FROM corpus SEMI JOIN candidates USING ({full})",
        "hit_rows": f"WITH {CORPUS} SELECT {full}, coalesce(section_ids[-1], '') AS section_id, array_to_string(coalesce(headings, []), ' > ') AS header FROM corpus",
        "listed_with_collections": "SELECT d.document_id, d.name, coalesce((SELECT string_agg(DISTINCT collection, ',' ORDER BY collection) FROM chunks c WHERE c.document_id = d.document_id), '') AS collections FROM documents d",
        "batched_lookup": "SELECT DISTINCT document_id, source FROM documents SEMI JOIN chunks USING (document_id) WHERE status = 'imported'",
        "collection_info": f"{INFO} SELECT * FROM info",
        "pending_collections": f"{INFO} SELECT collection, pending FROM info WHERE pending > 0",
        "member_id_walk": "SELECT DISTINCT document_id FROM documents WHERE document_id > 'M' ORDER BY 1 LIMIT 50",
        "sorted_documents": "SELECT doc_id, name, pages FROM documents ORDER BY pages DESC NULLS LAST, name LIMIT 40 OFFSET 20",
        "indexed_caches": "SELECT DISTINCT document_id, md5(document_id) AS cache_id FROM documents SEMI JOIN chunks USING (document_id) WHERE status = 'imported'",
        "cache_lookup": "SELECT DISTINCT md5(document_id) AS cache_id FROM documents SEMI JOIN chunks USING (document_id) WHERE text IS NOT NULL",
        "members_added": """WITH m AS (SELECT DISTINCT collection, document_id, status FROM chunks JOIN documents USING (document_id)), f AS (SELECT document_id FROM documents WHERE status IN ('imported', 'queued'))
          SELECT collection, status, count(*) AS n FROM (SELECT * FROM m UNION ALL SELECT 'everything', document_id, 'queued' FROM f) GROUP BY 1, 2""",
        "loaded_models": "SELECT DISTINCT coalesce(s.reranker, u.reranker) AS reranker FROM search_settings s CROSS JOIN (SELECT max(reranker) AS reranker FROM search_settings WHERE collection IS NULL) u WHERE s.collection IS NOT NULL AND coalesce(s.reranker, u.reranker) <> 'none'",
        "operation_origins": "SELECT DISTINCT r.search_id AS id, s.session_id FROM search_results r LEFT JOIN searches s ON s.id = r.search_id",
        "events_added": """WITH s AS (SELECT 'u' || user_id AS session_id, min(ts::TIMESTAMP) AS t FROM events GROUP BY 1), n AS (SELECT session_id, min(ts::TIMESTAMP) AS t FROM searches WHERE session_id IS NOT NULL AND session_id NOT IN (SELECT session_id FROM s) GROUP BY 1)
          SELECT strftime(t, '%Y-%m-%d') AS day, count(*) AS n FROM (SELECT * FROM s UNION ALL SELECT * FROM n) GROUP BY 1""",
        "stale_runs": "SELECT id, CASE WHEN error IS NULL THEN 'PENDING' ELSE 'ERROR' END AS status, reranker AS version FROM searches WHERE error IS NULL AND reranker IS DISTINCT FROM 'none' ORDER BY ts, id LIMIT 50",
        "weak_questions": f"{WEAK} SELECT id, search_id, weak FROM w",
        "uncovered_questions": f"{WEAK}, o AS (SELECT w.search_id, q.question, min(q.position) AS position FROM w JOIN search_questions q USING (id) WHERE trim(q.question) <> '' AND (w.weak OR q.uncovered = 1) GROUP BY 1, 2) SELECT search_id, string_agg(question, '|' ORDER BY position, question) AS uncovered FROM o GROUP BY 1",
        "describe_order": f"{RUNS} SELECT collection, document_id, position, row_number() OVER (PARTITION BY collection, document_id ORDER BY depth DESC, position) AS turn FROM runs",
        "ann_due": f"WITH {CORPUS}, t AS (SELECT collection, count(vector) AS trained FROM corpus WHERE part = 0 GROUP BY 1), n AS (SELECT collection, count(vector) AS vectors FROM corpus GROUP BY 1) SELECT collection, vectors, vectors >= 256 AND (trained IS NULL OR vectors >= 2 * trained) AS due FROM n LEFT JOIN t USING (collection)",
        "kept_children": "WITH r AS (SELECT DISTINCT search_id FROM search_results WHERE document IS NULL OR document NOT IN (SELECT name FROM documents WHERE status <> 'imported' AND name IS NOT NULL)) SELECT search_id, count(*) AS n FROM search_questions SEMI JOIN r USING (search_id) GROUP BY 1",
        "shortened_vectors": "WITH s AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: x::DOUBLE) AS v FROM embeddings) SELECT vec_id, len(v) AS dims, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS first FROM s",
        "parts_deleted": f"WITH {CORPUS} SELECT collection, count(*) AS n FROM corpus WHERE document_id <> (SELECT min(document_id) FROM corpus) OR part < 0 GROUP BY 1",
        "reranked": f"""{hits(50)}, q AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(question), '\\s+'), lambda x: x <> '')) AS ws FROM eval_items),
          s AS (SELECT h.query_id, {full.replace('collection', 'h.collection', 1)}, CASE WHEN len(ws) > 0 THEN len(list_intersect(ws, list_distinct(list_filter(regexp_split_to_array(lower(framed), '\\s+'), lambda x: x <> '')))) / len(ws) ELSE 0 END AS score FROM hits h JOIN q USING (query_id)),
          r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {full}) AS rank FROM s WHERE score >= 0.05)
          SELECT query_id, {full}, round(score, 6) AS score, rank FROM r WHERE rank <= 25""",
        "min_cover": f"""{hits(50).replace('WITH ', 'WITH RECURSIVE ', 1)},
          once AS (SELECT query_id, document_id, seq, max(score) AS score, any_value(name) AS name FROM hits GROUP BY 1, 2, 3), docs AS (SELECT query_id, document_id, any_value(name) AS name, sum(score) AS score FROM once GROUP BY 1, 2),
          topd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, name, document_id) AS place FROM docs) WHERE place <= 10),
          held AS (SELECT DISTINCT t.query_id, c.collection, t.document_id FROM topd t JOIN chunks c USING (document_id) WHERE c.collection IS NOT NULL),
          sets AS (SELECT query_id, collection, list(document_id) AS ds FROM held GROUP BY 1, 2), every AS (SELECT query_id, list_distinct(list(document_id)) AS ds FROM held GROUP BY 1),
          walk(query_id, step, collection, documents, rest) AS (
            SELECT query_id, 0, NULL::VARCHAR, 0::BIGINT, ds FROM every
            UNION ALL
            SELECT query_id, step, collection, n, rest FROM (
              SELECT w.query_id, w.step + 1 AS step, s.collection, len(list_intersect(s.ds, w.rest))::BIGINT AS n, list_filter(w.rest, lambda x: NOT list_contains(s.ds, x)) AS rest,
                row_number() OVER (PARTITION BY w.query_id ORDER BY len(list_intersect(s.ds, w.rest)) DESC, s.collection) AS pick
              FROM walk w JOIN sets s ON s.query_id = w.query_id WHERE len(w.rest) > 0) WHERE pick = 1)
          SELECT query_id, step, collection, documents FROM walk WHERE step > 0""",
        "rejoined_ranges": """WITH p AS (SELECT DISTINCT ON (search_id, position) search_id AS query_id, collection, document AS document_id, seq_start, seq_end, score < 0.1 AS alone, header, score, position FROM search_results WHERE parent IS NULL ORDER BY search_id, position),
          o AS (SELECT *, max(seq_end) OVER (PARTITION BY query_id, collection, document_id ORDER BY seq_start, seq_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p WHERE header IS NOT NULL),
          f AS (SELECT *, CASE WHEN seq_start <= before + 1 THEN 0 ELSE 1 END AS new FROM o),
          i AS (SELECT *, sum(new) OVER (PARTITION BY query_id, collection, document_id ORDER BY seq_start, seq_end) AS isle FROM f)
          SELECT query_id, collection, document_id, min(seq_start) AS seq_start, max(seq_end) AS seq_end, bool_and(alone) AS alone, false AS owed, count(DISTINCT header) AS n_aspects, round(max(score), 6) AS best FROM i GROUP BY query_id, collection, document_id, isle""",
        "section_parents": f"{RUNS} SELECT r.collection, r.document_id, r.position, r.depth, p.position AS parent FROM runs r LEFT JOIN runs p ON p.collection = r.collection AND p.document_id = r.document_id AND p.depth = r.depth - 1 AND p.seq_start <= r.seq_start AND p.seq_end >= r.seq_end",
        "missing_terms": f"{hits(10)}, a AS (SELECT item_id AS query_id, unnest({terms('question')}) AS term FROM eval_items), h AS (SELECT DISTINCT query_id, unnest({words('text')}) AS term FROM hits) SELECT query_id, term FROM a ANTI JOIN h USING (query_id, term)",
        "corpus_centre": f"WITH e AS (SELECT 1 AS g, * FROM embeddings), {mean('g').replace('FROM embeddings', 'FROM e')} SELECT pos AS at_, round(x, 6) AS x, rows FROM m".replace('at_', '"at"'),
        "document_vectors": f"WITH {mean('label')} SELECT label, rows, pos AS at_, round(x, 6) AS x FROM m".replace('at_', '"at"'),
        "nearest_documents": f"WITH {mean('label')}, v AS (SELECT label, list(x ORDER BY pos) AS v FROM m GROUP BY 1), near AS (SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.v, b.v), 4) AS cosine FROM v a JOIN v b ON a.label <> b.label) {top('near', 5, 'a', 'cosine DESC, b')}",
        "load_log": "SELECT s.id, s.ts AT TIME ZONE 'UTC' AS ts, s.tool, q.id AS question_id, q.position, q.question FROM searches s LEFT JOIN search_questions q ON q.search_id = s.id WHERE s.ts >= TIMESTAMP '2026-03-01'",
        "top_results_per_search": f"WITH o AS (SELECT DISTINCT ON (search_id, position) * FROM search_results WHERE parent IS NULL) SELECT search_id, n, position, document, round(score, 6) AS score FROM ({top('o', 3, 'search_id', 'position', 'n')})",
        "search_history": "WITH b AS (SELECT search_id, document, min(position) AS pos FROM search_results GROUP BY 1, 2), l AS (SELECT search_id, string_agg(document, ',' ORDER BY pos, document) AS documents FROM b GROUP BY 1) SELECT id, coalesce(documents, '') AS documents FROM searches LEFT JOIN l ON search_id = id",
        "search_tally": "SELECT session_id, count(*) AS searches, max(ts) AT TIME ZONE 'UTC' AS last_at FROM searches WHERE session_id IS NOT NULL GROUP BY 1",
        "recent_questions": "SELECT trim(question) AS question, max(ts) AT TIME ZONE 'UTC' AS last_at FROM search_questions q JOIN searches s ON s.id = q.search_id WHERE trim(question) <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
        "searches_since": "SELECT id, ts AT TIME ZONE 'UTC' AS ts, duration_ms FROM searches WHERE ts >= TIMESTAMP '2026-05-01'",
        "retention_prune": "SELECT search_id, count(*) AS questions FROM search_questions WHERE search_id IN (SELECT id FROM searches WHERE ts >= TIMESTAMP '2026-07-18' - INTERVAL 90 DAY) GROUP BY 1",
        "session_summaries": "WITH s AS (SELECT session_id, count(*) AS searches, max(ts)::TIMESTAMP AS l FROM searches WHERE session_id IS NOT NULL GROUP BY 1), e AS (SELECT 'u' || user_id AS session_id, count(*) AS events, max(ts)::TIMESTAMP AS m FROM events GROUP BY 1) SELECT session_id, coalesce(searches, 0) AS searches, coalesce(events, 0) AS events, greatest(l, m) AS last_at FROM s FULL JOIN e USING (session_id)",
        "session_history": "SELECT * FROM (SELECT ts::TIMESTAMP AS ts, 'search' AS kind, tool AS what, id FROM searches WHERE session_id = 'u1' UNION ALL SELECT ts::TIMESTAMP, 'event', event_type, event_id FROM events WHERE user_id = 1) ORDER BY ts DESC, kind, id LIMIT 100",
        "session_selections": "WITH f AS (SELECT session_id, unnest(collections) AS c, generate_subscripts(collections, 1) - 1 AS p FROM searches WHERE session_id IS NOT NULL), g AS (SELECT session_id, c, min(p) AS p FROM f GROUP BY 1, 2), l AS (SELECT session_id, string_agg(c, ',' ORDER BY p, c) AS collections FROM g GROUP BY 1) SELECT session_id, coalesce(collections, '') AS collections FROM (SELECT DISTINCT session_id FROM searches WHERE session_id IS NOT NULL) LEFT JOIN l USING (session_id)",
        "similarities_top": "WITH f AS (SELECT id AS question_id, unnest(similarities) AS c FROM search_questions), r AS (SELECT question_id, round(c::DOUBLE, 4) AS c, row_number() OVER (PARTITION BY question_id ORDER BY round(c::DOUBLE, 4) DESC) AS n FROM f) SELECT question_id, string_agg(printf('%.4f', c), ',' ORDER BY c DESC) AS similarities FROM r WHERE n <= 20 GROUP BY 1",
        "trend_daily_top6_other": trend("events", "event_type || '-' || (user_id % 2)", "day", "2024-01-01", "2024-01-31"),
        "trend_hourly": trend("events", "event_type", "hour", "2024-01-10", "2024-01-11"),
        "trend_searches": trend("searches", "tool", "day", "2026-01-01", "2026-08-01", "coalesce(result_count, 0)"),
        "gap_signals": f"WITH {SIGNALS} SELECT question_id, signal FROM sig",
        "gap_topics_words": f"WITH {SIGNALS}, {TOPICS} SELECT question_id, topic_id FROM topics",
        "gap_topic_summaries": f"WITH {SIGNALS}, {TOPICS}, c AS (SELECT DISTINCT topic_id, unnest(collections) AS c FROM topics), l AS (SELECT topic_id, string_agg(c, ',' ORDER BY c) AS collections FROM c GROUP BY 1) SELECT topic_id, count(*) AS questions, count(DISTINCT session_id) AS sessions, min(ts) AT TIME ZONE 'UTC' AS first_at, max(ts) AT TIME ZONE 'UTC' AS last_at, coalesce(any_value(l.collections), '') AS collections FROM topics LEFT JOIN l USING (topic_id) GROUP BY topic_id",
        "gap_near_misses": f"WITH {SIGNALS}, o AS (SELECT DISTINCT ON (search_id, position) * FROM search_results WHERE parent IS NULL AND search_id IN (SELECT search_id FROM gaps)) SELECT search_id, n, document, round(score, 6) AS score FROM ({top('o', 3, 'search_id', 'position', 'n')})",
        "gap_reviews": "SELECT CASE WHEN agent_verdict = 'partial' THEN 'dismissed' ELSE review END AS review, count(*) AS n FROM search_questions GROUP BY 1",
        "report_window_asof": "WITH o AS (SELECT q.id, session_id, trim(question) AS question, ts, error FROM search_questions q JOIN searches s ON s.id = q.search_id), a AS (SELECT id AS report_id, session_id, question, ts + INTERVAL 30 MINUTE AS ts FROM o WHERE session_id IS NOT NULL AND question <> '') SELECT report_id, question_id FROM (SELECT a.report_id, o.id AS question_id, row_number() OVER (PARTITION BY report_id ORDER BY o.ts DESC, o.id DESC) AS n FROM a JOIN o ON o.session_id = a.session_id AND o.question = a.question AND o.error IS NULL AND o.ts <= a.ts AND o.ts >= a.ts - INTERVAL 3600 SECOND) WHERE n = 1",
        "beta_fit": "WITH r AS (SELECT reranker, unnest(rerank_scores)::DOUBLE AS s FROM searches x JOIN search_questions q ON q.search_id = x.id WHERE reranker IS NOT NULL), m AS (SELECT reranker, avg(s) AS m, var_pop(s) AS v, count(*) AS n FROM r GROUP BY 1) SELECT reranker, round(m, 6) AS floor, round(CASE WHEN n >= 2 AND v > 0 AND m > 0 AND m < 1 AND m * (1 - m) / v > 1 THEN m * (m * (1 - m) / v - 1) ELSE 1 END, 6) AS beta_a, round(CASE WHEN n >= 2 AND v > 0 AND m > 0 AND m < 1 AND m * (1 - m) / v > 1 THEN (1 - m) * (m * (1 - m) / v - 1) ELSE 1 END, 6) AS beta_b FROM m",
        "gap_bars": f"WITH {LABELLED}, e AS (SELECT profile, count(*) FILTER (yes) AS y, count(*) FILTER (NOT yes) AS n, floor(round(min(s) FILTER (yes) * 1000, 6)) / 1000 AS low, ceil(round(max(s) FILTER (NOT yes) * 1000, 6)) / 1000 AS top FROM l GROUP BY 1), i AS (SELECT e.*, (SELECT count(*) FROM l WHERE l.profile = e.profile AND yes AND s >= low AND s < top) AS inside FROM e WHERE y >= 10 AND n >= 10) SELECT profile, low AS weak_match, CASE WHEN inside <= 0.15 * y AND top > low THEN top END AS answered_match FROM i",
        "auroc": f"WITH {LABELLED} SELECT a.profile, round(avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END), 6) AS auroc FROM l a JOIN l b ON a.profile = b.profile AND a.yes AND NOT b.yes GROUP BY 1",
        "qpp_features": "WITH s AS (SELECT id, list_reverse_sort(similarities::DOUBLE[]) AS s FROM search_questions WHERE similarities IS NOT NULL) SELECT id, round(s[1], 5) AS best, round(s[1] - s[2], 5) AS lead, round(list_stddev_pop(s[1:10]), 5) AS spread, round(list_avg(s[1:5]), 5) AS mean_five FROM s",
        "sample_candidates": f"WITH c AS (SELECT DISTINCT * FROM candidates WHERE rerank_score IS NOT NULL) SELECT search_id AS query_id, document_id, seq, rank FROM ({top('c', 200, 'search_id', 'rerank_score DESC, document_id, seq')}) WHERE rank - 1 BETWEEN 10 AND 29",
        "members_keyset_page": "SELECT size, name, status FROM documents WHERE size IS NOT NULL AND (size > 2000 OR (size = 2000 AND name > 'm')) ORDER BY size, name LIMIT 51",
        "member_counts": "SELECT lower(trim(source)) AS source, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("imported", "failed", "queued", "deleting")) + ", count(*) AS total FROM documents GROUP BY 1",
        "leaving_union": "SELECT document_id FROM documents WHERE pages_unread > 0 UNION SELECT document_id FROM documents WHERE status <> 'imported'",
        "searchable_exists": "SELECT collection FROM search_settings s WHERE collection IS NOT NULL AND EXISTS (SELECT 1 FROM chunks c WHERE c.collection = s.collection AND c.document_id NOT IN (SELECT document_id FROM documents WHERE status <> 'imported'))",
        "settings_resolved": "SELECT c.collection, " + ", ".join(f"coalesce(c.{f}, u.{f}) AS {f}" for f in ("mode", "fusion", "rrf_k", "vector_weight", "bm25_weight", "nprobes", "refine_factor", "reranker", "min_rerank_score")) + " FROM search_settings c CROSS JOIN (SELECT * FROM search_settings WHERE collection IS NULL) u WHERE c.collection IS NOT NULL",
        "insert_or_ignore": "WITH t AS (SELECT c_custkey, c_nationkey FROM customer), n AS (SELECT DISTINCT unnest([o_custkey, -o_custkey]) AS c_custkey, -1 AS c_nationkey FROM orders), u AS (SELECT * FROM t UNION ALL SELECT * FROM n ANTI JOIN t USING (c_custkey)) SELECT c_nationkey, count(*) AS n FROM u GROUP BY 1",
        "upsert": "SELECT CASE WHEN p_retailprice > 1500 THEN 0 ELSE p_size END AS p_size, count(*) AS n FROM part GROUP BY 1",
        "membership_transitions": "SELECT CASE WHEN status IN ('queued', 'failed') AND coalesce(pages_unread, 0) = 0 THEN 'cancelled' ELSE status END AS status, count(*) AS n FROM documents GROUP BY 1",
        "newest_entries": "SELECT DISTINCT ON (lang) doc_id, lang, updated_at AT TIME ZONE 'UTC' AS updated_at FROM documents ORDER BY lang, documents.updated_at DESC, doc_id",
        "largest_remainder_caps": "WITH w AS (SELECT lower(trim(source)) AS stage, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1), e AS (SELECT stage, 100.0::DOUBLE * n / sum(n) OVER () AS x FROM w), b AS (SELECT stage, x, floor(x) AS f, 100 - sum(floor(x)) OVER () AS rest FROM e) SELECT stage, (f + CASE WHEN row_number() OVER (ORDER BY round(x - f, 9) DESC, stage) <= rest THEN 1 ELSE 0 END)::BIGINT AS cap FROM b",
        "ntile_slices": "SELECT c_nationkey, c_custkey, ntile(3) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS slice FROM customer",
        "folded_operations": "WITH r AS (SELECT DISTINCT ON (search_id, position) search_id, position, parent, collection AS name, CASE WHEN score > 0.5 THEN 'SUCCESS' ELSE 'ERROR' END AS status FROM search_results) SELECT a.search_id || '-' || a.position AS id, a.name, a.status, count(b.search_id) AS jobs, count(*) FILTER (b.status = 'SUCCESS') AS jobs_done FROM r a LEFT JOIN r b ON b.search_id = a.search_id AND b.parent = a.position WHERE a.parent IS NULL GROUP BY ALL",
        "step_counts": "SELECT user_id AS workflow_id, count(*) AS steps FROM events WHERE event_type = 'click' GROUP BY 1",
        "cache_keys": "SELECT doc_id, sha256('document:' || document_id || ';chunk_size:1200;frame:true') AS cache_id FROM documents",
        "chunk_ids": "SELECT DISTINCT document_id, seq, id FROM chunks",
        "identical_documents": "SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first FROM documents WHERE status <> 'deleting' AND text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
        "page_counts": r"SELECT doc_id AS id, coalesce(len(regexp_extract_all(text, '<!--\s*page\s+\d+[^>]*-->')), 0)::INT AS pages, coalesce(len(regexp_extract_all(text, '<!--\s*page\s+\d+: read by OCR\s*-->')), 0)::INT AS read_by_ocr, coalesce(len(regexp_extract_all(text, '<!--\s*page\s+\d+: needs OCR, skipped\s*-->')), 0)::INT AS unread FROM documents",
        "line_ranges": r"SELECT doc_id, coalesce(array_to_string(string_split(text, chr(10))[3:6], chr(10)), '') AS lines FROM documents WHERE text IS NOT NULL",
        "text_slices": f"WITH {CORPUS} SELECT {full}, md5(substring(d.text, char_start + 1, char_end - char_start)) AS digest FROM corpus c JOIN documents d USING (document_id)",
        "ctfidf_terms": f"""WITH {CORPUS}, {CLASS_TERMS}, z AS (SELECT collection, sum(tf) AS size FROM n GROUP BY 1), k AS (SELECT count(*) AS classes FROM z), s AS (SELECT term, count(*) AS n FROM n GROUP BY 1),
x AS (SELECT n.collection, n.term, n.tf, round(sqrt(tf / size) * ln(1 + (classes - s.n + 0.5) / (s.n + 0.5)), 6) AS weight FROM n JOIN s USING (term) JOIN z USING (collection) CROSS JOIN k WHERE classes < 2 OR s.n <= 0.5 * classes)
SELECT collection, term, tf, weight, rank FROM ({top('x', 20, 'collection', 'weight DESC, term')})""",
        "widespread_terms": f"WITH {CORPUS}, {CLASS_TERMS} SELECT term, count(*) AS classes FROM n GROUP BY 1 HAVING count(*) > 0.5 * (SELECT count(DISTINCT collection) FROM n)",
        "term_candidates": f"{CANDIDATES} SELECT collection, count(*) AS terms, round(sum(weight), 4) AS weight FROM kept GROUP BY 1",
        "picked_descriptors": f"""{CANDIDATES}, l AS (SELECT collection, list([term] ORDER BY round(weight, 12) DESC, term) AS ts FROM kept GROUP BY 1)
          SELECT collection, array_to_string(list_reduce(ts, lambda acc, x: CASE WHEN len(acc) >= 6 OR len(list_filter(acc, lambda y: list_has_all(split(y, ' '), split(x[1], ' ')) OR list_has_all(split(x[1], ' '), split(y, ' ')))) > 0 THEN acc ELSE list_append(acc, x[1]) END), '|') AS descriptors FROM l""",
        "section_terms": f"""{RUNS}, {class_terms('collection, document_id, seq')},
          st AS (SELECT r.collection, r.document_id, r.depth, r.position, n.term, sum(n.tf) AS tf FROM n JOIN runs r ON r.collection = n.collection AND r.document_id = n.document_id AND n.seq BETWEEN r.seq_start AND r.seq_end GROUP BY ALL),
          z AS (SELECT collection, document_id, depth, position, sum(tf) AS size FROM st GROUP BY ALL), c AS (SELECT collection, document_id, depth, count(*) AS classes FROM z GROUP BY ALL),
          m AS (SELECT collection, document_id, depth, term, count(*) AS m FROM st GROUP BY ALL),
          x AS (SELECT st.*, sqrt(tf / size) * ln(1 + (classes - m + 0.5) / (m + 0.5)) AS weight FROM st JOIN z USING (collection, document_id, depth, position) JOIN c USING (collection, document_id, depth) JOIN m USING (collection, document_id, depth, term) WHERE classes < 2 OR m <= 0.5 * classes)
          SELECT collection, document_id, position, count(*) AS terms, round(sum(weight), 4) AS weight FROM x GROUP BY ALL""",
        "chunk_prose": f"""WITH {CORPUS} SELECT collection, document_id, seq, md5(CASE WHEN len(layout) > 0 THEN array_to_string(list_transform(layout, lambda x, i: CASE WHEN x.type IN ('code', 'table') THEN chr(10) || chr(10)
          ELSE substring(text, x.position + 1, coalesce(layout[i + 1].position, length(text)) - x.position) END), '') ELSE text END) AS digest FROM corpus""",
        "section_vectors": f"""{RUNS}, units AS (SELECT r.collection, r.document_id, r.position, {UNIT.format('vector')} AS v FROM corpus c JOIN runs r ON r.collection = c.collection AND r.document_id = c.document_id AND c.seq BETWEEN r.seq_start AND r.seq_end WHERE vector IS NOT NULL),
          fine AS (SELECT collection, document_id, position, list_transform(v, lambda x: CASE WHEN isnan(x) THEN 0 ELSE x END) AS v FROM units), flat AS (SELECT collection, document_id, position, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM fine),
          means AS (SELECT collection, document_id, position, pos, avg(x) AS x, count(*) AS rows FROM flat GROUP BY ALL)
          SELECT collection, document_id, position, any_value(rows) AS rows, round(max(x) FILTER (pos = 1), 5) AS first, round(sqrt(sum(x * x)), 5) AS norm FROM means GROUP BY ALL""",
        "vocabulary_variants": f"WITH {CORPUS}, h AS (SELECT unnest(headings) AS p FROM corpus), n AS (SELECT p, count(*) AS n FROM h WHERE trim(p) <> '' GROUP BY 1), v AS (SELECT lower(trim(regexp_replace(p, '\\s+', ' ', 'g'))) AS variant, p, n FROM n) SELECT variant, sum(n) AS uses, first(p ORDER BY n DESC, p) AS shown FROM v GROUP BY 1",
        "missing_vectors": f"WITH {CORPUS}, h AS (SELECT unnest(headings) AS p FROM corpus), v AS (SELECT lower(trim(regexp_replace(p, '\\s+', ' ', 'g'))) AS variant, count(*) AS uses FROM h WHERE trim(p) <> '' GROUP BY 1) SELECT variant, uses FROM v WHERE variant NOT IN (SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) FROM headings WHERE level = 1 AND text IS NOT NULL)",
        "compact_descriptors": f"WITH {CORPUS}, h AS (SELECT collection || '/' || document_id || '/' || seq AS key, unnest(headings) AS h, generate_subscripts(headings, 1) AS pos FROM corpus WHERE len(headings) > 0), v AS (SELECT key, split_part(lower(trim(regexp_replace(h, '\\s+', ' ', 'g'))), ' ', 1) AS t, min(pos) AS pos FROM h GROUP BY 1, 2) SELECT key, string_agg(t, '|' ORDER BY pos) AS descriptors FROM v GROUP BY 1",
        "embedding_overlap": f"""WITH {CORPUS},
          vecs AS (SELECT id, any_value(document_id) AS d, max(vector::FLOAT[]) AS v FROM corpus WHERE vector IS NOT NULL GROUP BY id), unit AS (SELECT id, d, {UNIT.format('v')} AS v FROM vecs WHERE list_max(list_transform(v, lambda x: abs(x))) > 0),
          p AS (SELECT a.id AS a, b.id AS b, a.d AS da, b.d AS db, list_dot_product(a.v, b.v) AS cosine FROM unit a JOIN unit b ON a.id <> b.id),
          r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(cosine, 9) DESC, b) AS n FROM p WHERE cosine >= 0.93),
          pairs AS (SELECT DISTINCT least(da, db) AS a, greatest(da, db) AS b FROM r WHERE n <= 32 AND da <> db),
          c AS (SELECT document_id AS d, seq, max(vector::FLOAT[]) AS v FROM corpus WHERE vector IS NOT NULL GROUP BY 1, 2),
          cu AS (SELECT d, seq, CASE WHEN list_max(list_transform(v, lambda x: abs(x))) > 0 THEN {UNIT.format('v')} ELSE list_transform(v, lambda x: 0::DOUBLE) END AS v FROM c),
          x AS (SELECT p.a, p.b, m.seq AS sa, n.seq AS sb, list_dot_product(m.v, n.v) AS cos FROM pairs p JOIN cu m ON m.d = p.a JOIN cu n ON n.d = p.b),
          bi AS (SELECT a, b, avg(m) AS "into" FROM (SELECT a, b, sb, max(cos) AS m FROM x GROUP BY ALL) GROUP BY ALL), ov AS (SELECT a, b, avg(m) AS "over" FROM (SELECT a, b, sa, max(cos) AS m FROM x GROUP BY ALL) GROUP BY ALL),
          wi AS (SELECT m.d, sum(list_dot_product(m.v, n.v)) AS w FROM cu m JOIN cu n ON m.d = n.d GROUP BY 1), al AS (SELECT a, b, sum(cos) AS s FROM x GROUP BY ALL)
          SELECT a, b, round("into", 5) AS "into", round("over", 5) AS "over", round(CASE WHEN k.w * l.w > 0 THEN s / sqrt(k.w * l.w) ELSE 0 END, 5) AS alike FROM bi JOIN ov USING (a, b) JOIN al USING (a, b) JOIN wi k ON k.d = a JOIN wi l ON l.d = b""",
        "vocabulary_pairs": f"WITH c AS (SELECT id, max(vector::FLOAT[]) AS v FROM chunks WHERE vector IS NOT NULL AND text IS NOT NULL GROUP BY id HAVING list_max(list_transform(max(vector::FLOAT[]), lambda x: abs(x))) > 0), u AS (SELECT id, {UNIT.format('v')} AS v FROM c), p AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.v, b.v) AS cosine FROM u a JOIN u b ON a.id <> b.id), r AS (SELECT a, b, cosine, row_number() OVER (PARTITION BY a ORDER BY round(cosine, 9) DESC, b) AS n FROM p WHERE cosine >= 0.93) SELECT least(a, b) AS a, greatest(a, b) AS b, round(max(cosine), 5) AS cosine FROM r WHERE n <= 32 GROUP BY 1, 2",
        "flagship": f"{ranges(25, source='f0').replace('flagged AS', f'f0 AS (SELECT DISTINCT ON (query_id, {span}) * FROM hits ORDER BY query_id, {span}, rank), flagged AS')} SELECT query_id, rank, collection, document_id, seq_start, seq_end, concat_ws(' ', name, 'p.' || page_start || CASE WHEN page_end <> page_start THEN '-' || page_end ELSE '' END, 'L' || line_start || CASE WHEN line_end <> line_start THEN '-' || line_end ELSE '' END) AS citation, hits, round(score, 6) AS score FROM ranges WHERE rank <= 10",
    }
    out |= {
        "probe_gaps": f"""{hits(10)}, a AS (SELECT item_id AS query_id, unnest({terms('question')}) AS term FROM eval_items), h AS (SELECT DISTINCT query_id, unnest({words('text')}) AS term FROM hits), miss AS (SELECT query_id, term FROM a ANTI JOIN h USING (query_id, term)),
{bm25(asked='miss').replace('own AS', 'own2 AS').replace('FROM own ', 'FROM own2 ').replace('flat', 'flat2').replace('post', 'post2').replace('size', 'size2').replace('met', 'met2').replace('dfs', 'dfs2').replace('part AS (', 'part2 AS (').replace('FROM part JOIN', 'FROM part2 JOIN').replace('scored', 'scored2')},
n AS (SELECT query_id, count(*) AS n FROM hits GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, {full}) AS nth FROM scored2),
k AS (SELECT r.* FROM r LEFT JOIN n USING (query_id) ANTI JOIN hits USING (query_id, collection, document_id, seq) WHERE nth <= 20 + coalesce(n, 0))
SELECT query_id, {full}, round(score, 6) AS score FROM ({top('k', 1, 'query_id', f'round(score, 9) DESC, {full}', 'b')})""",
        "aspects_tagged": f"{hits(10)}, r AS (SELECT query_id // 3 AS request_id, query_id % 3 AS part, {full}, max(score) AS score FROM hits GROUP BY ALL) SELECT request_id, {full}, string_agg(part::VARCHAR, ',' ORDER BY part) AS aspects, round(max(score), 6) AS best FROM r GROUP BY request_id, {full}",
        "framed_questions": "SELECT q.id, md5(CASE WHEN length(trim(context)) > 0 THEN trim(context) || chr(10) || chr(10) || question ELSE question END) AS digest FROM search_questions q JOIN searches s ON s.id = q.search_id",
        "unknown_references": "SELECT DISTINCT collection FROM chunks WHERE collection IS NOT NULL AND collection NOT IN (SELECT collection FROM search_settings WHERE collection IS NOT NULL)",
        "first_members": f"WITH m AS (SELECT DISTINCT c.collection, c.document_id, d.name FROM chunks c JOIN documents d USING (document_id) WHERE d.status = 'imported') SELECT collection, n, name FROM ({top('m', 5, 'collection', 'name, document_id', 'n')})",
        "describe_if_empty": "WITH h AS (SELECT doc_id, min(text) AS t FROM headings WHERE level = 1 AND text IS NOT NULL GROUP BY 1) SELECT doc_id, CASE WHEN coalesce(trim(description), '') = '' THEN coalesce(t, description) ELSE description END AS description FROM documents LEFT JOIN h USING (doc_id)",
        "backfill_sizes": "SELECT doc_id, coalesce(n_chars, length(text)) AS n_chars FROM documents",
        "plan_batches": f"WITH {CORPUS} SELECT {full}, ((row_number() OVER (PARTITION BY collection ORDER BY document_id, seq) - 1) // 32)::INT AS batch FROM corpus",
        "evenly_spaced": f"""WITH {CORPUS}, r AS (SELECT {full}, char_end - char_start AS chars, sum(char_end - char_start) OVER w AS al, count(*) OVER w AS n, row_number() OVER (PARTITION BY collection, document_id ORDER BY seq) - 1 AS nth FROM corpus WINDOW w AS (PARTITION BY collection, document_id))
SELECT {full}, chars, CASE WHEN al <= 2000 THEN chars ELSE least(chars, 666) END AS share FROM r WHERE al <= 2000 OR nth IN (0, floor((n - 1) / 2 + 0.5)::INT, n - 1)""",
        "subsections": f"{RUNS} SELECT a.collection, a.document_id, a.position, b.position AS sub FROM runs a JOIN runs b ON a.collection = b.collection AND a.document_id = b.document_id AND b.depth > a.depth AND b.seq_start >= a.seq_start AND b.seq_end <= a.seq_end AND b.path[1 : a.depth] = a.path",
        "topic_pairs_joined": "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.label = b.label AS same, count(*) AS pairs, count(*) FILTER (list_cosine_similarity(a.v, b.v) > 0.1) AS joined FROM v a JOIN v b ON a.vec_id < b.vec_id GROUP BY 1",
        "chunk_trend": "WITH r AS (SELECT DISTINCT ON (search_id, position) * FROM search_results), b AS (SELECT search_id AS id, sum(seq_end - seq_start + 1)::BIGINT AS n FROM r GROUP BY 1) SELECT id, coalesce(n, 0) AS outputs FROM searches LEFT JOIN b USING (id) WHERE error IS NULL",
        "active_runs": "SELECT o_orderpriority AS name, count(*) AS running, sum(greatest(0, o_orderkey % 10 - o_custkey % 10))::BIGINT AS \"left\" FROM orders WHERE o_orderstatus = 'O' GROUP BY 1",
        "model_cache_names": "SELECT DISTINCT embedding, embedding || '@64:' || substring(sha256('query: ;'), 1, 12) AS cache_name FROM searches WHERE embedding IS NOT NULL",
    }
    out["streaming_trend"] = "SELECT date_trunc('day', ts::TIMESTAMP) AS bucket, event_type AS series, count(*) AS n FROM events GROUP BY 1, 2"
    out["streaming_sessions"] = """WITH g AS (SELECT user_id, ts::TIMESTAMP AS ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS isle FROM g)
SELECT user_id, min(ts) AS first_at, max(ts) + INTERVAL 6 HOUR AS last_at, count(*) AS n FROM i GROUP BY user_id, isle"""
    for name, fold in FOLDS.items():
        out[f"passage_ranges_{name}"] = f"{ranges(50, fold)} {SHOW_RANGES}"
    return out
