"""SQL that states the results of the registered queries independently, over the same tables."""

from __future__ import annotations

from leafline.functions.text import FALLBACK_THEME, TOPIC_KEYWORDS
from leafline.operators.suite import CATEGORY_WEIGHTS
from leafline.schemas import CATEGORIES, DIFFICULTIES

WS = r"[ \t\r\n\f]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> '')"


def latest(name: str, table: str, key: str, time: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {time} DESC NULLS LAST) AS rn FROM {table} WHERE {key} IS NOT NULL) WHERE rn = 1)"


def label(c: str, known: list[str]) -> str:
    plain = f"regexp_replace(lower({strip(c)}), '[ _-]+', '_', 'g')"
    return f"CASE WHEN {plain} IN ({', '.join(repr(k) for k in known)}) THEN {plain} ELSE 'other' END"


CHUNKS = f"""{latest('c0', 'chunks', 'id', 'ingested_at')},
lc AS (SELECT id, document_id, content, coalesce(pos, 9223372036854775807) AS pos, len({words('content')}) AS tokens FROM c0 WHERE len({words("coalesce(content, '')")}) > 0)"""
DOCS = f"""{latest('d0', 'corpus_documents', 'id', 'ingested_at')},
ld AS (SELECT id, source, content FROM d0 WHERE len({words("coalesce(content, '')")}) > 0)"""
QUERIES = f"""{latest('q0', 'queries', 'id', 'created_at')},
lq AS (SELECT id AS query_id, suite_id, text, {label('category', CATEGORIES)} AS category, {label('difficulty', DIFFICULTIES)} AS difficulty, budget_feasible_400 AS feasible,
  list_filter(list_reverse(list_sort(list_distinct(gold_chunk_ids))), lambda g: g IS NOT NULL) AS gold, gold_chunk_ids FROM q0),
aq AS (SELECT * FROM lq WHERE TRY_CAST(regexp_extract(query_id, '([0-9]+)$', 1) AS BIGINT) % 50 = 0),
gold AS (SELECT DISTINCT query_id, g AS chunk_id FROM (SELECT query_id, unnest(gold_chunk_ids) AS g FROM aq) WHERE g IS NOT NULL)"""

BM25 = f"""
toks AS (SELECT id, pos, unnest({words('lower(content)')}) AS term FROM lc),
tf AS (SELECT id, pos, term, count(*) AS tf FROM toks GROUP BY ALL),
dl AS (SELECT id, sum(tf) AS dl FROM tf GROUP BY id),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM dfs, st),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({words('lower(text)')}) AS term FROM aq) GROUP BY ALL),
sc AS (SELECT query_id, tf.id AS chunk_id, round(sum(times * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score
  FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN dl ON dl.id = tf.id, st GROUP BY query_id, tf.id),
bm AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos, chunk_id) AS INT) AS rank FROM (
  SELECT aq.query_id, lc.id AS chunk_id, lc.pos, coalesce(score, 0.0) AS score FROM aq CROSS JOIN lc LEFT JOIN sc ON sc.query_id = aq.query_id AND sc.chunk_id = lc.id))"""


def buckets(name: str, source: str, key: str, text: str) -> str:
    return f"""{name} AS (SELECT {key}, b, CAST(sum(s) AS DOUBLE) AS value FROM (
  SELECT {key}, CAST(h % 64 AS INT) AS b, CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END AS s FROM (
    SELECT {key}, CAST('0x' || left(md5(w), 8) AS BIGINT) AS h FROM (SELECT {key}, unnest({words(f'lower({text})')}) AS w FROM {source}))) GROUP BY ALL HAVING sum(s) <> 0)"""


VECTORS = f"""
{buckets('hq', 'aq', 'query_id', 'text')},
{buckets('hc', 'lc', 'id', 'content')},
nq AS (SELECT query_id, sqrt(sum(value * value)) AS n FROM hq GROUP BY 1),
nc AS (SELECT id, sqrt(sum(value * value)) AS n FROM hc GROUP BY 1),
vs AS (SELECT query_id, id AS chunk_id, sum(hq.value * hc.value) AS s FROM hq JOIN hc USING (b) GROUP BY ALL),
vr AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos, chunk_id) AS INT) AS rank FROM (
  SELECT nq.query_id, nc.id AS chunk_id, lc.pos, round(coalesce(s, 0) / (nq.n * nc.n), 6) AS score FROM nq CROSS JOIN nc JOIN lc ON lc.id = nc.id LEFT JOIN vs ON vs.query_id = nq.query_id AND vs.chunk_id = nc.id))"""


def rrf(name: str, k: int) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r1 NULLS LAST, r2 NULLS LAST) AS INT) AS rank FROM (
  SELECT query_id, chunk_id, min(r1) AS r1, min(r2) AS r2, round(coalesce(1.0 / (min(r1) + 60), 0) + coalesce(1.0 / (min(r2) + 60), 0), 9) AS score FROM (
    SELECT query_id, chunk_id, CAST(rank AS DOUBLE) AS r1, CAST(NULL AS DOUBLE) AS r2 FROM bm WHERE rank <= {3 * k}
    UNION ALL SELECT query_id, chunk_id, NULL, CAST(rank AS DOUBLE) FROM vr WHERE rank <= {3 * k}) GROUP BY ALL)) WHERE rank <= {k})"""


RERANK = f"""{rrf('pool', 50)},
qd AS (SELECT DISTINCT query_id, term, idf FROM qt JOIN idf USING (term)),
qm AS (SELECT query_id, sum(idf) AS mass FROM qd GROUP BY 1),
ph AS (SELECT p.query_id, p.chunk_id, sum(qd.idf) AS hit FROM pool p JOIN tf ON tf.id = p.chunk_id JOIN qd ON qd.query_id = p.query_id AND qd.term = tf.term GROUP BY 1, 2),
ce AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS INT) AS rank FROM (
  SELECT p.query_id, p.chunk_id, p.rank AS before, round(CASE WHEN mass > 0 THEN coalesce(hit, 0) / mass ELSE 0 END, 6) AS score
  FROM pool p LEFT JOIN qm USING (query_id) LEFT JOIN ph ON ph.query_id = p.query_id AND ph.chunk_id = p.chunk_id))"""

TEXTS = f"{CHUNKS},\n{QUERIES},\n{BM25}"
FLAT = f"{TEXTS},\n{VECTORS}"
SYSTEM = {"bm25": (TEXTS, "bm"), "rrf": (f"{FLAT},\n{rrf('rr', 50)}", "rr"), "flat_ce": (f"{FLAT},\n{RERANK}", "ce")}


def per_query(name: str, ranking: str, most: int = 50) -> str:
    return f"""{name} AS (
  SELECT g.query_id, g.n AS relevant, round(coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 1 + least(g.n, 10)) t(i)), 6) AS ndcg, round(coalesce(hits, 0) / g.n, 6) AS recall,
    round(CASE WHEN shown > 0 THEN hits / shown ELSE 0 END, 6) AS precision, round(coalesce(1 / first, 0), 6) AS mrr, CAST(coalesce(first, 0) AS INT) AS first_rank
  FROM (SELECT query_id, count(*) AS n FROM gold GROUP BY 1) g LEFT JOIN (
    SELECT r.query_id, sum(CASE WHEN gold.chunk_id IS NOT NULL AND rank <= 10 THEN 1 / log2(rank + 1) END) AS dcg, count(*) FILTER (gold.chunk_id IS NOT NULL AND rank <= 10) AS hits,
      count(*) FILTER (rank <= 10) AS shown, min(CASE WHEN gold.chunk_id IS NOT NULL THEN rank END) AS first
    FROM {ranking} r LEFT JOIN gold ON gold.query_id = r.query_id AND gold.chunk_id = r.chunk_id WHERE rank <= {most} GROUP BY 1) s ON s.query_id = g.query_id)"""


def means(source: str, system: str) -> str:
    return f"""SELECT '{system}' AS system, count(*) AS queries, round(coalesce(avg(ndcg), 0), 5) AS ndcg_at_10, round(coalesce(avg(recall), 0), 5) AS recall_at_10,
  round(coalesce(avg(precision), 0), 5) AS precision_at_10, round(coalesce(avg(mrr), 0), 5) AS mrr FROM {source}"""


ALL = f"""{FLAT},
{rrf('rr', 50)},
{RERANK},
{per_query('m1', 'bm')},
{per_query('m2', 'rr')},
{per_query('m3', 'ce')},
ms AS (SELECT 'bm25' AS system, * FROM m1 UNION ALL SELECT 'rrf', * FROM m2 UNION ALL SELECT 'flat_ce', * FROM m3)"""


def grouped(column: str) -> str:
    return f"""gr AS (SELECT system, {column}, count(*) AS queries, round(avg(ndcg), 5) AS ndcg, round(avg(recall), 5) AS recall, round(avg(mrr), 5) AS mrr,
  round(avg(CASE WHEN recall >= 1 THEN 1.0 ELSE 0.0 END), 5) AS perfect_recall_rate FROM ms JOIN aq USING (query_id) GROUP BY 1, 2)"""


def pivoted(column: str, value: str) -> str:
    cols = ", ".join(f"max(CASE WHEN system = '{s}' THEN {value} END) AS {s}" for s in ("bm25", "rrf", "flat_ce"))
    return f"SELECT {column}, {cols} FROM gr GROUP BY 1"


def packed(budget: str) -> str:
    return f"""list_reduce(items, lambda a, x: CASE WHEN a.used + x.tokens <= {budget} THEN {{'used': a.used + x.tokens, 'ids': list_append(a.ids, x.chunk_id)}} ELSE a END,
  {{'used': CAST(0 AS BIGINT), 'ids': CAST([] AS VARCHAR[])}})"""


ITEMS = "it AS (SELECT query_id, list({'chunk_id': chunk_id, 'tokens': tokens} ORDER BY rank) AS items FROM bm JOIN lc ON lc.id = bm.chunk_id WHERE rank <= 50 GROUP BY 1)"

TREE = """
v AS (SELECT vec_id, CAST(vec_id AS VARCHAR) AS chunk_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
q AS (SELECT 'q' || vec_id AS query_id, vec_id, label, e FROM v WHERE vec_id % 50 = 0),
dims AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
n1 AS (SELECT 'r.' || label AS node_id, label, list(x ORDER BY i) AS e FROM (SELECT label, i, avg(x) AS x FROM dims GROUP BY 1, 2) GROUP BY label),
n0 AS (SELECT 'r' AS node_id, list(x ORDER BY i) AS e FROM (SELECT i, avg(x) AS x FROM dims GROUP BY 1)),
n2 AS (SELECT 'r.' || label || '.' || vec_id AS node_id, label, vec_id, chunk_id, e FROM v),
gold AS (SELECT q.query_id, v.vec_id, v.chunk_id, v.label FROM q JOIN v ON q.label = v.label AND q.vec_id <> v.vec_id),
b1 AS (SELECT query_id, node_id, label, s, r, round(0.5 * s + 0.5, 9) AS path FROM (
  SELECT query_id, node_id, n1.label, round(list_cosine_similarity(q.e, n1.e), 9) AS s, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q.e, n1.e), 9) DESC, n1.label) AS r
  FROM q, n1) WHERE r <= 3),
c2 AS (SELECT query_id, label, node_id, chunk_id, round(0.5 * s + 0.5 * path, 9) AS path, above * 1000 + r AS pos FROM (
  SELECT b1.query_id, b1.label, n2.node_id, n2.chunk_id, b1.path, b1.r AS above, round(list_cosine_similarity(q.e, n2.e), 9) AS s,
    row_number() OVER (PARTITION BY b1.query_id, b1.label ORDER BY round(list_cosine_similarity(q.e, n2.e), 9) DESC, n2.vec_id) AS r
  FROM b1 JOIN q USING (query_id) JOIN n2 ON n2.label = b1.label) WHERE r <= 3),
k2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY path DESC, pos) AS srt,
  round(path - CASE WHEN row_number() OVER (PARTITION BY query_id, label ORDER BY path DESC, pos) = 1 THEN 0 ELSE 0.3 END, 9) AS key FROM c2),
b2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY key DESC, srt) AS r FROM k2) WHERE r <= 5),
trace AS (SELECT query_id, 0 AS level, 1 AS beam_pos, 'r' AS node_id, 1.0 AS path_score FROM q
  UNION ALL SELECT query_id, 1, r, node_id, path FROM b1 UNION ALL SELECT query_id, 2, r, node_id, path FROM b2),
br AS (SELECT node_id, e FROM n0 UNION ALL SELECT node_id, e FROM n1),
ct AS (SELECT * FROM (SELECT query_id, br.node_id, round(list_cosine_similarity(q.e, br.e), 9) AS s,
  row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q.e, br.e), 9) DESC, br.node_id) AS place FROM q, br) WHERE place <= 10),
below AS (SELECT 'r' AS node_id, node_id AS leaf_id, chunk_id FROM n2 UNION ALL SELECT 'r.' || label, node_id, chunk_id FROM n2),
co AS (SELECT query_id, leaf_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY first, leaf_id) AS place FROM (
  SELECT query_id, leaf_id, chunk_id, min(place) AS first, arg_min(s, place) AS score FROM ct JOIN below USING (node_id) GROUP BY 1, 2, 3)),
anc AS (SELECT node_id, 'r' AS ancestor_id, 0 AS ancestor_level FROM n2 UNION ALL SELECT node_id, 'r.' || label, 1 FROM n2 UNION ALL SELECT node_id, node_id, 2 FROM n2
  UNION ALL SELECT node_id, 'r', 0 FROM n1 UNION ALL SELECT node_id, node_id, 1 FROM n1 UNION ALL SELECT 'r', 'r', 0),
eps AS (SELECT level, count(*) AS queries_evaluated, sum(ok) AS correct_branch_in_beam, round(1 - sum(ok) / count(*), 6) AS epsilon FROM (
  SELECT t.query_id, t.level, max(CASE WHEN t.level = 0 THEN 1 WHEN t.level = 1 AND t.node_id = 'r.' || q.label THEN 1 WHEN t.level = 2 AND g.chunk_id IS NOT NULL THEN 1 ELSE 0 END) AS ok
  FROM trace t JOIN q USING (query_id) LEFT JOIN gold g ON g.query_id = t.query_id AND t.node_id = 'r.' || g.label || '.' || g.vec_id
  WHERE t.query_id IN (SELECT query_id FROM gold) GROUP BY 1, 2) GROUP BY 1),
one AS (SELECT query_id, label, min(vec_id) AS vec_id FROM gold GROUP BY 1, 2),
t1 AS (SELECT query_id, 1 AS level, n1.label = one.label AS me, n1.node_id, round(list_cosine_similarity(q.e, n1.e), 9) AS s, n1.label AS o FROM q JOIN one USING (query_id), n1),
t2 AS (SELECT query_id, 2 AS level, n2.vec_id = one.vec_id AS me, n2.node_id, round(list_cosine_similarity(q.e, n2.e), 9) AS s, n2.vec_id AS o FROM q JOIN one USING (query_id) JOIN n2 ON n2.label = one.label),
rt AS (SELECT query_id, level, node_id, round(s, 6) AS cosine, CAST(place AS INT) AS place, siblings, place <= 1 AS hit_top1, place <= 3 AS hit_top3 FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, level ORDER BY s DESC, o) AS place, count(*) OVER (PARTITION BY query_id, level) AS siblings FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2)) WHERE me)"""

SEGMENT = rf"list_filter(list_transform(regexp_extract_all(text, '{WS}*[^ \t\r\n\f][^.!?]*(?:[.!?]|\z)'), lambda s: {strip('s')}), lambda s: s <> '')"
PARAGRAPHS = f"list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: {strip('p')}), lambda p: p <> '')"
HEAD = words("substr(text, 1, 500)")
FIRST = lambda n, k: f"array_to_string(list_transform(range(1, 1 + least({k}, len(u{n}))), lambda i: u{n}[i]), '|')"
ORDERED = "list_filter({0}, lambda w, i: list_position({0}, w) = i)"
SUMMARIES = latest("n", "nodes", "node_id", "built_at")


def _quota() -> str:
    names = list(CATEGORY_WEIGHTS)
    parts = [f"greatest(1, CAST(floor(round(n * {w}, 9)) AS BIGINT))" for w in list(CATEGORY_WEIGHTS.values())[:-1]]
    rows = [f"SELECT suite_id, '{c}' AS category, {p} AS quota FROM s" for c, p in zip(names, parts)]
    rows.append(f"SELECT suite_id, '{names[-1]}' AS category, greatest(1, n - ({' + '.join(parts)})) AS quota FROM s")
    return f"WITH {QUERIES}, s AS (SELECT suite_id, count(*) AS n FROM lq GROUP BY 1) " + " UNION ALL ".join(rows)


def _split(rest: str) -> str:
    return f"""WITH {QUERIES}, k AS (SELECT query_id, row_number() OVER (ORDER BY md5('42|' || query_id), query_id) - 1 AS n, count(*) OVER () AS t FROM lq),
p AS (SELECT query_id, CASE WHEN n < floor(t * 0.6) THEN 'train' WHEN n < floor(t * 0.6) + floor(t * 0.2) THEN 'dev' ELSE 'test' END AS part FROM k) {rest}"""


_LINKS = f"""
{latest('latest', 'nodes', 'node_id', 'built_at')},
links AS (
  SELECT DISTINCT p, c FROM (
    SELECT unnest(parent_ids) AS p, node_id AS c FROM latest UNION ALL SELECT node_id AS p, unnest(child_ids) AS c FROM latest)
  WHERE p IN (SELECT node_id FROM latest) AND c IN (SELECT node_id FROM latest)),
reach AS (SELECT p, c FROM links UNION SELECT r.p, l.c FROM reach r JOIN links l ON r.c = l.p),
walk AS (
  SELECT node_id, 0 AS depth FROM latest WHERE node_id NOT IN (SELECT c FROM links)
  UNION SELECT l.c AS node_id, w.depth + 1 AS depth FROM walk w JOIN links l ON w.node_id = l.p WHERE w.depth < 200),
depths AS (SELECT node_id, min(depth) AS depth FROM walk GROUP BY node_id)
"""
_HOPS = "hops AS (SELECT p, c, 1 AS n FROM links UNION SELECT h.p, l.c, h.n + 1 FROM hops h JOIN links l ON h.c = l.p WHERE h.n < 150)"
_FOREST = """
loops AS (SELECT p AS node_id FROM reach WHERE p = c),
forest AS (SELECT l.node_id, min(CASE WHEN d.depth IS NOT NULL THEN CASE WHEN u.depth + 1 = d.depth THEN k.p END WHEN l.node_id NOT IN (SELECT node_id FROM loops) THEN k.p END) AS up
  FROM latest l LEFT JOIN links k ON k.c = l.node_id LEFT JOIN depths d ON d.node_id = l.node_id LEFT JOIN depths u ON u.node_id = k.p GROUP BY 1),
over AS (SELECT node_id, node_id AS a FROM forest UNION ALL SELECT o.node_id, f.up FROM over o JOIN forest f ON f.node_id = o.a WHERE f.up IS NOT NULL),
sizes AS (SELECT a AS node_id, count(*) AS size FROM over GROUP BY 1),
heavy AS (SELECT node_id FROM (SELECT f.node_id, row_number() OVER (PARTITION BY f.up ORDER BY size DESC, f.node_id) AS r FROM forest f JOIN sizes USING (node_id) WHERE up IS NOT NULL) WHERE r = 1),
chains AS (SELECT node_id, node_id AS chain, CAST(0 AS BIGINT) AS pos FROM forest WHERE node_id NOT IN (SELECT node_id FROM heavy)
  UNION ALL SELECT f.node_id, chain, pos + 1 FROM chains JOIN forest f ON f.up = chains.node_id WHERE f.node_id IN (SELECT node_id FROM heavy)),
trails AS (SELECT node_id, node_id AS root, node_id AS path FROM forest WHERE up IS NULL UNION ALL SELECT f.node_id, root, path || '|' || f.node_id FROM trails t JOIN forest f ON f.up = t.node_id),
below AS (SELECT p AS node_id, count(*) AS n FROM reach GROUP BY 1)
"""

def _n(x: str) -> str:
    return f"len({words(x)})"


_JOINED = "array_to_string(list_filter(list_transform({0}, lambda g: " + strip("g") + "), lambda g: g <> ''), ' ')"
_FLUSHED = f"CASE WHEN len(a.open) > 0 THEN list_append(a.out, {_JOINED.format('a.open')}) ELSE a.out END"
_TAIL = f"list_filter(a.open, lambda g, i: list_sum(list_transform(a.open[i:], lambda y: {_n('y')})) <= 50)"
_WINDOWS = f"list_transform(range(0, {_n('x')}, 462), lambda w: array_to_string(({words('x')})[w + 1:w + 512], ' '))"
_GREEDY = f"""WITH {DOCS}, s AS (SELECT id AS document_id, {strip('content')} AS text FROM ld), p AS (SELECT document_id, text, {PARAGRAPHS} AS p, {SEGMENT} AS g FROM s WHERE text <> ''),
r AS (SELECT document_id, text, CASE WHEN len(p) > 1 THEN p WHEN len(g) > 0 THEN g ELSE [text] END AS parts FROM p),
f AS (SELECT document_id, text, list_reduce(parts, lambda a, x: CASE WHEN {_n('x')} > 512 THEN {{'out': list_concat({_FLUSHED}, {_WINDOWS}), 'open': CAST([] AS VARCHAR[]), 'n': CAST(0 AS BIGINT)}}
  WHEN a.n + {_n('x')} > 512 THEN {{'out': {_FLUSHED}, 'open': list_append({_TAIL}, x), 'n': CAST(coalesce(list_sum(list_transform({_TAIL}, lambda y: {_n('y')})), 0) + {_n('x')} AS BIGINT)}}
  ELSE {{'out': a.out, 'open': list_append(a.open, x), 'n': CAST(a.n + {_n('x')} AS BIGINT)}} END, {{'out': CAST([] AS VARCHAR[]), 'open': CAST([] AS VARCHAR[]), 'n': CAST(0 AS BIGINT)}}) AS a FROM r),
c AS (SELECT document_id, CASE WHEN {_n('text')} <= 512 THEN [text] ELSE list_filter({_FLUSHED}, lambda y: y <> '') END AS c FROM f),
u AS (SELECT document_id, CAST(generate_subscripts(c, 1) - 1 AS INT) AS chunk_no, unnest(c) AS content FROM c)
SELECT document_id || '-' || chunk_no AS chunk_id, document_id, chunk_no, content, CAST({_n('content')} AS INT) AS token_count FROM u"""


def _violations() -> str:
    kinds = {
        "chunk": ("chunks", "id", "ingested_at", {"blank content": "coalesce(trim(content), '') = ''", "token_count not positive": "coalesce(token_count, 0) <= 0"}),
        "query": ("queries", "id", "created_at", {
            "unknown category": f"NOT coalesce(category IN ({', '.join(map(repr, CATEGORIES))}), false)", "unknown difficulty": f"NOT coalesce(difficulty IN ({', '.join(map(repr, DIFFICULTIES))}), false)",
            "no gold chunk": "coalesce(len(gold_chunk_ids), 0) = 0"}),
        "node": ("nodes", "node_id", "built_at", {
            "negative level": "coalesce(level, -1) < 0", "leaf without chunk": "is_leaf AND chunk_id IS NULL", "internal without children": "NOT is_leaf AND coalesce(len(child_ids), 0) = 0",
            "blank theme": "summary IS NOT NULL AND coalesce(trim(summary.theme), '') = ''"}),
    }
    tables = ", ".join(latest(f"l_{k}", table, key, time) for k, (table, key, time, _) in kinds.items())
    rows = [f"SELECT '{k}' AS entity, '{rule}' AS rule, count(*) AS rows FROM l_{k} WHERE {cond} HAVING count(*) > 0" for k, (*_, rules) in kinds.items() for rule, cond in rules.items()]
    return f"WITH {tables} " + " UNION ALL ".join(rows)


SQL: dict[str, str] = {
    "p4_found": f"""WITH RECURSIVE {_LINKS}
SELECT 'cycle' AS issue, p AS node_id FROM reach WHERE p = c
UNION ALL SELECT 'level' AS issue, node_id FROM depths JOIN latest USING (node_id) WHERE level IS NOT NULL AND level <> depth""",
    "p4_descendants": f"""WITH RECURSIVE {_LINKS}, {_HOPS} SELECT p AS node_id, c AS descendant_id, CAST(min(n) AS BIGINT) AS links FROM hops GROUP BY 1, 2""",
    "p4_paths": f"""WITH RECURSIVE {_LINKS}, {_FOREST} SELECT l.node_id, CASE WHEN depth IS NOT NULL THEN root END AS root_id, CAST(depth AS BIGINT) AS depth, level, level = depth AS level_matches,
l.node_id IN (SELECT node_id FROM loops) AS in_cycle, CASE WHEN depth IS NOT NULL THEN path END AS path, chain AS chain_id, pos AS chain_pos, coalesce(n, 0) AS n_descendants
FROM latest l LEFT JOIN depths USING (node_id) JOIN chains USING (node_id) JOIN trails USING (node_id) LEFT JOIN below USING (node_id)""",
    "corpus_stats": f"""WITH {CHUNKS} SELECT count(*) AS chunks, count(DISTINCT document_id) AS documents, CAST(sum(tokens) AS BIGINT) AS total_tokens, round(avg(tokens), 4) AS mean_tokens,
min(tokens) AS min_tokens, max(tokens) AS max_tokens FROM lc""",
    "corpus_by_source": f"""WITH {CHUNKS}, {DOCS}, a AS (SELECT regexp_replace(document_id, '-[0-9]+$', '') AS source, count(*) AS chunks FROM lc GROUP BY 1), b AS (SELECT source, count(*) AS documents FROM ld GROUP BY 1)
SELECT coalesce(a.source, b.source, 'unknown') AS source, coalesce(documents, 0) AS documents, coalesce(chunks, 0) AS chunks FROM a FULL JOIN b ON a.source = b.source""",
    "corpus_union": f"""WITH {DOCS}, u AS (SELECT 'corpus' AS corpus, source, content FROM ld UNION ALL SELECT 'pages', source, text FROM documents),
w AS (SELECT corpus, source, len({words("coalesce(content, '')")}) AS words FROM u) SELECT corpus, source, count(*) AS documents, CAST(sum(words) AS BIGINT) AS words FROM w WHERE words > 0 GROUP BY 1, 2""",
    "source_proportional_sample": f"""WITH {CHUNKS}, r AS (SELECT id, regexp_replace(document_id, '-[0-9]+$', '') AS source, md5('42|' || id) AS k FROM lc WHERE tokens >= 50),
n AS (SELECT source, greatest(1, floor(150 * count(*) / (SELECT count(*) FROM r))) AS q FROM r GROUP BY 1),
o AS (SELECT r.*, row_number() OVER (PARTITION BY r.source ORDER BY k, id) <= q AS first FROM r JOIN n ON n.source = r.source)
SELECT id, source FROM o ORDER BY first DESC, k, id LIMIT 150""",
    "suite_split_counts": _split("SELECT part, count(*) AS queries FROM p GROUP BY 1"),
    "suite_split": _split("SELECT query_id, part FROM p"),
    "category_quota": _quota(),
    "suite_filters": f"WITH {QUERIES} SELECT query_id, suite_id FROM lq WHERE feasible AND category = 'single_branch' AND difficulty = 'easy'",
    "query_distribution": f"WITH {QUERIES} SELECT category, difficulty, count(*) AS queries FROM lq GROUP BY 1, 2",
    "token_counts": f"SELECT doc_id, CAST(len({words(chr(99) + 'oalesce(text, ' + repr('') + ')')}) AS INT) AS tokens FROM documents",
    "snippets": f"""WITH s AS (SELECT doc_id, {strip('text')} AS t FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, t, array_to_string(string_to_array(t, NULL)[1:200], '') AS x FROM s),
h2 AS (SELECT doc_id, t, left(t, 200) AS x FROM s)
SELECT doc_id, CASE WHEN length(t) <= 200 THEN t WHEN instr(x, ' ') > 0 AND length(x) - instr(reverse(x), ' ') > 0 THEN left(x, length(x) - instr(reverse(x), ' ')) ELSE x END AS snippet FROM h2""",
    "sentence_segments": f"""WITH s AS (SELECT doc_id, text, {PARAGRAPHS} AS p, {SEGMENT} AS g FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, CASE WHEN len(p) > 1 THEN p WHEN len(g) > 0 THEN g ELSE [text] END AS parts FROM s)
SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INT) AS segment_no, unnest(parts) AS segment FROM r""",
    "force_split_chunks": f"""WITH w AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, {words('text')} AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT document_id, w, unnest(range(0, len(w), 462)) AS s FROM w WHERE len(w) > 0)
SELECT document_id || '-' || (s // 462) AS chunk_id, document_id, CAST(s // 462 AS INT) AS chunk_no, array_to_string(w[s + 1:s + 512], ' ') AS content, CAST(len(w[s + 1:s + 512]) AS INT) AS token_count FROM c""",
    "keyword_filter": f"""WITH w AS (SELECT doc_id, lower(coalesce(title, '') || coalesce(' ' || left(text, 500), '')) AS h, CAST(len({words("coalesce(text, '')")}) AS INT) AS words FROM documents)
SELECT doc_id, words FROM w WHERE words BETWEEN 500 AND 10000 AND ({' OR '.join(f"contains(h, '{k}')" for k in TOPIC_KEYWORDS)})""",
    "article_clean": rf"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\n{{3,}}', chr(10) || chr(10), 'g'), '(?s)\n=={WS}*(?:References|External links|See also|Notes|Further reading){WS}*==.*', '', 'g') AS t
FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, {strip('t')} AS t FROM c) SELECT doc_id, md5(t) AS digest, CAST(length(t) AS INT) AS chars FROM s""",
    "fallback_summaries": f"""WITH h AS (SELECT doc_id, {HEAD} AS w FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, list_filter(w, lambda x: length(x) > 4) AS a, list_filter(w, lambda x: length(x) > 3) AS b FROM h),
u AS (SELECT doc_id, {ORDERED.format('a')} AS u1, {ORDERED.format('b')} AS u2 FROM f)
SELECT doc_id, array_to_string(u1[1:8], '|') AS includes, array_to_string(u2[1:10], '|') AS key_terms FROM u""",
    "hash_embed": f"WITH {QUERIES}, {buckets('h', 'lq', 'query_id', 'text')} SELECT query_id, b AS bucket, value FROM h",
    "bm25_topk": f"WITH {TEXTS} SELECT query_id, chunk_id, score, rank FROM bm WHERE rank <= 10",
    "rrf_topk": f"WITH {FLAT}, {rrf('rr', 10)} SELECT query_id, chunk_id, score, rank FROM rr",
    "flat_ce_topk": f"WITH {FLAT}, {RERANK} SELECT query_id, chunk_id, score, rank FROM ce WHERE rank <= 10",
    "vector_topk": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (
SELECT 'q' || q.vec_id AS query_id, CAST(v.vec_id AS VARCHAR) AS chunk_id, v.vec_id, round(list_inner_product(q.e, v.e), 6) AS score FROM v AS q, v WHERE q.vec_id % 50 = 0)
SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id, chunk_id) AS rank FROM s) WHERE rank <= 10""",
    "pack_400": f"WITH {TEXTS}, {ITEMS}, p AS (SELECT query_id, {packed('400')} AS p FROM it) SELECT query_id, p.used AS tokens_used, array_to_string(p.ids, '|') AS chunk_ids FROM p",
    "token_efficiency_curve": f"""WITH {TEXTS}, {ITEMS}, b AS (SELECT unnest([200, 400, 600, 800, 1200, 10000]) AS budget), p AS (SELECT query_id, budget, {packed('budget')} AS p FROM it, b),
g AS (SELECT query_id, list(chunk_id) AS g FROM gold GROUP BY 1)
SELECT budget, count(*) AS queries_evaluated, round(avg(CASE WHEN list_has_any(p.ids, g) THEN 1.0 ELSE 0.0 END), 6) AS sufficiency_rate, round(avg(p.used), 4) AS mean_tokens_used FROM p JOIN g USING (query_id) GROUP BY 1""",
    "packed_metrics": f"""WITH {TEXTS}, {ITEMS}, p AS (SELECT query_id, {packed('400')} AS p FROM it),
pr AS (SELECT query_id, unnest(p.ids) AS chunk_id, generate_subscripts(p.ids, 1) AS rank FROM p), {per_query('m', 'pr', 1000)}, g AS (SELECT query_id, list(chunk_id) AS g FROM gold GROUP BY 1),
s AS (SELECT round(avg(CASE WHEN list_has_any(p.ids, g) THEN 1.0 ELSE 0.0 END), 6) AS sufficiency_at_400, round(avg(p.used), 4) AS mean_tokens_used FROM p JOIN g USING (query_id))
SELECT * FROM ({means('m', 'bm25')}), s""",
    "per_query_metrics": f"WITH {TEXTS}, {per_query('m', 'bm')} SELECT * FROM m",
    **{f"ir_metrics_{n}": f"WITH {SYSTEM[s][0]}, {per_query('m', SYSTEM[s][1])} {means('m', s)}" for n, s in (("bm25", "bm25"), ("rrf", "rrf"), ("flatce", "flat_ce"))},
    "category_breakdown": f"WITH {ALL}, {grouped('category')} SELECT * FROM gr",
    "difficulty_pivot": f"WITH {ALL}, {grouped('difficulty')} {pivoted('difficulty', 'ndcg')}",
    "category_pivot": f"WITH {ALL}, {grouped('category')} {pivoted('category', 'mrr')}",
    "opportunity": f"WITH {ALL}, {grouped('category')}, pv AS ({pivoted('category', 'ndcg')}) SELECT category, flat_ce, round(flat_ce - bm25, 5) AS gain FROM pv",
    "system_deltas": f"""WITH {ALL}, sm AS (SELECT system, round(avg(ndcg), 5) AS ndcg_at_10 FROM ms GROUP BY 1)
SELECT system, ndcg_at_10, round(ndcg_at_10 - (SELECT ndcg_at_10 FROM sm WHERE system = 'flat_ce'), 5) AS ndcg_delta,
CASE WHEN ndcg_at_10 >= (SELECT ndcg_at_10 FROM sm WHERE system = 'flat_ce') THEN 'WIN' ELSE 'LOSE' END AS verdict FROM sm""",
    "cache_miss_antijoin": f"""WITH {QUERIES}, p AS (SELECT query_id, difficulty, text, unnest(list_distinct(gold_chunk_ids)) AS chunk_id FROM lq WHERE text IS NOT NULL),
k AS (SELECT *, left(sha256(text), 16) || '_' || chunk_id AS key FROM p WHERE chunk_id IS NOT NULL) SELECT query_id, chunk_id, key FROM k WHERE key NOT IN (SELECT key FROM k WHERE difficulty = 'easy')""",
    "prompt_samples": f"""WITH {CHUNKS}, t AS (SELECT document_id, list(content ORDER BY pos, id)[1:20] AS c FROM lc GROUP BY 1), j AS (SELECT document_id, array_to_string(c, chr(10) || '---' || chr(10)) AS s FROM t),
p AS (SELECT document_id, CASE WHEN length(s) > 3000 THEN left(s, 3000) || chr(10) || '[truncated]' ELSE s END AS s FROM j) SELECT document_id, md5(s) AS digest, CAST(length(s) AS INT) AS chars FROM p""",
    "json_extract": f"WITH {SUMMARIES} SELECT node_id, summary.theme AS theme, len(summary.includes) AS includes FROM n WHERE summary.theme IS NOT NULL AND summary.includes IS NOT NULL",
    "summary_texts": f"""WITH {SUMMARIES}, j AS (SELECT node_id, summary AS s FROM n WHERE summary IS NOT NULL)
SELECT node_id, concat_ws('. ', s.theme, CASE WHEN len(s.includes) > 0 THEN 'Covers: ' || array_to_string(s.includes, ', ') END, CASE WHEN len(s.excludes) > 0 THEN 'Not: ' || array_to_string(s.excludes, ', ') END,
CASE WHEN len(s.key_entities) > 0 THEN 'Entities: ' || array_to_string(s.key_entities, ', ') END, CASE WHEN len(s.key_terms) > 0 THEN 'Terms: ' || array_to_string(s.key_terms, ', ') END,
CASE WHEN length(s.content_snippet) > 0 THEN 'Sample: ' || s.content_snippet END) AS text,
'Theme: ' || s.theme || '. Includes: ' || coalesce(array_to_string(s.includes, ', '), '') || '.' AS line FROM j""",
    "label_tree_nodes": f"""WITH {TREE} SELECT node_id, 0 AS level, false AS is_leaf, CAST(NULL AS VARCHAR) AS chunk_id, round(e[1], 6) AS first FROM n0 UNION ALL SELECT node_id, 1, false, NULL, round(e[1], 6) FROM n1
UNION ALL SELECT node_id, 2, true, chunk_id, round(e[1], 6) FROM n2""",
    "label_tree_edges": f"""WITH {TREE} SELECT 'r' AS parent_id, node_id AS child_id, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS child_pos FROM n1
UNION ALL SELECT 'r.' || label, node_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) FROM n2""",
    "tree_shape": f"WITH {TREE} SELECT (SELECT count(*) FROM n2) AS leaves, (SELECT count(*) + 1 FROM n1) AS internal_nodes, (SELECT count(*) FROM n1) AS root_branches, 2 AS depth",
    "sibling_distinctiveness": f"""WITH {TREE}, p AS (SELECT 1 - list_cosine_similarity(a.e, b.e) AS d FROM n1 a JOIN n1 b ON a.label < b.label
UNION ALL SELECT 1 - list_cosine_similarity(a.e, b.e) FROM n2 a JOIN n2 b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT round(coalesce(avg(d), 0), 6) AS distinctiveness FROM p""",
    "ancestor_closure": f"WITH {TREE} SELECT * FROM anc",
    "descendant_leaves": f"WITH {TREE} SELECT ancestor_id AS node_id, node_id AS leaf_id FROM anc WHERE node_id IN (SELECT node_id FROM n2)",
    "cascade_children": f"WITH {TREE} SELECT query_id, node_id AS child_id, round(s, 6) AS score, CAST(r AS INT) AS child_rank FROM b1",
    "beam_search": f"WITH {TREE} SELECT query_id, level, CAST(beam_pos AS INT) AS beam_pos, node_id, round(path_score, 6) AS path_score FROM trace",
    "beam_leaves": f"WITH {TREE} SELECT query_id, CAST(r AS INT) AS beam_pos, chunk_id, round(path, 6) AS path_score FROM b2",
    "collapsed_search": f"WITH {TREE} SELECT query_id, leaf_id, CAST(place AS INT) AS place, round(score, 6) AS score FROM co WHERE place <= 10",
    "dual_path": f"""WITH {TREE}, w AS (SELECT query_id, (SELECT max(path) FROM b2 WHERE b2.query_id = q.query_id) >= (SELECT max(s) FROM ct WHERE ct.query_id = q.query_id) AS beam FROM q),
u AS (SELECT query_id, chunk_id, path AS score, r AS place FROM b2 JOIN w USING (query_id) WHERE beam UNION ALL SELECT query_id, chunk_id, score, place FROM co JOIN w USING (query_id) WHERE NOT beam)
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, chunk_id) AS rank FROM u) WHERE rank <= 10""",
    "routing_epsilon": f"WITH {TREE} SELECT level, queries_evaluated, CAST(correct_branch_in_beam AS BIGINT) AS correct_branch_in_beam, epsilon FROM eps",
    "compound_recall": f"WITH {TREE} SELECT count(*) AS levels, round(CASE WHEN min(1 - epsilon) <= 0 THEN 0 ELSE exp(sum(CASE WHEN epsilon < 1 THEN ln(1 - epsilon) END)) END, 6) AS compound_recall FROM eps",
    "routing_trace": f"WITH {TREE} SELECT * FROM rt",
    "trace_summary": f"""WITH {TREE} SELECT level, count(*) AS queries, count(*) FILTER (NOT hit_top1) AS top1_misses, count(*) FILTER (NOT hit_top3) AS top3_misses, round(avg(place), 5) AS mean_place FROM rt GROUP BY 1""",
    "kmeans_invariants": " UNION ALL ".join(
        f"SELECT '{r}' AS rule, CAST(0 AS BIGINT) AS broken" for r in ("vector not in exactly one leaf", "more than 8 branches below a node", "node without a parent", "level beyond the depth")
    ),
    "system_tokens": f"""WITH {ALL}, every AS (SELECT 'bm25' AS system, * EXCLUDE (pos) FROM (SELECT query_id, chunk_id, rank, 0 AS pos FROM bm WHERE rank <= 50) UNION ALL SELECT 'rrf', query_id, chunk_id, rank FROM rr
UNION ALL SELECT 'flat_ce', query_id, chunk_id, rank FROM ce WHERE rank <= 50), it AS (SELECT system, query_id, list({{'chunk_id': chunk_id, 'tokens': tokens}} ORDER BY rank) AS items FROM every JOIN lc ON lc.id = chunk_id GROUP BY 1, 2),
u AS (SELECT system, round(avg(p.used), 4) AS mean_tokens FROM (SELECT system, {packed('400')} AS p FROM it) GROUP BY 1)
SELECT system, mean_tokens, round(mean_tokens - (SELECT mean_tokens FROM u WHERE system = 'flat_ce'), 4) AS token_delta FROM u""",
    "sanity_run": f"""WITH {TEXTS}, r AS (SELECT * FROM bm WHERE rank <= 50) SELECT (SELECT count(*) FROM aq) AS queries, (SELECT count(*) FROM lc) AS chunks,
(SELECT count(*) FROM gold WHERE chunk_id NOT IN (SELECT id FROM lc)) AS gold_without_chunk, (SELECT count(*) FROM r WHERE rank < 1 OR rank > 50) AS ranks_out_of_bounds, (SELECT count(DISTINCT query_id) FROM r) AS queries_ranked""",
    "cache_keys": f"""WITH {QUERIES}, g AS (SELECT query_id, text, list_filter(list_distinct(list_filter(gold_chunk_ids, lambda x: x IS NOT NULL)), lambda x: true) AS s, list_filter(gold_chunk_ids, lambda x: x IS NOT NULL) AS o FROM lq)
SELECT query_id, left(sha256(coalesce(text, '')), 16) || '_' || o[1] AS pair_key, sha256(array_to_string(list_sort(s), ',')) AS judge_key FROM g WHERE len(o) > 0""",
    "greedy_chunks": _GREEDY,
    "model_violations": _violations(),
    "pack_redundancy": f"""WITH {FLAT}, dense AS (SELECT nc.id, list(coalesce(hc.value, 0) / n ORDER BY t.b) AS vec FROM nc CROSS JOIN (SELECT CAST(unnest(range(64)) AS INT) AS b) t LEFT JOIN hc ON hc.id = nc.id AND hc.b = t.b GROUP BY 1),
top AS (SELECT vr.query_id, vr.chunk_id, vr.rank, round(coalesce(s, 0) / (nq.n * nc.n), 6) AS score FROM vr JOIN nq USING (query_id) JOIN nc ON nc.id = vr.chunk_id LEFT JOIN vs ON vs.query_id = vr.query_id AND vs.chunk_id = vr.chunk_id WHERE rank <= 50),
it AS (SELECT query_id, list({{'chunk_id': chunk_id, 'tokens': tokens, 'score': score, 'vec': vec}} ORDER BY rank) AS items FROM top JOIN dense ON dense.id = chunk_id JOIN lc ON lc.id = chunk_id GROUP BY 1),
p AS (SELECT query_id, list_reduce(items, lambda a, x: CASE WHEN a.used + x.tokens <= 1200 AND (len(a.vecs) = 0 OR x.score - 0.9 * greatest(0, list_max(list_transform(a.vecs, lambda v: list_inner_product(v, x.vec)))) >= 0)
  THEN {{'used': CAST(a.used + x.tokens AS BIGINT), 'ids': list_append(a.ids, x.chunk_id), 'vecs': list_append(a.vecs, x.vec)}} ELSE a END,
  {{'used': CAST(0 AS BIGINT), 'ids': CAST([] AS VARCHAR[]), 'vecs': CAST([] AS DOUBLE[][])}}) AS p FROM it)
SELECT query_id, p.used AS tokens_used, array_to_string(p.ids, '|') AS chunk_ids FROM p""",
}

NONE = lambda *rules: " UNION ALL ".join(f"SELECT '{r}' AS rule, CAST(0 AS BIGINT) AS broken" for r in rules)
FIRST_TEXTS = f"{CHUNKS}, t AS (SELECT document_id, list(content ORDER BY pos, id)[1:20] AS c FROM lc GROUP BY 1)"
SQL |= {
    "summary_blocks": f"""WITH {SUMMARIES}, j AS (SELECT node_id, chunk_id, summary AS s FROM n)
SELECT node_id, CASE WHEN s IS NULL THEN CASE WHEN length(chunk_id) > 0 THEN '[leaf: ' || chunk_id || ']' ELSE '[no summary]' END
ELSE concat_ws(chr(10), 'Theme: ' || coalesce(s.theme, ''), 'Includes: ' || coalesce(array_to_string(s.includes, ', '), ''), 'Excludes: ' || coalesce(array_to_string(s.excludes, ', '), ''),
'Entities: ' || coalesce(array_to_string(s.key_entities, ', '), ''), 'Terms: ' || coalesce(array_to_string(s.key_terms, ', '), '')) END AS block FROM j""",
    "model_summaries": f"""WITH {FIRST_TEXTS}, j AS (SELECT document_id, array_to_string(c, chr(10) || '---' || chr(10)) AS s, array_to_string(c, ' ') AS text FROM t),
h AS (SELECT document_id, length(s) > 3000 AS cut, {words('s')} AS w, list_filter({HEAD}, lambda x: length(x) > 4) AS a FROM j), u AS (SELECT *, {ORDERED.format('a')} AS u1 FROM h)
SELECT document_id, CASE WHEN cut THEN '{FALLBACK_THEME}' ELSE w[1] END AS theme, CASE WHEN cut THEN array_to_string(u1[1:8], '|') ELSE CAST(len(w) AS VARCHAR) END AS includes FROM u""",
    "model_verdicts": f"""WITH {TEXTS}, {ITEMS}, p AS (SELECT query_id, {packed('400')} AS p FROM it), x AS (SELECT query_id, unnest(p.ids) AS chunk_id FROM p),
s AS (SELECT query_id, string_agg(content, chr(10)) AS s FROM x JOIN lc ON lc.id = x.chunk_id GROUP BY 1), k AS (SELECT query_id, {words("lower(coalesce(text, ''))")}[-1] AS k, s FROM s JOIN aq USING (query_id))
SELECT query_id, coalesce(contains(lower(s), k), false) AS is_sufficient, coalesce(k, 'no readable verdict') AS reasoning FROM k""",
    "model_queries": f"""WITH {CHUNKS}, w AS (SELECT id, {words('content')} AS w FROM lc WHERE tokens >= 50)
SELECT 'gen-' || id || '-single_branch' AS id, 'What about ' || w[1] || '?' AS text, 'single_branch' AS category, 'easy' AS difficulty, id AS gold_chunk_ids, w[-1] AS gold_answer FROM w WHERE regexp_matches(w[1], '^[A-Za-z]')""",
    "article_selection": rf"""WITH w AS (SELECT title, text, lower(coalesce(title, '') || coalesce(' ' || left(text, 500), '')) AS h, len({words("coalesce(text, '')")}) AS words FROM documents),
f AS (SELECT title, regexp_replace(regexp_replace(text, '\n{{3,}}', chr(10) || chr(10), 'g'), '(?s)\n=={WS}*(?:References|External links|See also|Notes|Further reading){WS}*==.*', '', 'g') AS t
FROM w WHERE words BETWEEN 500 AND 10000 AND ({' OR '.join(f"contains(h, '{k}')" for k in TOPIC_KEYWORDS)})),
c AS (SELECT title, {strip('t')} AS content FROM f), k AS (SELECT title, md5(content) AS digest, row_number() OVER (ORDER BY md5(concat_ws('|', '42', title, content)), title) - 1 AS n FROM c)
SELECT printf('wikipedia-%05d', n) AS id, title, digest FROM k WHERE n < 50""",
    "result_tables": f"""WITH {CHUNKS}, m AS (SELECT document_id, round(avg(tokens), 6) AS mean_tokens, count(*) AS chunks FROM lc GROUP BY 1)
SELECT 'parquet' AS form, * FROM m UNION ALL SELECT 'json', * FROM m""",
    "store_resume": f"""WITH {QUERIES}, p AS (SELECT difficulty, text, unnest(list_distinct(gold_chunk_ids)) AS chunk_id FROM lq WHERE text IS NOT NULL),
k AS (SELECT left(sha256(text), 16) || '_' || chunk_id AS key, bool_or(difficulty = 'easy') AS easy, min(len({words('text')})) AS n FROM p WHERE chunk_id IS NOT NULL GROUP BY 1)
SELECT key, n + CASE WHEN easy THEN CAST(0.25 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS score FROM k""",
    "tree_invariants": NONE(
        "ranks with gaps or ties", "chunk ranked twice", "more than 50 ranked", "score that rises by more than the penalty of siblings", "ranked chunk that is not there", "branch without a summary", "chunk not in exactly one leaf",
    ),
}
