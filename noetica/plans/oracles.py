"""SQL for DuckDB that gives each registered query's rows on the same tables."""

from __future__ import annotations

ENTITIES = """ents AS (
  SELECT 'S:' || s_suppkey AS uuid, s_name AS name, 'Supplier' AS label, 'nation ' || s_nationkey AS summary FROM supplier
  UNION ALL SELECT 'P:' || p_partkey, p_name || ' #' || p_partkey, 'Part', p_brand || ' ' || p_type FROM part
  UNION ALL SELECT 'N:' || n_nationkey, n_name, 'Nation', 'region ' || n_regionkey FROM nation)"""
EDGES = """lines AS (
  SELECT l_suppkey, l_partkey, l_shipdate AS valid_at, min(l_returnflag) AS name, list_sort(list(DISTINCT l_orderkey::VARCHAR)) AS eps
  FROM lineitem GROUP BY l_suppkey, l_partkey, l_shipdate),
named AS (
  SELECT 'S:' || l_suppkey AS source_uuid, 'P:' || l_partkey AS target_uuid, valid_at, name, array_to_string(eps, ',') AS episodes,
    'S:' || l_suppkey || '|P:' || l_partkey || '|' || strftime(valid_at, '%Y-%m-%d') AS uuid, s_name || ' supplies ' || p_name AS fact,
    s_name AS source_name, p_name || ' #' || p_partkey AS target_name
  FROM lines JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey),
ended AS (SELECT *, lead(valid_at) OVER (PARTITION BY target_uuid ORDER BY valid_at, source_uuid) AS invalid_at FROM named),
edges AS (SELECT *, CASE WHEN name = 'R' THEN invalid_at END AS expired_at FROM ended)"""
WAYS = "ways AS (SELECT source_uuid AS node, target_uuid AS other, * FROM edges UNION ALL SELECT target_uuid, source_uuid, * FROM edges WHERE source_uuid <> target_uuid)"
ADJACENCY = "adj AS (SELECT node AS a, other AS b, count(*) AS weight FROM ways GROUP BY 1, 2)"
MEMBERS = "u AS (SELECT 'S:' || s_suppkey AS uuid FROM supplier WHERE s_suppkey BETWEEN 1 AND 5 UNION ALL SELECT 'P:' || p_partkey FROM part WHERE p_partkey BETWEEN 1 AND 200)"
NOTES = r"notes AS (SELECT * FROM (SELECT doc_id, source || ' ' || doc_id AS name, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents) WHERE length(body) > 50)"
CREATED = "CASE WHEN conv_id % 7 <> 0 THEN strftime(to_timestamp(1767225600 + conv_id % 50 * 60) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') END AS created_at"
TURNS = f"turns AS (SELECT 'conv ' || conv_id AS saga, turn, role, text AS content, {CREATED} FROM conversations)"
EPISODES = TURNS + """, episodes AS (SELECT saga, 'Turn ' || i || ' (' || role || ')' AS name, role || ': ' || substring(content, 1, 3000) AS body, (i - 1)::INT AS turn_index, coalesce(created_at, '2026-01-01T00:00:00Z') AS created_at
  FROM (SELECT *, row_number() OVER (PARTITION BY saga ORDER BY turn) AS i FROM turns) WHERE i <= 20 AND length(content) >= 20)"""
SOURCES = rf"""sources AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'assistant-thread' ELSE 'search-thread' END AS source,
  CASE WHEN conv_id % 10 = 0 THEN 'users' ELSE 'conv ' || conv_id END AS label,
  string_agg(CASE WHEN role = 'user' THEN '[User]: ' ELSE '[Assistant]: ' END || text, chr(10) ORDER BY turn) AS raw_content, {CREATED}
  FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id)"""
TOKENS = r"toks AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS words FROM texts)"
DOCS = "texts AS (SELECT doc_id AS id, text FROM documents)"
COSINE = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))"


def iso(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S') AS {column.split('.')[-1]}"


def _terms(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def bm25(words: list[str]) -> str:
    """CTEs from texts to scores (id, score, n_terms)."""
    return TOKENS + f""", totals AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM toks),
hits AS (SELECT id, len(words) AS size, unnest(list_filter(words, lambda w: list_contains({_terms(words)}, w))) AS term FROM toks),
tf AS (SELECT id, size, term, count(*) AS tf FROM hits GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scores AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score, count(*) AS n_terms
  FROM tf JOIN df USING (term) CROSS JOIN totals GROUP BY id)"""


def vectors_of(query: list[str]) -> str:
    """CTEs from toks to dense (id, score): hashed TF-IDF under a random projection, in whole numbers."""
    slot = "('0x' || md5(w)[1:5])::BIGINT"
    signs = "[CASE WHEN (('0x' || h[i // 8 * 2 + 1:i // 8 * 2 + 2])::BIGINT >> (7 - i % 8)) & 1 = 1 THEN 1 ELSE -1 END FOR i IN range(256)]"
    return f"""dt AS MATERIALIZED (SELECT words, row_number() OVER () AS t FROM (SELECT DISTINCT words FROM toks WHERE len(words) > 0)),
nt AS (SELECT count(*) AS n FROM dt),
ts AS MATERIALIZED (SELECT t, slot, count(*) AS tf FROM (SELECT t, unnest(list_transform(words, lambda w: {slot})) AS slot FROM dt) GROUP BY ALL),
ws AS (SELECT slot, floor(1000 * ln((any_value(n) + 1) / (count(*) + 1)))::BIGINT + 1 AS w FROM ts CROSS JOIN nt GROUP BY slot),
asked AS (SELECT slot, count(*) AS tf FROM (SELECT unnest(list_transform({_terms(query)}, lambda w: {slot})) AS slot) GROUP BY slot),
rs AS MATERIALIZED (SELECT slot, w, {signs} AS r FROM (SELECT slot, coalesce(w, floor(1000 * ln(n + 1))::BIGINT + 1) AS w, md5('a' || slot) || md5('b' || slot) AS h FROM (SELECT slot FROM ts UNION SELECT slot FROM asked) LEFT JOIN ws USING (slot) CROSS JOIN nt)),
qv AS (SELECT i, sum(x)::DOUBLE AS x FROM (SELECT unnest(range(256)) AS i, unnest([tf * w * e FOR e IN r]) AS x FROM asked JOIN rs USING (slot)) GROUP BY i),
tv AS (SELECT t, i, sum(x)::DOUBLE AS x FROM (SELECT t, unnest(range(256)) AS i, unnest([tf * w * e FOR e IN r]) AS x FROM ts JOIN rs USING (slot)) GROUP BY ALL),
near AS (SELECT t, round(sum(tv.x * qv.x) / (sqrt(sum(tv.x * tv.x)) * sqrt(sum(qv.x * qv.x))), 6) AS score FROM tv JOIN qv USING (i) GROUP BY t),
dense AS (SELECT id, score FROM toks JOIN dt USING (words) JOIN near USING (t))"""


def hybrid(words: list[str]) -> str:
    """CTEs from texts to fused (id, score)."""
    return bm25(words) + f""", {vectors_of(words)},
both_ranks AS (SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scores) WHERE rank <= 50
  UNION ALL SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM dense) WHERE rank <= 50),
fused AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM both_ranks GROUP BY id),
top AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM fused QUALIFY rank <= 10)"""


def labels(rounds: int = 3) -> str:
    """CTEs of synchronous label propagation; the last is labels."""
    out = [f"{ENTITIES}, {EDGES}, {WAYS}, {ADJACENCY}, l0 AS (SELECT uuid, uuid AS label FROM ents)"]
    for i in range(rounds):
        out.append(f"""v{i} AS (SELECT uuid, label, sum(vote) AS vote FROM (SELECT a AS uuid, label, weight::DOUBLE AS vote FROM adj JOIN l{i} ON uuid = b UNION ALL SELECT uuid, label, 0.5 FROM l{i}) GROUP BY 1, 2),
l{i + 1} AS (SELECT uuid, label FROM v{i} QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY vote DESC, label) = 1)""")
    return ", ".join([*out, f"labels AS (SELECT * FROM l{rounds}), sizes AS (SELECT label, count(*) AS n FROM labels GROUP BY label)"])


PLANTED = """copies AS (SELECT e.*, j FROM embeddings e CROSS JOIN range(1, 4) r(j) WHERE vec_id % 4 = 0),
planted AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS embedding, label FROM embeddings UNION ALL
  SELECT vec_id + j * 1000000000, list_transform(range(64), lambda k: embedding[k + 1]::DOUBLE + 0.004::DOUBLE * (1 + (vec_id + 3 * j) % 8) * ((vec_id * 7 + k * 13 + j * 5) % 11 - 5)), (CASE WHEN j < 3 THEN (label + j) % 5 ELSE label END)::INT FROM copies)"""
PLANTED_TEXTS = """told AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Not so: ' ELSE '' END || text AS text FROM documents UNION ALL
  SELECT doc_id + j * 1000000000, CASE WHEN j % 2 = 1 THEN 'Actually, ' ELSE '' END || text FROM documents CROSS JOIN range(1, 4) r(j) WHERE doc_id % 4 = 0)"""
PLANTED_TIMES = """made AS (SELECT event_id, ts FROM events UNION ALL SELECT event_id + j * 1000000000, ts + to_days((10 * j)::INT) FROM events CROSS JOIN range(1, 4) r(j) WHERE event_id % 4 = 0)"""


def planted_pairs(threshold: float) -> str:
    return f"{PLANTED}, {pairs(threshold).replace('embeddings', 'planted')}"


def pairs(threshold: float) -> str:
    score = COSINE.format(a="x.embedding", b="y.embedding")
    return f"pairs AS (SELECT * FROM (SELECT x.vec_id AS a, y.vec_id AS b, x.label AS a_kind, y.label AS b_kind, {score} AS raw FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id) WHERE raw > {threshold})"


def nearest(embedding: str, k: int) -> str:
    score = COSINE.format(a=embedding.format("e"), b=embedding.format("q"))
    return f"SELECT id, score, rank::INT AS rank FROM (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT e.vec_id AS id, round({score}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.vec_id <> 0)) WHERE rank <= {k}"


NOW = "TIMESTAMP '2024-02-01 00:00:00'"
AS_OF = "TIMESTAMP '1998-01-01 00:00:00'"
STATE = "CASE WHEN n_done > 0 THEN 'completed' WHEN idle_days >= 7 THEN 'stalled' WHEN n_acted > 0 THEN 'acting' WHEN n_decided > 0 THEN 'decided' WHEN n_compared > 0 THEN 'evaluating' ELSE 'exploring' END"
THREADS = f"""threads AS (SELECT user_id || ':' || event_type AS thread_id, count(*) FILTER (event_type = 'purchase' AND value > 40) AS n_done, count(*) FILTER (event_type = 'click' AND value > 40) AS n_acted,
  count(*) FILTER (event_type = 'signup' AND value > 40) AS n_decided, count(*) FILTER (event_type = 'view') AS n_compared, max(ts) AS last_at, min(ts) AS first_at, count(*) AS n, count(DISTINCT hour(ts)) AS n_sources
  FROM events GROUP BY user_id, event_type),
idle AS (SELECT *, date_diff('day', last_at::DATE, DATE '2024-02-01')::INT AS idle_days FROM threads),
states AS (SELECT *, {STATE} AS state FROM idle)"""
GRAPH = f"{ENTITIES}, {EDGES}, {WAYS}"


def _history(bucket: str) -> str:
    return f"""WITH {EDGES}, split AS (SELECT *, {bucket} AS bucket FROM edges WHERE contains(fact, 'red widget')),
placed AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY valid_at DESC, uuid) AS rank FROM split WHERE bucket IS NOT NULL)
SELECT bucket, rank::INT AS rank, uuid, fact, {iso('valid_at')}, {iso('invalid_at')} FROM placed WHERE rank <= 10"""


_T = "TIMESTAMP '2001-06-01 00:00:00'"
_CURRENT = f"(valid_at IS NULL OR valid_at <= {_T}) AND (invalid_at IS NULL OR invalid_at > {_T})"
BUILT = f"""{labels()}, best AS (SELECT label, n FROM sizes WHERE n BETWEEN 2 AND 100 ORDER BY n DESC, label LIMIT 50),
heavy AS (SELECT a AS uuid, sum(weight) AS weight FROM adj GROUP BY a),
named_members AS (SELECT label, n, name, row_number() OVER (PARTITION BY label ORDER BY weight DESC NULLS LAST, uuid) AS i FROM best JOIN labels USING (label) JOIN (SELECT uuid, name FROM ents) USING (uuid) LEFT JOIN heavy USING (uuid)),
names AS (SELECT label, n, string_agg(name, ', ' ORDER BY i) AS name FROM named_members WHERE i <= 3 GROUP BY label, n),
inner_facts AS (SELECT s.label, fact, row_number() OVER (PARTITION BY s.label ORDER BY fact, edges.uuid) AS i FROM edges JOIN labels s ON s.uuid = source_uuid JOIN labels t ON t.uuid = target_uuid WHERE s.label = t.label),
built AS (SELECT label, n, name, coalesce(summary, '') AS summary FROM names LEFT JOIN (SELECT label, string_agg(fact, '; ' ORDER BY fact) AS summary FROM inner_facts WHERE i <= 5 GROUP BY label) USING (label))"""
STATS = f"""{BUILT}, {EPISODES}, stats AS (SELECT (SELECT count(*) FROM ents) AS entity_count, (SELECT count(*) FROM edges) AS edge_count, (SELECT count(*) FROM episodes) AS episode_count,
  (SELECT count(*) FROM built) AS community_count, (SELECT count(*) FROM ents WHERE uuid NOT IN (SELECT node FROM ways)) AS orphan_count)"""
_NORMAL = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
RESOLVED = rf"""told AS (SELECT unnest(regexp_extract_all(body, '(?:^|[^\p{{L}}\p{{N}}_])(\p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)*)', 1)) AS mention FROM notes
  UNION SELECT regexp_replace(upper(name), '0#|#0', '##', 'g') FROM ents UNION SELECT 'Quoted: ' || name || ' (item)' FROM ents WHERE uuid LIKE 'P:%' UNION SELECT regexp_replace(name, '^\S+ ', '') FROM ents WHERE uuid LIKE 'P:%'),
mentions AS (SELECT mention, {_NORMAL.format('mention')} AS key FROM told), wanted AS (SELECT DISTINCT key FROM mentions),
known AS (SELECT {_NORMAL.format('name')} AS name, min(uuid) AS uuid FROM ents GROUP BY 1),
exact AS (SELECT key, uuid FROM wanted JOIN known ON key = name),
fuzzy AS (SELECT key, arg_min(uuid, (levenshtein(key, name), uuid)) AS uuid FROM wanted ANTI JOIN exact USING (key) JOIN known ON abs(length(key) - length(name)) <= 2
  WHERE levenshtein(key, name) <= 2 AND levenshtein(key, name) < least(length(key), length(name)) GROUP BY key),
left_over AS (SELECT key FROM wanted WHERE key NOT IN (SELECT key FROM exact) AND key NOT IN (SELECT key FROM fuzzy)),
parts AS (SELECT uuid, string_split(name, ' ') AS ws FROM known), sizes_of AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM parts),
tf AS (SELECT uuid, size, word, count(*) AS tf FROM (SELECT uuid, len(ws) AS size, unnest(ws) AS word FROM parts) GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
asked AS (SELECT DISTINCT key, unnest(string_split(key, ' ')) AS word FROM left_over),
scored AS (SELECT key, uuid, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM asked JOIN tf USING (word) JOIN df USING (word) CROSS JOIN sizes_of WHERE word <> '' GROUP BY key, uuid),
by_word AS (SELECT key, arg_min(uuid, (-score, uuid)) AS uuid FROM scored GROUP BY key),
tiers AS (SELECT key, uuid, 'exact' AS tier FROM exact UNION ALL SELECT key, uuid, 'fuzzy' FROM fuzzy UNION ALL SELECT key, uuid, 'words' FROM by_word),
resolved AS (SELECT mention, uuid, tier FROM mentions LEFT JOIN tiers USING (key))"""

ORACLES: dict[str, str] = {
    "graph_stats": f"WITH {STATS} SELECT * FROM stats",
    "orphan_pct": f"WITH {STATS} SELECT CASE WHEN entity_count > 0 THEN printf('%.1f', round(100.0 * orphan_count / entity_count, 1)) ELSE '0' END AS orphan_pct FROM stats",
    "node_lookup": f"WITH {ENTITIES} SELECT uuid, name, label AS labels, summary FROM ents WHERE uuid = 'S:1'",
    "expand_1hop": f"""WITH {GRAPH}, near AS (SELECT * FROM ways WHERE node = 'S:1' AND expired_at IS NULL ORDER BY valid_at DESC, uuid LIMIT 20)
SELECT c.uuid AS center_uuid, c.name AS center_name, near.other AS neighbor_uuid, near.uuid AS edge_uuid, near.source_uuid, near.target_uuid, near.fact, {iso('near.valid_at')}, {iso('near.invalid_at')}, o.name AS neighbor_name
FROM ents c LEFT JOIN near ON true LEFT JOIN ents o ON o.uuid = near.other WHERE c.uuid = 'S:1'""",
    "expand_2hop": f"""WITH {GRAPH}, live AS (SELECT DISTINCT node, other FROM ways WHERE expired_at IS NULL), h1 AS (SELECT DISTINCT other AS uuid FROM live WHERE node = 'S:1'),
h2 AS (SELECT DISTINCT other AS uuid FROM live WHERE node IN (SELECT uuid FROM h1)) SELECT uuid, min(hop)::INT AS hop FROM (SELECT 'S:1' AS uuid, 0 AS hop UNION ALL SELECT uuid, 1 FROM h1 UNION ALL SELECT uuid, 2 FROM h2) GROUP BY uuid""",
    "edges_between": f"WITH {EDGES}, {MEMBERS} SELECT uuid, source_name, target_name, fact, {iso('valid_at')}, episodes FROM edges WHERE source_uuid IN (FROM u) AND target_uuid IN (FROM u) AND invalid_at IS NULL",
    "edges_between_asof": f"WITH {EDGES}, {MEMBERS} SELECT uuid, source_name, target_name, fact, {iso('valid_at')}, {iso('invalid_at')} FROM edges WHERE source_uuid IN (FROM u) AND target_uuid IN (FROM u) AND valid_at <= {AS_OF} AND (invalid_at IS NULL OR invalid_at > {AS_OF})",
    "orphan_entities": f"WITH {GRAPH} SELECT uuid, name FROM ents WHERE uuid NOT IN (SELECT node FROM ways)",
    "adjacency_weighted": f"WITH {GRAPH}, {ADJACENCY} SELECT * FROM adj",
    "adjacency_full": f"WITH {GRAPH}, {ADJACENCY} SELECT uuid, count(b) AS degree, coalesce(sum(weight), 0)::BIGINT AS weight FROM ents LEFT JOIN adj ON a = uuid GROUP BY uuid",
    "edge_triples": f"WITH {EDGES} SELECT source_name, fact, target_name, uuid FROM edges ORDER BY fact, uuid LIMIT 15",
    "hub_entities": f"WITH {GRAPH} SELECT node AS uuid, count(*) AS degree FROM ways GROUP BY node ORDER BY degree DESC, uuid LIMIT 10",
    "group_scan": f"WITH {ENTITIES} SELECT label, count(*) AS n, count(DISTINCT summary) AS n_summaries FROM ents GROUP BY label",
    "priority_subgraph": f"""WITH {GRAPH}, seeds AS (SELECT 'S:' || e.vec_id AS uuid FROM embeddings e JOIN supplier ON s_suppkey = e.vec_id, embeddings q WHERE q.vec_id = 0 AND e.vec_id <> 0 ORDER BY round({COSINE.format(a='e.embedding', b='q.embedding')}, 6) DESC, e.vec_id LIMIT 5),
near AS (SELECT other AS uuid, min(CASE name WHEN 'R' THEN 0 WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) AS priority FROM ways WHERE expired_at IS NULL AND node IN (FROM seeds) GROUP BY other)
SELECT uuid, priority::INT AS priority FROM (SELECT * FROM near WHERE uuid NOT IN (FROM seeds) UNION ALL SELECT uuid, -1 FROM seeds) ORDER BY priority, uuid LIMIT 15""",
    "thread_edge_types": f"WITH {EDGES}, {MEMBERS} SELECT name, count(*) AS n, 0.15::DOUBLE AS boost FROM edges WHERE source_uuid IN (FROM u) AND target_uuid IN (FROM u) GROUP BY name",
    "history_now": _history("CASE WHEN invalid_at IS NULL THEN 'current' ELSE 'superseded' END"),
    "history_asof": _history(f"CASE WHEN {_CURRENT} THEN 'current' WHEN invalid_at IS NOT NULL AND valid_at <= {_T} THEN 'superseded' END"),
    "history_asof_mcp": _history(f"CASE WHEN {_CURRENT} THEN 'current' WHEN invalid_at IS NOT NULL AND (valid_at IS NULL OR valid_at <= {_T}) THEN 'superseded' END"),
    "history_counts": f"""WITH {EDGES} SELECT CASE WHEN (valid_at IS NULL OR valid_at <= {AS_OF}) AND (invalid_at IS NULL OR invalid_at > {AS_OF}) THEN 'current' WHEN invalid_at IS NOT NULL AND valid_at <= {AS_OF} THEN 'superseded' ELSE 'neither' END AS bucket, count(*) AS n FROM edges GROUP BY 1""",
    "edge_supersession": f"WITH {EDGES} SELECT uuid, {iso('valid_at')}, {iso('invalid_at')}, {iso('expired_at')} FROM edges",
    "mark_resolved": f"WITH {ENTITIES}, {EDGES} SELECT uuid, name, strftime(m, '%Y-%m-%dT%H:%M:%S') AS resolved_at FROM ents LEFT JOIN (SELECT target_uuid, min(valid_at) AS m FROM edges WHERE name = 'R' GROUP BY 1) ON target_uuid = uuid",
    "conversation_episodes": f"WITH {EPISODES} SELECT * FROM episodes",
    "turn_split": r"""WITH t AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS turn, role, string_split(text, chr(10)) AS lines FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, turn, role, regexp_replace(array_to_string(list_prepend(regexp_replace(lines[1], '^\s+|\s+$', '', 'g'), lines[2:]), chr(10)), '^\s+|\s+$', '', 'g') AS content FROM t""",
    "notes_capped": f"WITH {NOTES} SELECT doc_id, name, length(substring(body, 1, 5000))::INT AS n, md5(substring(body, 1, 5000)) AS body_md5 FROM notes WHERE NOT regexp_matches(lower(name), 'api key|password|secret|credential|token')",
    "sensitive_filter": "SELECT regexp_matches(lower(string_split(text, chr(10))[1]), 'api key|password|secret|credential|token') AS sensitive, count(*) AS n FROM documents GROUP BY 1",
    "length_filter": r"SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g'))::INT AS n FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 50",
    "skip_existing_anti": f"WITH {NOTES} SELECT doc_id, name FROM notes WHERE substring(name, 1, 80) NOT IN (SELECT substring(name, 1, 80) FROM notes WHERE doc_id % 2 = 0)",
    "remaining_notes_anti": f"WITH {NOTES} SELECT doc_id, name FROM notes WHERE name NOT IN (SELECT name FROM notes WHERE doc_id % 3 = 0)",
    "skip_limit": f"WITH {NOTES} SELECT doc_id, name FROM notes ORDER BY doc_id LIMIT 50 OFFSET 100",
    "corpus_summary": f"WITH {NOTES} SELECT count(*) AS n_notes, sum(length(body))::BIGINT AS chars, sum(least(length(body), 5000))::BIGINT AS capped_chars, (sum(least(length(body), 5000)) // 4)::BIGINT AS tokens FROM notes",
    "role_counts": f"WITH {TURNS} SELECT role, count(*) AS n_turns, count(DISTINCT saga) AS n_sagas FROM turns GROUP BY role",
    "thread_sources": f"WITH {SOURCES} SELECT conv_id, label, coalesce(created_at, '2026-01-01T00:00:00Z') AS created_at, length(raw_content)::INT AS n FROM sources WHERE source = 'assistant-thread' AND label NOT IN ('users', 'memories', 'projects', 'conversations') AND length(raw_content) > 100",
    "source_lookup": f"WITH {SOURCES} SELECT conv_id, label, length(raw_content)::INT AS n FROM sources WHERE label ILIKE 'CONV 1%' ORDER BY label LIMIT 1",
    "episode_check": f"WITH {NOTES} SELECT count(*) FILTER (name LIKE 'src1%') AS n_good, count(DISTINCT CASE WHEN name LIKE 'src1%' THEN name || body END) AS n_ids, count(*) FILTER (name NOT LIKE 'src1%') AS n_bad FROM notes",
    "import_rollup": f"WITH {NOTES} SELECT CASE WHEN name LIKE 'src1%' THEN 'ok' ELSE 'failed' END AS status, CASE WHEN name NOT LIKE 'src1%' THEN 'time' END AS reason, count(*) AS n FROM notes GROUP BY 1, 2",
    "search_sources_limit": f"WITH {SOURCES} SELECT conv_id, label, created_at FROM sources WHERE source = 'search-thread' AND length(raw_content) > 200 ORDER BY created_at NULLS FIRST, conv_id LIMIT 20",
    "search_thread_extract": """WITH f AS (SELECT conv_id, role, arg_min(text, turn) AS text FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1, 2)
SELECT 'conv ' || conv_id AS label, 'Query' AS name, 'user: ' || substring(text, 1, 2000) AS body, 0::INT AS turn_index FROM f WHERE role = 'user' AND length(text) > 10
UNION ALL SELECT 'conv ' || conv_id, 'Answer', 'assistant: ' || substring(text, 1, 3000), 1 FROM f WHERE role = 'assistant' AND length(text) > 50""",
    "preview_projection": f"WITH {EDGES} SELECT uuid, substring(fact, 1, 20) AS fact, substring(target_name, 1, 10) AS name FROM edges",
    "vector_topk": nearest("{}.embedding", 10),
    "bm25_topk": f"WITH {DOCS}, {bm25(['the', 'thing', 'trash'])} SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM scores QUALIFY rank <= 10",
    "hybrid_rrf": f"""WITH {DOCS}, {bm25(['the', 'thing', 'trash'])}, b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scores QUALIFY rank <= 50), v AS ({nearest('{}.embedding', 50)}),
fused AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT id, rank FROM b UNION ALL SELECT id, rank FROM v) GROUP BY id) SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM fused QUALIFY rank <= 10""",
    "search_edges": f"WITH {EDGES}, texts AS (SELECT uuid AS id, fact AS text FROM edges), {hybrid(['red', 'widget'])} SELECT id, score, rank::INT AS rank, name, fact, source_name, target_name, strftime(valid_at, '%Y-%m-%dT%H:%M:%S') AS created_at, {iso('valid_at')}, {iso('invalid_at')}, {iso('expired_at')}, episodes FROM top JOIN edges ON uuid = id",
    "search_nodes": f"WITH {ENTITIES}, texts AS (SELECT uuid AS id, name || ' ' || summary AS text FROM ents), {hybrid(['red', 'widget'])} SELECT id, score, rank::INT AS rank, name FROM top JOIN ents ON uuid = id",
    "passthrough_rank": f"WITH {EDGES}, texts AS (SELECT uuid AS id, fact AS text FROM edges), {bm25(['red', 'widget'])} SELECT id AS uuid, rank::INT AS rank, round(1 - 0.01::DOUBLE * (rank - 1), 2) AS score FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scores) WHERE rank <= 120",
    "text_vectors": f"""WITH {ENTITIES}, texts AS (SELECT uuid AS id, name || ' ' || summary AS text FROM ents), {TOKENS}, {vectors_of(['blue', 'gear', 'standard'])},
best AS (SELECT array_to_string(words, ' ') AS words, score FROM near JOIN dt USING (t)) SELECT * FROM best WHERE score >= (SELECT min(score) FROM (SELECT score FROM best ORDER BY score DESC LIMIT 40))""",
    "history_search": f"""WITH {EDGES}, texts AS (SELECT uuid AS id, fact AS text FROM edges), {bm25(['red', 'widget'])}, {vectors_of(['red', 'widget'])},
split AS (SELECT uuid AS id, CASE WHEN {_CURRENT} THEN 'current' WHEN invalid_at IS NOT NULL AND valid_at <= {_T} THEN 'superseded' END AS bucket FROM edges),
lists AS (SELECT id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, id) AS r FROM scores JOIN split USING (id) WHERE bucket IS NOT NULL
  UNION ALL SELECT id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, id) FROM dense JOIN split USING (id) WHERE bucket IS NOT NULL),
f AS (SELECT id, bucket, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM lists WHERE r <= 50 GROUP BY ALL)
SELECT id AS uuid, bucket, score, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, id)::INT AS rank FROM f QUALIFY rank <= 10""",
    "ingest_supersession": f"WITH {EDGES} SELECT uuid, target_uuid, {iso('valid_at')}, {iso('invalid_at')} FROM edges",
    "asof_periods": f"WITH {EDGES} SELECT name, count(*) AS n, count(DISTINCT target_uuid) AS n_targets, min(uuid) AS first_uuid FROM edges WHERE {_CURRENT} GROUP BY name",
    "reach_4hops": f"""WITH {ENTITIES}, {EDGES}, w AS (SELECT DISTINCT source_uuid AS node, target_uuid AS other FROM edges WHERE expired_at IS NULL), ways AS MATERIALIZED (FROM w UNION SELECT other, node FROM w),
l0 AS (SELECT uuid, [uuid] AS path FROM ents WHERE uuid IN ('S:1', 'S:2')), {", ".join(f"l{i} AS MATERIALIZED (SELECT other AS uuid, list_append(min(path), other) AS path FROM ways JOIN l{i - 1} ON node = uuid WHERE other NOT IN ({' UNION ALL '.join(f'SELECT uuid FROM l{j}' for j in range(i))}) GROUP BY other)" for i in range(1, 5))}
{" UNION ALL ".join(f"SELECT uuid, {i}::INT AS hop, array_to_string(path, ' ') AS path FROM l{i}" for i in range(5))}""",
    "source_fulltext": f"""WITH {DOCS}, {bm25(['stupid', 'trash'])}, forms AS (SELECT id, score, 0 AS form FROM scores
UNION ALL SELECT id, coalesce(score, 0), 1 FROM texts LEFT JOIN scores USING (id) WHERE contains(lower(text), 'stupid trash'))
SELECT id, form::INT AS form, score, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM forms WHERE form = (SELECT min(form) FROM forms) QUALIFY rank <= 5""",
    "token_counts": f"WITH {DOCS}, {TOKENS} SELECT term, count(*) AS n FROM (SELECT unnest(words) AS term FROM toks) GROUP BY term",
    "lpa_rounds": f"WITH {labels()} SELECT uuid, label FROM labels",
    "community_size_bands": f"WITH {labels()} SELECT CASE WHEN n < 2 THEN 'single' WHEN n > 100 THEN 'mega' ELSE 'useful' END AS band, count(*) AS n_communities, sum(n)::BIGINT AS n_members FROM sizes GROUP BY 1",
    "community_sizes": f"WITH {labels()} SELECT label, n FROM sizes WHERE n BETWEEN 2 AND 100 ORDER BY n DESC, label LIMIT 50",
    "community_size_dist": f"""WITH {labels()}, placed AS (SELECT n, row_number() OVER (ORDER BY n DESC) - 1 AS i, count(*) OVER () AS total FROM sizes)
SELECT max(total) AS n_communities, max(n) AS greatest, min(n) AS least, max(n) FILTER (i = total // 2) AS median, string_agg(n::VARCHAR, ',' ORDER BY i) FILTER (i < 5) AS top5 FROM placed""",
    "community_members": f"WITH {labels()} SELECT labels.label AS community, count(DISTINCT uuid) AS n_members, min(name) AS first_name FROM labels JOIN ents USING (uuid) GROUP BY labels.label HAVING count(DISTINCT uuid) >= 2",
    "community_build": f"WITH {BUILT} SELECT * FROM built",
    "list_communities": f"WITH {BUILT} SELECT 'C:' || label AS uuid, name, summary FROM built",
    "entity_resolution": f"WITH {ENTITIES}, {NOTES}, {RESOLVED} SELECT * FROM resolved",
    "orphans_in_communities": f"WITH {labels()} SELECT count(DISTINCT uuid) AS n_orphans FROM labels WHERE uuid NOT IN (SELECT node FROM ways)",
    "similar_pairs": f"WITH {planted_pairs(0.75)} SELECT a, b, round(raw, 6) AS score FROM pairs",
    "knn_topk": f"SELECT q AS query, id, score, rank::INT AS rank FROM (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM (SELECT q.vec_id AS q, e.vec_id AS id, round({COSINE.format(a='e.embedding', b='q.embedding')}, 6) AS score FROM embeddings e JOIN embeddings q ON e.vec_id <> q.vec_id AND q.vec_id % 100 = 0)) WHERE rank <= 3",
    "normalize_vectors": """WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-10))[1:32] AS e FROM embeddings)
SELECT id, len(e)::INT AS n, round(sqrt(list_dot_product(e, e)), 6) AS length, round(e[1], 6) AS first FROM v""",
    "embedder_overlap": f"""WITH f AS ({nearest('{}.embedding[1:32]', 30)}), s AS ({nearest('{}.embedding[33:64]', 30)})
SELECT 'both' AS side, id FROM f WHERE id IN (SELECT id FROM s) UNION ALL SELECT 'first', id FROM f WHERE id NOT IN (SELECT id FROM s) UNION ALL SELECT 'second', id FROM s WHERE id NOT IN (SELECT id FROM f)""",
    "embedder_facts": f"""WITH s AS (SELECT 'first' AS side, vec_id AS id, embedding[1:32] AS embedding FROM embeddings UNION ALL SELECT 'second', vec_id, embedding[33:64] FROM embeddings),
r AS (SELECT q.side, q.id AS query, e.id, round({COSINE.format(a='e.embedding', b='q.embedding')}, 6) AS score FROM s q JOIN s e ON e.side = q.side AND e.id <> q.id WHERE q.id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY side, query ORDER BY score DESC, id) AS rank FROM r)
SELECT side, query, id, score, rank::INT AS rank, substring(text, 1, 40) AS fact FROM p LEFT JOIN documents ON doc_id = id WHERE rank <= 3""",
    "near_dup_nodes": f"WITH {planted_pairs(0.92)} SELECT b AS id, min(a) AS keeper FROM pairs WHERE a_kind = b_kind GROUP BY b",
    "segment_windows": f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 2 HOURS OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS window_no FROM g)
SELECT user_id, window_no::INT AS window_no, count(*) AS n, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS ended FROM n GROUP BY 1, 2 HAVING count(*) >= 2""",
    "segment_enrich": r"""SELECT doc_id AS id, lang AS source, md5(CASE lang WHEN 'en' THEN '[english note] ' WHEN 'de' THEN '[german note] ' ELSE '' END || text) AS enriched_md5 FROM documents
WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) >= CASE lang WHEN 'en' THEN 30 WHEN 'de' THEN 15 WHEN 'fr' THEN 20 ELSE 10 END""",
    "recurrence_flags": f"""WITH {planted_pairs(0.3)}, {PLANTED_TIMES}, b AS (SELECT a AS id, b AS other, b_kind AS kind, round(raw, 6) > 0.85::DOUBLE AS near FROM pairs WHERE a_kind <> b_kind UNION ALL SELECT b, a, a_kind, round(raw, 6) > 0.85::DOUBLE FROM pairs WHERE a_kind <> b_kind),
own AS (SELECT * FROM b UNION ALL SELECT DISTINCT id, id, NULL, true FROM b),
t AS (SELECT own.id, count(DISTINCT kind) + 1 AS n_sources, date_diff('day', min(ts)::DATE, max(ts)::DATE)::INT AS days, count(DISTINCT kind) FILTER (near) + 1 AS near_sources,
  date_diff('day', (min(ts) FILTER (near))::DATE, (max(ts) FILTER (near))::DATE)::INT AS near_days FROM own JOIN made ON event_id = other GROUP BY own.id)
SELECT *, n_sources >= 3 AND days >= 14 AS promoted, near_sources >= 3 AND near_days >= 14 AS near_promoted FROM t""",
    "contradiction_flags": rf"WITH {planted_pairs(0.3)}, {PLANTED_TEXTS} SELECT b AS id, a AS other, round(raw, 6) AS score, round(raw, 6) > 0.75::DOUBLE AS near FROM pairs JOIN told ON doc_id = b WHERE regexp_matches(lower(text), '\b(not|wrong|actually|changed my mind|i used to think)\b')",
    "saga_import": """WITH t AS (SELECT 'conv ' || conv_id AS saga, turn, text, len(text) >= 20 AS good FROM conversations),
w AS (SELECT DISTINCT saga, turn, unnest(string_split(text, ' ')) AS word FROM t WHERE good), f AS (SELECT saga, min(turn) AS turn, word FROM w GROUP BY saga, word), n AS (SELECT saga, turn, count(*) AS n FROM f GROUP BY ALL)
SELECT saga, turn::INT AS turn_index, CASE WHEN good THEN 'ok' ELSE 'failed' END AS status, CASE WHEN NOT good THEN 'short' END AS reason, CASE WHEN good THEN coalesce(n, 0) END AS n_new FROM t LEFT JOIN n USING (saga, turn)""",
    "thread_components": f"""WITH RECURSIVE {pairs(0.32)}, near AS (SELECT a, b FROM pairs WHERE round(raw, 6) + CASE WHEN a_kind <> b_kind THEN 0.08::DOUBLE ELSE 0 END > 0.4::DOUBLE), e AS (SELECT a, b FROM near UNION SELECT b, a FROM near), r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT node, min(seen) AS component FROM r GROUP BY node""",
    "thread_states": f"WITH {THREADS} SELECT thread_id, n_done, n_acted, n_decided, n_compared, idle_days, state, CASE state WHEN 'exploring' THEN 'gather' WHEN 'evaluating' THEN 'compare' WHEN 'decided' THEN 'plan' WHEN 'acting' THEN 'continue' WHEN 'stalled' THEN 'unblock' ELSE 'none' END AS action FROM states",
    "threads_by_state": f"WITH {THREADS} SELECT state, count(*) AS n FROM states GROUP BY state",
    "delivery_gate": f"""WITH {THREADS}, s AS (SELECT thread_id, idle_days, round(n / 100 + 0.08::DOUBLE * (n_sources - 1), 6) AS score FROM states WHERE idle_days BETWEEN 7 AND 30 AND n_compared = 0)
SELECT thread_id, score, idle_days, row_number() OVER (ORDER BY score DESC, thread_id)::INT AS rank FROM s QUALIFY rank <= 5""",
    "ppp_metrics": """SELECT count(*) AS surfaced, round(count(*) FILTER (event_type = 'purchase') / count(*), 6) AS productivity, round(count(*) FILTER (value > 10) / count(*), 6) AS proactivity,
round(1 - count(*) FILTER (event_type = 'error') / count(*), 6) AS personalization, count(*) < 20 OR count(*) FILTER (event_type = 'error') / count(*) < 0.3 AS gate FROM events""",
    "mention_trajectory": """WITH c AS (SELECT event_type, date_trunc('day', ts) AS bucket, count(*) AS n FROM events GROUP BY 1, 2), d AS (SELECT *, n - lag(n) OVER (PARTITION BY event_type ORDER BY bucket) AS change FROM c)
SELECT event_type, strftime(bucket, '%Y-%m-%dT%H:%M:%S') AS bucket, n, change, CASE WHEN change > 0 THEN 'acceleration' WHEN change < 0 THEN 'decay' WHEN change = 0 THEN 'plateau' END AS trend FROM d""",
    "intention_gap": "SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 60)",
    "confidence_scores": "SELECT user_id AS id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + sum(CASE WHEN event_type = 'purchase' THEN 0.1::DOUBLE ELSE -0.15::DOUBLE END))), 6) AS confidence FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id",
    "decay_scores": f"WITH {THREADS} SELECT thread_id, round(n::DOUBLE * exp(-0.05::DOUBLE * (date_diff('second', date_trunc('second', last_at), {NOW}) / 86400.0::DOUBLE)), 6) AS strength FROM states",
    "stall_scores": f"WITH {THREADS} SELECT thread_id, CASE WHEN n_acted > 0 AND n_done = 0 AND idle_days >= 7 AND n_sources > 1 THEN 0.8::DOUBLE WHEN n_acted > 0 THEN 0.6 ELSE 0 END AS stall_score FROM states",
    "boilerplate_filter": r"""WITH k AS (SELECT doc_id AS id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: len(regexp_split_to_array(trim(x, ' '), '\s+')) >= 3 AND NOT regexp_matches(lower(x), 'unsubscribe|click here|rates? (?:may|are subject)|https?://\S+(?:\s+https?://\S+){2,}')), chr(10)) AS text FROM documents)
SELECT id, length(text)::INT AS n, md5(text) AS text_md5 FROM k""",
    "desire_levels": f"WITH {THREADS}, s AS (SELECT thread_id, date_diff('day', first_at::DATE, last_at::DATE)::INT AS days, n FROM threads) SELECT *, CASE WHEN days >= 30 AND n >= 10 THEN 'terminal' WHEN days >= 7 OR n >= 5 THEN 'instrumental' ELSE 'immediate' END AS level FROM s",
    "load_gates": """WITH w AS (SELECT time_bucket(INTERVAL 10 MINUTES, ts) - to_minutes(10 * i) AS started, event_type, ts FROM events CROSS JOIN range(6) r(i))
SELECT strftime(started, '%Y-%m-%dT%H:%M:%S') AS started, count(DISTINCT event_type) AS n_sources, count(*) AS n, count(DISTINCT event_type) > 3 AS busy, count(DISTINCT event_type) = 1 AND max(ts) - min(ts) > INTERVAL 30 MINUTES AS single FROM w GROUP BY w.started""",
    "idle_gates": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 2 HOURS OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS window_no FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS ended, count(*) AS n FROM n GROUP BY user_id, window_no HAVING count(*) >= 3 AND TIMESTAMP '2024-02-01 00:00:00' - max(ts) > INTERVAL 2 HOURS""",
    "conversation_states": rf"""WITH {TURNS}, f AS (SELECT saga AS thread_id, {', '.join(rf"count(*) FILTER (regexp_matches(lower(content), '(^|\s){w}\s')) AS {f}" for f, w in (('n_done', 'this'), ('n_acted', 'for'), ('n_decided', 'was'), ('n_compared', 'to')))},
  date_diff('day', max(coalesce(created_at, '2026-01-01T00:00:00Z')[1:10])::DATE, DATE '2026-01-04')::INT AS idle_days FROM turns GROUP BY saga) SELECT *, {STATE} AS state FROM f""",
    "supplier_states": f"""WITH {EDGES}, f AS (SELECT source_uuid AS thread_id, 0::BIGINT AS n_done, count(*) FILTER (name = 'N') AS n_acted, count(*) FILTER (name = 'A') AS n_decided, count(*) FILTER (name = 'R') AS n_compared,
  date_diff('day', max(valid_at)::DATE, DATE '2001-11-08')::INT AS idle_days FROM edges GROUP BY source_uuid) SELECT *, {STATE} AS state FROM f""",
}
