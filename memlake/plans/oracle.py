"""DuckDB SQL of the memory queries, written from the semantics and not from the Spark plans."""

from __future__ import annotations

from memlake.functions import phrases as P
from memlake.plans import fixtures as X

EPOCH = 1_700_000_000_000


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _count(text: str, phrases: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {_quoted(p)}) AS INTEGER)" for p in phrases) + ")"


def _any(text: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_quoted(p)})" for p in phrases) + ")"


def _importance(c: str) -> str:
    months = "|".join(P.MONTHS)
    return f"""least(1.0::double, greatest(0.0::double, floor((
      0.5::double + {_count(f"lower({c})", P.HIGH_SIGNAL)} * 0.08::double - {_count(f"lower({c})", P.LOW_SIGNAL)} * 0.08::double
      + CASE WHEN regexp_matches({c}, '(?i)\\b(\\d{{4}}-\\d{{2}}-\\d{{2}}|{months})\\b') THEN 0.07::double ELSE 0.0::double END
      + CASE WHEN regexp_matches({c}, '\\$[\\d,]+|\\d+%|\\b\\d{{4,}}\\b') THEN 0.05::double ELSE 0.0::double END
      + CASE WHEN length({c}) > 200 THEN 0.05::double ELSE 0.0::double END
      - CASE WHEN length({c}) < 30 THEN 0.05::double ELSE 0.0::double END) * 100 + 0.5) / 100))"""


def _keyword(c: str, query: str) -> str:
    words = f"regexp_split_to_array(lower({c}), '\\s+')"
    def tf(t: str) -> str:
        return f"(CAST(len(list_filter({words}, lambda w: contains(w, {_quoted(t)}))) AS DOUBLE) / len({words}))"
    parts = [f"{tf(t)} * ln(1 + 10.0::double / (1 + {tf(t)} * 10))" for t in query.lower().split() if len(t) > 2]
    return f"least(1.0::double, ({' + '.join(parts)}) * 5)"


def _sum(parts: str) -> str:
    return f"list_reduce({parts}, lambda a, x: a + x)"


def _cosine(a: str, b: str) -> str:
    n = lambda v: f"sqrt({_sum(f'list_transform({v}, lambda x: x * x)')})"
    return f"({_sum(f'list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2])')} / ({n(a)} * {n(b)}))"


MEM = f"""mem AS (
  SELECT *, substr(sha256(owner_id || ':' || text || ':' || CAST(ts_ms AS VARCHAR)), 1, 16) AS id, text AS content,
    CASE WHEN turn % 7 = 6 THEN 'archived' WHEN turn % 5 = 4 THEN 'long_term' ELSE 'working' END AS tier,
    CASE WHEN turn % 6 = 5 THEN 'superseded' WHEN (conv_id + turn) % 11 = 7 THEN 'contradicted' ELSE 'active' END AS status,
    CAST((conv_id * 7 + turn * 3) % 10 AS DOUBLE) / 10 AS importance, 0.5::double + CAST(turn % 3 AS DOUBLE) * 0.15::double AS certainty,
    turn % 3 AS reinforcement_count, CASE WHEN turn % 3 > 0 THEN ts_ms + (turn % 3) * 500 END AS last_verified_ms, (conv_id * 8 + turn) % 503 AS vec_id
  FROM (SELECT *, CAST(conv_id AS VARCHAR) AS owner_id, {EPOCH} + conv_id * 1000000 + turn * 1000 AS ts_ms FROM conversations)
)"""
USERS = f"""users AS (
  SELECT *, substr(sha256(owner_id || ':' || text || ':' || CAST(ts_ms AS VARCHAR)), 1, 16) AS id, text AS content,
    CASE WHEN doc_id % 3 = 0 THEN 'assistant' ELSE 'user' END AS role,
    CASE WHEN doc_id % 9 = 8 THEN 'archived' WHEN doc_id % 4 = 3 THEN 'long_term' ELSE 'working' END AS tier
  FROM (SELECT *, source AS owner_id, {EPOCH} + doc_id * 1000 AS ts_ms FROM documents)
)"""
VECS = "vecs AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
Q = "q AS (SELECT v AS qv FROM vecs WHERE vec_id = 3)"
NEWEST = "row_number() OVER (PARTITION BY owner_id ORDER BY ts_ms DESC, id)"
LIVE = "tier IN ('working', 'long_term')"


def _recall(limit: int, where: str, query: str, vectors: bool, prefix: str = "") -> str:
    """CTEs up to ``{prefix}fused``: owner_id, id, content, certainty, position, score."""
    p = prefix
    meaning = ", row_number() OVER (PARTITION BY owner_id ORDER BY blend DESC, recency) AS by_meaning" if vectors else ""
    lists = ["by_meaning"] * vectors + ["by_keyword", "by_recency"]
    kept = ", ".join(f"CASE WHEN {c} <= {limit} THEN {c} END AS {c}" for c in lists)
    score = " + ".join(f"coalesce(1.0::double / (60 + {c}), 0.0::double)" for c in lists)
    first = "CASE " + " ".join(f"WHEN {c} IS NOT NULL THEN {k}" for k, c in enumerate(lists)) + " END"
    scored = f"""SELECT c.*, {_keyword("content", query)} AS keyword{", coalesce(" + _cosine("qv", "v") + ", 0.0::double) AS similarity" if vectors else ""}
      FROM {p}cand c{" LEFT JOIN vecs USING (vec_id) CROSS JOIN q" if vectors else ""}"""
    return f"""{p}cand AS (SELECT * FROM (SELECT *, {NEWEST} AS recency FROM mem WHERE status = 'active' AND {where}) WHERE recency <= {3 * limit}),
    {p}scored AS (SELECT *{", similarity * 0.6::double + importance * 0.2::double + certainty * 0.2::double AS blend" if vectors else ""} FROM ({scored})),
    {p}ranked AS (SELECT *, recency AS by_recency, CASE WHEN keyword > 0 THEN row_number() OVER (PARTITION BY owner_id ORDER BY CASE WHEN keyword > 0 THEN keyword END DESC NULLS LAST, recency) END AS by_keyword{meaning} FROM {p}scored),
    {p}cut AS (SELECT * EXCLUDE ({", ".join(lists)}), {kept} FROM {p}ranked),
    {p}sums AS (SELECT *, {score} AS score, {first} AS flist, coalesce({", ".join(lists)}) AS fplace FROM {p}cut WHERE {first} IS NOT NULL),
    {p}fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY score DESC, flist, fplace) AS position FROM {p}sums) WHERE position <= {limit})"""


def _user_like(query: str) -> str:
    return "(" + " OR ".join(f"lower(content) LIKE {_quoted('%' + t + '%')}" for t in query.lower().split() if len(t) > 2) + ")"


QUERY, USER_QUERY = "the tion and", "haha en_"
USER_TOP = f"utop AS (SELECT * FROM (SELECT *, {NEWEST} AS position FROM users WHERE {LIVE} AND {_user_like(USER_QUERY)}) WHERE position <= {{k}})"
TRIPLES = """triples AS (
  SELECT c_mktsegment AS session_id, 'm' || CAST(c_custkey AS VARCHAR) AS memory_id, c_custkey AS seq, lower(c_name) AS f, 'in_nation' AS r, lower(n_name) AS t
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT c_mktsegment, 'm' || CAST(c_custkey AS VARCHAR), c_custkey, lower(n_name), 'in_region', lower(r_name)
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), edges AS (
  SELECT *, substr(sha256(session_id || ':' || f || ':' || r || ':' || t), 1, 16) AS id FROM (
    SELECT session_id, f, r, t, max_by(memory_id, seq) AS memory_id FROM triples GROUP BY ALL)
), nodes AS (
  SELECT session_id, e AS entity, min(seq) AS created_ms FROM (SELECT session_id, f AS e, seq FROM triples UNION ALL SELECT session_id, t, seq FROM triples) GROUP BY ALL
), looked AS (
  SELECT session_id, 'nation_3' AS entity, 'outgoing' AS type, r AS relation, t AS target, 0.9::double AS confidence, memory_id FROM edges WHERE f = 'nation_3'
  UNION ALL SELECT session_id, 'nation_3', 'incoming', r, f, 0.9::double, memory_id FROM edges WHERE t = 'nation_3'
)"""
OPS = """ops AS (
  SELECT user_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 ELSE 3 END AS op, ts, event_id FROM events WHERE event_type IN ('purchase', 'error', 'signup')
), folded AS (
  SELECT user_id, list_reduce(list_prepend(0.5::double, list(CAST(op AS DOUBLE) ORDER BY ts, event_id)),
      lambda a, x: CASE WHEN x = 1 THEN least(1.0::double, a + 0.15::double) WHEN x = 2 THEN greatest(0.0::double, a - 0.25::double) ELSE a END) AS certainty,
    count(*) FILTER (op = 1) AS reinforcement_count,
    coalesce(CASE max_by(op, (ts, event_id)) FILTER (op <> 1) WHEN 2 THEN 'contradicted' WHEN 3 THEN 'superseded' END, 'active') AS status
  FROM ops GROUP BY user_id
)"""
CL = X.values(X.CLAIM_ROWS, X.COLUMNS, X.KINDS)
TRIM = lambda c: f"regexp_replace(regexp_replace({c}, '^\\s+', ''), '\\s+$', '')"
IN = lambda xs: "(" + ", ".join(map(_quoted, xs)) + ")"
_PRONOUN = f"CASE WHEN lower({TRIM('subject_text')}) IN {IN(P.PRONOUNS)} THEN 'pronoun_subject' WHEN lower({TRIM('object_text')}) IN {IN(P.PRONOUNS)} THEN 'pronoun_object' END"
_TEMPORAL = "CASE WHEN coalesce(try_cast(normalized_end AS TIMESTAMP) < try_cast(normalized_start AS TIMESTAMP), false) OR (relation_type IS NOT NULL AND relation_to_event IS NULL) THEN 'temporal_invalid' END"
_VAGUE = f"CASE WHEN length(canonical_text) < 10 OR trim(predicate) = '' OR lower({TRIM('object_text')}) IN {IN(P.FILLERS)} THEN 'vague_claim' END"
_INFER = "CASE WHEN coalesce(explicitness = 'inferred' AND extraction_confidence < 0.6, false) THEN 'low_confidence_inference' END"
ENTS = X.values(X.ENTITY_ROWS, ["window_id", "id"], ["string", "string"])
_ENTITY = f"CASE WHEN NOT EXISTS (SELECT 1 FROM {ENTS} e WHERE e.window_id = c.window_id AND e.id = c.subject_entity_id) OR (object_entity_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {ENTS} e WHERE e.window_id = c.window_id AND e.id = c.object_entity_id)) THEN 'dangling_entity' END"


def _atomic(source: str) -> str:
    """Rows (all columns, id, canonical_text, object_text, reason) after splitting; ``source`` has ``reason``."""
    connector = "coalesce(" + ", ".join(f"CASE WHEN contains(lower(canonical_text), '{c}') THEN '{c}' END" for c in P.CONNECTORS) + ")"
    cut = lambda x: f"regexp_replace(regexp_replace({x}, '^[\\s,;]+', ''), '[\\s,;]+$', '')"
    return f"""SELECT * REPLACE (
        CASE WHEN k >= 0 THEN id || '_split' || CAST(k AS VARCHAR) ELSE id END AS id,
        CASE WHEN k < 0 THEN canonical_text
          WHEN in_object THEN CASE WHEN instr(lower(canonical_text), lower(object_text)) > 0
            THEN substr(canonical_text, 1, instr(lower(canonical_text), lower(object_text)) - 1) || piece || substr(canonical_text, instr(lower(canonical_text), lower(object_text)) + length(object_text))
            ELSE canonical_text END
          WHEN k = 0 THEN piece
          WHEN starts_with(lower(piece), lower(subject_text)) THEN piece ELSE subject_text || ' ' || piece END AS canonical_text,
        CASE WHEN k < 0 THEN object_text ELSE piece END AS object_text)
      FROM (SELECT *, unnest(ks) AS k, CASE WHEN len(ks) > 0 AND ks[1] >= 0 THEN unnest(ps) END AS piece FROM (
        SELECT * REPLACE (CASE WHEN splits AND NOT in_object AND (length(halves[1]) < 2 OR length(halves[2]) < 2) THEN 'compound_claim' ELSE reason END AS reason),
          CASE WHEN splits AND in_object AND len(fragments) >= 2 THEN list_transform(range(len(fragments)), lambda x: CAST(x AS INTEGER))
            WHEN splits AND NOT in_object AND length(halves[1]) >= 2 AND length(halves[2]) >= 2 THEN [0, 1] ELSE [-1] END AS ks,
          CASE WHEN splits AND in_object AND len(fragments) >= 2 THEN fragments WHEN splits AND NOT in_object AND length(halves[1]) >= 2 AND length(halves[2]) >= 2 THEN halves ELSE [''] END AS ps
        FROM (SELECT *, reason IS NULL AND connector IS NOT NULL AS splits, coalesce(contains(lower(object_text), connector), false) AS in_object,
            list_filter(list_transform(string_split(regexp_replace(object_text, '(?i)' || coalesce(connector, '~~'), chr(1), 'g'), chr(1)), lambda x: {cut("x")}), lambda x: length(x) >= 2) AS fragments,
            [{cut("substr(canonical_text, 1, instr(lower(canonical_text), connector) - 1)")}, {cut("substr(canonical_text, instr(lower(canonical_text), connector) + length(connector))")}] AS halves
          FROM (SELECT *, {connector} AS connector FROM ({source})))))"""


_DUP = "sha256(canonical_text || '|' || subject_entity_id || '|' || predicate)"
_STAGES = f"""SELECT * REPLACE (coalesce(reason, {_VAGUE}) AS reason) FROM (
    SELECT * REPLACE (CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY window_id, {_DUP}, reason IS NULL ORDER BY pos) > 1 THEN 'duplicate' ELSE reason END AS reason) FROM (
      SELECT *, coalesce({_PRONOUN}, {_TEMPORAL}) AS reason FROM {CL}))"""
_SAY = {k: f"CASE explicitness WHEN 'stated' THEN 1.0::double WHEN 'implied' THEN 0.7::double WHEN 'inferred' THEN 0.4::double END" for k in ("explicitness",)}

SQL: dict[str, str] = {
    "keyword_score": f"WITH {MEM} SELECT id, round({_keyword('content', QUERY)}, 12) AS score FROM mem",
    "recency_topn": f"WITH {MEM} SELECT * FROM (SELECT owner_id, id, {NEWEST} AS position, ts_ms FROM mem WHERE status = 'active' AND {LIVE}) WHERE position <= 3",
    "history": f"WITH {MEM}, n AS (SELECT * FROM (SELECT *, {NEWEST} AS p FROM mem) WHERE p <= 5) SELECT owner_id, id, row_number() OVER (PARTITION BY owner_id ORDER BY ts_ms, id DESC) AS position, content, 0.5::double AS certainty, 'active' AS status FROM n",
    "recall_keyword_recency": f"WITH {MEM}, {_recall(3, LIVE, QUERY, False)} SELECT owner_id, id, position, score FROM fused",
    "recall_no_query": f"WITH {MEM} SELECT * FROM (SELECT owner_id, id, {NEWEST} AS position FROM mem WHERE status = 'active' AND {LIVE}) WHERE position <= 4",
    "importance_heuristic": f"WITH {USERS} SELECT id, {_importance('content')} AS importance FROM users",
    "importance_cases": f"SELECT n, {_importance('content')} AS importance FROM {X.values(list(enumerate(X.TEXTS)), ['n', 'content'], ['bigint', 'string'])}",
    "cosine_topk": f"WITH {VECS}, {Q} SELECT vec_id, {_cosine('qv', 'v')} AS score FROM vecs CROSS JOIN q ORDER BY score DESC, vec_id LIMIT 10",
    "euclidean_topk": f"WITH {VECS}, {Q} SELECT vec_id, sqrt({_sum('list_transform(list_zip(qv, v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))')}) AS distance FROM vecs CROSS JOIN q ORDER BY distance, vec_id LIMIT 10",
    "vector_threshold_search": f"WITH {VECS}, {Q} SELECT CAST(label AS VARCHAR) AS owner_id, vec_id, {_cosine('qv', 'v')} AS score FROM vecs JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id) CROSS JOIN q WHERE score >= 0.1::double ORDER BY score DESC, CAST(vec_id AS VARCHAR) LIMIT 25",
    "agent_list": "SELECT * FROM (SELECT CAST(label AS VARCHAR) AS owner_id, CAST(vec_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS position FROM embeddings) WHERE position <= 5",
    "semantic_rank_blend": f"WITH {MEM}, {VECS}, {Q} SELECT id, coalesce({_cosine('qv', 'v')}, 0.0::double) * 0.6::double + importance * 0.2::double + certainty * 0.2::double AS blend FROM mem LEFT JOIN vecs USING (vec_id) CROSS JOIN q",
    "recall_hybrid_rrf": f"WITH {MEM}, {VECS}, {Q}, {_recall(3, LIVE, QUERY, True)} SELECT owner_id, id, position, score, similarity FROM fused",
    "recall_filtered": f"WITH {MEM}, {_recall(2, f'''tier = 'working' AND role = 'user' AND ts_ms >= {EPOCH + 1000} AND ts_ms <= {EPOCH + 400_000_000}''', QUERY, False)} SELECT owner_id, id, position, score FROM fused",
    "recall_user_keyword": f"WITH {USERS}, {USER_TOP.format(k=4)} SELECT owner_id, id, position FROM utop",
    "recall_user_vector": f"WITH {USERS}, {VECS}, {Q} SELECT owner_id, id, position, similarity FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY similarity DESC, ts_ms DESC, id) AS position FROM (SELECT u.*, coalesce({_cosine('qv', 'v')}, 0.0::double) AS similarity FROM users u LEFT JOIN vecs ON doc_id = vec_id CROSS JOIN q WHERE {LIVE})) WHERE position <= 4",
    "recall_blend_user": f"""WITH {MEM}, {USERS}, {USER_TOP.format(k=3)}, {_recall(6, LIVE, QUERY, False)},
      parts AS (SELECT owner_id, id, 0 AS part, position, false AS user_memory FROM fused
        UNION ALL SELECT o.owner_id, u.id, 1, u.position, true FROM (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS owner_id, 'src' || CAST(conv_id % 20 AS VARCHAR) AS user_id FROM conversations) o
          JOIN utop u ON u.owner_id = o.user_id WHERE NOT EXISTS (SELECT 1 FROM fused f WHERE f.owner_id = o.owner_id AND f.content = u.content))
      SELECT owner_id, id, p AS position, user_memory FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY part, position) AS p FROM parts) WHERE p <= 6""",
    "reflect_order": f"WITH {MEM}, {VECS}, {Q}, {_recall(5, LIVE, QUERY, True)}, w AS (SELECT *, similarity * 0.6::double + certainty * 0.4::double AS weight FROM fused) SELECT owner_id, id, row_number() OVER (PARTITION BY owner_id ORDER BY weight DESC, position) AS position, weight FROM w",
    "belief_fold": f"WITH {OPS} SELECT CAST(user_id AS VARCHAR) AS owner_id, certainty, reinforcement_count FROM folded",
    "belief_status": f"WITH {OPS} SELECT status, count(*) AS n FROM folded GROUP BY status",
    "timeline_events": f"""WITH {MEM}, old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY ts_ms, id) AS n FROM mem) WHERE n <= 6),
      ev AS (SELECT owner_id, id, n, 0 AS part, CASE WHEN tier = 'long_term' THEN 'consolidated' ELSE 'created' END AS event, ts_ms AS event_ms, certainty, importance FROM old
        UNION ALL SELECT owner_id, id, n, 1, status, ts_ms + 1, certainty, NULL FROM old WHERE status <> 'active'
        UNION ALL SELECT owner_id, id, n, 2, 'reinforced', coalesce(last_verified_ms, ts_ms), certainty, NULL FROM old WHERE reinforcement_count > 0)
      SELECT owner_id, id AS memory_id, row_number() OVER (PARTITION BY owner_id ORDER BY event_ms, n, part) AS position, event, event_ms, certainty, importance FROM ev""",
    "forget_before": f"WITH {MEM} SELECT id, tier <> 'archived' AND ts_ms < {EPOCH + 50_003_000} AS gone FROM mem",
    "graph_upsert_edges": f"WITH {TRIPLES} SELECT session_id, id, f AS from_entity, r AS relation, t AS to_entity, 0.9::double AS confidence, memory_id FROM edges",
    "graph_upsert_nodes": f"WITH {TRIPLES} SELECT session_id, substr(sha256(session_id || ':' || entity), 1, 16) AS id, entity, created_ms FROM nodes",
    "graph_lookup": f"WITH {TRIPLES} SELECT session_id, entity, type, relation, target, confidence FROM looked",
    "graph_related_memories": f"WITH {TRIPLES} SELECT DISTINCT session_id, memory_id AS id, c_name || ' ' || c_mktsegment AS content FROM looked JOIN customer ON memory_id = 'm' || CAST(c_custkey AS VARCHAR)",
    "graph_augment": f"""WITH {TRIPLES}, top AS (SELECT * FROM (SELECT c_mktsegment AS owner_id, 'm' || CAST(c_custkey AS VARCHAR) AS id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, 'm' || CAST(c_custkey AS VARCHAR)) AS position FROM customer) WHERE position <= 4),
      near AS (SELECT DISTINCT s.owner_id, s.id AS seed, e2.id AS edge, e2.memory_id FROM top s JOIN edges e1 ON e1.memory_id = s.id JOIN edges e2 ON e2.session_id = s.owner_id AND e2.f IN (e1.f, e1.t) WHERE s.position <= 3),
      few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, seed ORDER BY edge) AS n FROM near) WHERE n <= 5),
      parts AS (SELECT owner_id, id, 0 AS part, position FROM top UNION ALL SELECT DISTINCT owner_id, memory_id, 1, 0 FROM few x WHERE NOT EXISTS (SELECT 1 FROM top t WHERE t.owner_id = x.owner_id AND t.id = x.memory_id))
      SELECT owner_id, id, p AS position, part = 1 AS from_graph FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY part, position, id) AS p FROM parts) WHERE p <= 9""",
    "graph_counts": f"WITH {TRIPLES} SELECT session_id, graph_nodes, graph_edges FROM (SELECT session_id, count(*) AS graph_nodes FROM nodes GROUP BY 1) JOIN (SELECT session_id, count(*) AS graph_edges FROM edges GROUP BY 1) USING (session_id)",
    "session_stats": f"""WITH {MEM} SELECT owner_id, count(*) FILTER (tier <> 'archived') AS total, min(ts_ms) FILTER (tier <> 'archived') AS oldest, max(ts_ms) FILTER (tier <> 'archived') AS newest,
      count(*) FILTER (tier <> 'archived' AND vec_id IN (SELECT vec_id FROM embeddings)) AS with_embeddings, count(*) FILTER (tier = 'working') AS tier_working, count(*) FILTER (tier = 'long_term') AS tier_long_term, count(*) FILTER (tier = 'archived') AS tier_archived FROM mem GROUP BY owner_id""",
    "stats_by_role": f"WITH {MEM} SELECT owner_id, role, count(*) AS n FROM mem WHERE tier <> 'archived' GROUP BY ALL",
    "stats_by_tier": f"WITH {MEM} SELECT owner_id, tier, count(*) AS n FROM mem GROUP BY ALL",
    "user_stats": f"""WITH {USERS} SELECT owner_id, count(*) FILTER (tier <> 'archived') AS total, min(ts_ms) FILTER (tier <> 'archived') AS oldest, max(ts_ms) FILTER (tier <> 'archived') AS newest,
      count(*) FILTER (tier = 'working') AS tier_working, count(*) FILTER (tier = 'long_term') AS tier_long_term, count(*) FILTER (tier = 'archived') AS tier_archived FROM users GROUP BY owner_id""",
    "working_over_threshold": f"WITH {MEM} SELECT owner_id, count(*) AS working FROM mem WHERE tier = 'working' GROUP BY owner_id HAVING count(*) > 3",
    "consolidation_candidates": f"WITH {MEM}, w AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY ts_ms, id) AS place FROM mem WHERE tier = 'working' AND importance < 0.8::double), lim AS (SELECT * FROM w WHERE place <= 5) SELECT owner_id, id, place FROM (SELECT *, count(*) OVER (PARTITION BY owner_id) AS n FROM lim) WHERE place <= n - 2",
    "consolidate_report": f"""WITH {MEM}, w AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY ts_ms, id) AS place, count(*) OVER (PARTITION BY owner_id) AS n FROM mem WHERE tier = 'working' AND importance < 0.8::double),
      picked AS (SELECT owner_id, count(*) AS c FROM w WHERE place <= least(3, n - 2) GROUP BY owner_id)
      SELECT owner_id, archived_rows + coalesce(c, 0) AS archived_rows, rows + CASE WHEN c IS NULL THEN 0 ELSE 1 END AS rows, c AS summarized, CASE WHEN c IS NOT NULL THEN 1 END AS created, c AS archived
      FROM (SELECT owner_id, count(*) FILTER (tier = 'archived') AS archived_rows, count(*) AS rows FROM mem GROUP BY owner_id) LEFT JOIN picked USING (owner_id)""",
    "wake_briefing": f"WITH {USERS}, top AS (SELECT * FROM (SELECT *, {NEWEST} AS position FROM users WHERE {LIVE}) WHERE position <= 3) SELECT owner_id, 'Briefing (' || CAST(count(*) AS VARCHAR) || ' items):' || chr(10) || string_agg('- ' || content, chr(10) ORDER BY position) AS briefing FROM top GROUP BY owner_id",
    "latency_percentiles": "WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, len(v) AS n, v[CAST(floor(len(v) * 0.5::double) AS BIGINT) + 1] AS p50, v[CAST(floor(len(v) * 0.95::double) AS BIGINT) + 1] AS p95, v[CAST(floor(len(v) * 0.99::double) AS BIGINT) + 1] AS p99, v[1] AS least, v[len(v)] AS largest FROM s",
    "accuracy_by_category": "SELECT lang AS category, count(*) AS total, count(*) FILTER (quality = 1) AS correct, avg(CAST(quality = 1 AS INTEGER)) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY lang",
    "claims_pronoun": f"SELECT id, {_PRONOUN} AS reason FROM {CL}",
    "claims_temporal": f"SELECT id, {_TEMPORAL} AS reason FROM {CL}",
    "claims_duplicate": f"SELECT id, CASE WHEN row_number() OVER (PARTITION BY window_id, {_DUP} ORDER BY pos) > 1 THEN 'duplicate' END AS reason FROM {CL}",
    "claims_vague": f"SELECT id, {_VAGUE} AS reason FROM {CL}",
    "claims_atomic_split": f"SELECT id, canonical_text, object_text, reason FROM ({_atomic(f'SELECT *, CAST(NULL AS VARCHAR) AS reason FROM {CL}')})",
    "claims_entity_ref": f"SELECT id, {_ENTITY} AS reason FROM {CL} c",
    "claims_inference": f"SELECT id, {_INFER} AS reason FROM {CL}",
    "claims_pipeline": f"SELECT id, canonical_text, coalesce(reason, {_ENTITY}, {_INFER}) AS reason FROM ({_atomic(_STAGES)}) c",
    "claim_confidence": f"SELECT id, 0.25::double * extraction_confidence + 0.25::double * entity_resolution_confidence + 0.2::double * temporal_resolution_confidence + 0.15::double * ({_SAY['explicitness']}) + 0.1::double * least(CAST(support_count AS DOUBLE) / 5, 1.0::double) + 0.05::double * source_directness AS confidence FROM {CL}",
    "eval_chunk_index": "SELECT conv_id AS window_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS chunk FROM conversations GROUP BY conv_id",
    "eval_topk_context": f"WITH {VECS} SELECT question_id, context_id, score, position FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, context_id) AS position FROM (SELECT a.vec_id AS question_id, b.vec_id AS context_id, {_cosine('a.v', 'b.v')} AS score FROM vecs a CROSS JOIN vecs b WHERE a.vec_id % 20 = 0)) WHERE position <= 3",
    "eval_exact_match": f"SELECT mode, count(*) AS total, avg(CAST(contains(lower(answer), lower(expected)) OR contains(lower(expected), lower(answer)) AS INTEGER)) AS score FROM {X.values(X.ANSWERS, ['mode', 'answer', 'expected'], ['string'] * 3)} GROUP BY mode",
    "temporal_questions": f"SELECT question, {_any('lower(question)', P.TEMPORAL)} AS temporal FROM {X.values([(q,) for q in X.QUESTIONS], ['question'], ['string'])}",
    "streaming_belief": f"WITH {OPS} SELECT CAST(user_id AS VARCHAR) AS owner_id, certainty, reinforcement_count FROM folded",
}


def _tokens(c: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^A-Za-z0-9_]+'), lambda t: length(t) > 3))"


def _overlap(a: str, b: str) -> str:
    return f"(CAST(len(list_intersect({_tokens(a)}, {_tokens(b)})) AS DOUBLE) / greatest(len({_tokens(a)}), len({_tokens(b)}), 1))"


def _contradicts(new: str, old: str) -> str:
    both = " OR ".join(f"(contains(lower({new}), '{p}') AND contains(lower({old}), '{p}'))" for p in P.PREFERENCES)
    return f"({_overlap(new, old)} > 0.3::double AND ({both}) AND {_any(f'lower({new})', P.NEGATORS)} <> {_any(f'lower({old})', P.NEGATORS)})"


SQL["contradiction_cases"] = f"SELECT id, {_overlap('new', 'old')} AS similarity, {_contradicts('new', 'old')} AS detected FROM {X.values(X.STATEMENTS, ['id', 'old', 'new'], ['string'] * 3)}"
SQL["contradiction_heuristic"] = f"""WITH {MEM}, said AS (SELECT owner_id, 'I don''t hate that: ' || arg_max(content, (ts_ms, id)) AS statement FROM mem WHERE content <> '' GROUP BY owner_id),
  recent AS (SELECT * FROM (SELECT *, {NEWEST} AS p FROM mem WHERE status = 'active' AND tier <> 'archived') WHERE p <= 20)
  SELECT owner_id, r.id AS memory_id, {_overlap('statement', 'content')} AS similarity, certainty FROM said JOIN recent r USING (owner_id) WHERE {_contradicts('statement', 'content')}"""
