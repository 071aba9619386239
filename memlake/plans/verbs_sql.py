"""DuckDB SQL of the queries in ``verbs``, written from the semantics and not from the Spark plans."""

from __future__ import annotations

from memlake.plans import oracle as O
from memlake.plans.oracle import EPOCH, MEM, NEWEST, OPS, QUERY, USERS, _importance, _keyword, _recall
from memlake.sources.synthetic import CATEGORIES, DAY_MS, DISHES, NAMES, TOWNS

LIVE = O.LIVE
H16 = lambda x: f"substr(sha256({x}), 1, 16)"
UP = lambda c, a: f"least(1.0::double, {c} + {a}::double)"
DOWN = lambda c, a: f"greatest(0.0::double, {c} - {a}::double)"
LAST = "coalesce(last_verified_ms, ts_ms)"


def _summaries(source: str, name: str, batch: int, keep: int, importance: str = "importance") -> str:
    return f"""WITH {source}, w AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY ts_ms, id) AS place FROM {name} WHERE tier = 'working' AND {importance} < 0.8::double),
      lim AS (SELECT *, count(*) OVER (PARTITION BY owner_id) AS n FROM w WHERE place <= {batch + keep}),
      made AS (SELECT owner_id, string_agg(substr(content, 1, 80), ' | ' ORDER BY place) AS summary, count(*) AS sources FROM lim WHERE place <= least({batch}, n - {keep}) GROUP BY owner_id)"""


def _rows(values: list[tuple], columns: str) -> str:
    quoted = ", ".join("(" + ", ".join(O._quoted(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in values)
    return f"(SELECT * FROM (VALUES {quoted}) AS v({columns}))"


# Claims of whole tables: the claims' columns, then the stages that the literal claims go through too.
CLAIMS = """(SELECT CAST(conv_id AS VARCHAR) AS window_id, CAST(turn AS INTEGER) AS pos, 'c' || CAST(turn AS VARCHAR) AS id,
  CASE WHEN turn % 9 = 4 THEN substr(text, 1, 8) WHEN turn % 5 = 3 THEN coalesce(w[1], '') || ' said this and ' || coalesce(w[2], '') ELSE text END AS canonical_text,
  CASE WHEN turn % 4 = 3 THEN 'nobody' ELSE 'e' || CAST(turn % 4 AS VARCHAR) END AS subject_entity_id, CASE WHEN turn % 7 = 5 THEN 'They' ELSE coalesce(w[1], '') END AS subject_text,
  coalesce(w[2], '') AS predicate, CASE WHEN turn % 8 = 6 THEN 'something' ELSE array_to_string(w[3:6], ' ') END AS object_text,
  CASE WHEN turn % 2 = 1 THEN 'e1' END AS object_entity_id, CASE turn % 3 WHEN 0 THEN 'stated' WHEN 1 THEN 'implied' ELSE 'inferred' END AS explicitness,
  CAST(turn % 10 AS DOUBLE) / 10 AS extraction_confidence, CASE WHEN turn % 6 = 2 THEN '2024-02-01' END AS normalized_start, CASE WHEN turn % 6 = 2 THEN '2024-01-01' END AS normalized_end,
  CAST(NULL AS VARCHAR) AS relation_type, CAST(NULL AS VARCHAR) AS relation_to_event
  FROM (SELECT *, string_split(text, ' ') AS w FROM conversations))"""
ENTITIES = "(SELECT DISTINCT CAST(conv_id AS VARCHAR) AS window_id, 'e' || CAST(k AS VARCHAR) AS id FROM conversations CROSS JOIN range(3) r(k))"
_VALID = f"SELECT window_id, id, canonical_text, coalesce(reason, {O._ENTITY.replace(O.ENTS, ENTITIES)}, {O._INFER}) AS reason FROM ({O._atomic(O._STAGES.replace(O.CL, CLAIMS))}) c"

CODE = "'code' || CAST(k AS VARCHAR) || 'x'"
SECRET = "'the secret of Code' || CAST(k AS VARCHAR) || 'x is ' || CAST(k * 37 AS VARCHAR)"


def _score(content: str, term: str) -> str:
    words = f"regexp_split_to_array(lower({content}), '\\s+')"
    tf = f"(CAST(len(list_filter({words}, lambda w: contains(w, {term}))) AS DOUBLE) / len({words}))"
    return f"least(1.0::double, {tf} * ln(1 + 10.0::double / (1 + {tf} * 10)) * 5)"


def _pick(words: list[str], n: str) -> str:
    return f"CASE ({n}) % {len(words)} " + " ".join(f"WHEN {k} THEN {O._quoted(w)}" for k, w in enumerate(words)) + " END"


def _stacks(n: int) -> str:
    name, old, new, dish = _pick(NAMES, "k"), _pick(TOWNS, "k"), _pick(TOWNS, "k + 3"), _pick(DISHES, "k * 5 + 2")
    asked = [f"'Where does ' || {name} || ' live?'", "'Which dinner do I prefer?'", "'What did you suggest to cook?'", f"'Where does ' || {name} || ' come from?'", "'Where was I most recently?'", "'Where do I live now?'"]
    case = lambda xs: "CASE k % 6 " + " ".join(f"WHEN {c} THEN {x}" for c, x in enumerate(xs)) + " END"
    return f"SELECT k AS stack_id, {_pick(CATEGORIES, 'k')} AS category, {case(asked)} AS question, {case([old, dish, dish, old, new, new])} AS expected, {case([1, 1, 1, 2, 2, 2])} AS sessions FROM range({n}) r(k)"


SQL: dict[str, str] = {
    "remember_rows": f"""WITH {MEM} SELECT 'session' AS scope, owner_id, {H16("owner_id || ':' || text || ':' || CAST(ts_ms AS VARCHAR)")} AS id, substr(text, 1, 300) AS content, {H16("text")} AS content_hash,
      {_importance("text")} AS importance, 0.5::double AS certainty, 'working' AS tier, 'active' AS status, 'episodic' AS memory_type, ts_ms AS last_verified_ms FROM mem""",
    "remember_user_rows": f"""WITH {USERS} SELECT owner_id, {H16("owner_id || ':' || text || ':' || CAST(ts_ms AS VARCHAR)")} AS id, least(length(text), 4000) AS stored, {H16("text")} AS content_hash, 0.5::double AS importance, 'user' AS scope FROM users""",
    "row_defaults": f"""WITH {MEM} SELECT id, CASE WHEN importance > 0.4::double THEN importance ELSE 0.5::double END AS importance, 0.5::double AS certainty, 0::bigint AS reinforcement_count, ts_ms AS last_verified_ms,
      'working' AS tier, 'episodic' AS memory_type, CASE WHEN role = 'user' THEN status ELSE 'active' END AS status FROM mem""",
    "store_roundtrip": f"WITH {MEM} SELECT id, owner_id, content, tier, status, importance, certainty FROM mem",
    "owner_rows": f"WITH {MEM} SELECT id, tier, status FROM mem WHERE conv_id = 3",
    "api_reinforce": f"WITH {MEM} SELECT id, {UP(UP(UP('certainty', 0.15), 0.15), 0.15)} AS certainty, importance, reinforcement_count + 3 AS reinforcement_count, status, 5::bigint AS last_verified_ms FROM mem",
    "api_contradict": f"WITH {MEM} SELECT id, {DOWN(UP(DOWN(UP(UP('certainty', 0.15), 0.9), 0.25), 0.15), 0.25)} AS certainty, importance, reinforcement_count + 3 AS reinforcement_count, 'contradicted' AS status, 9::bigint AS last_verified_ms FROM mem",
    "api_set_importance": f"WITH {MEM} SELECT id, certainty, 0.35::double AS importance, reinforcement_count, status, {LAST} AS last_verified_ms FROM mem",
    "api_invalidate": f"WITH {MEM} SELECT id, certainty, importance, reinforcement_count, CASE WHEN role = 'user' THEN 'superseded' ELSE status END AS status, CASE WHEN role = 'user' THEN 77 ELSE {LAST} END AS last_verified_ms FROM mem",
    "api_forget": f"WITH {MEM} SELECT id, owner_id, tier FROM mem WHERE NOT (conv_id = 1 AND tier <> 'archived')",
    "forget_user": f"WITH {USERS} SELECT id, ts_ms < {EPOCH + 400_000} AS gone FROM users",
    "both_tables_by_id": f"WITH {MEM}, {USERS} SELECT id, certainty FROM mem UNION SELECT id, 0.5::double + CAST(doc_id % 5 AS DOUBLE) * 0.1::double FROM users",
    "consolidate_rows": f"""{_summaries(MEM, "mem", 3, 2)} SELECT owner_id, {H16(f"owner_id || ':lt:' || summary || ':{EPOCH}'")} AS id, substr(summary, 1, 120) AS content, {H16("summary")} AS content_hash, 'long_term' AS tier, 64 AS dimensions, sources FROM made""",
    "consolidate_user_rows": f"""{_summaries(USERS, "users", 5, 3, "(CAST(doc_id * 3 % 10 AS DOUBLE) / 10)")} SELECT owner_id, {H16(f"owner_id || ':lt:' || summary || ':{EPOCH}'")} AS id, substr(summary, 1, 120) AS content, {H16("summary")} AS content_hash, 'long_term' AS tier, 64 AS dimensions, sources FROM made""",
    "consolidate_by_model": f"{_summaries(MEM, 'mem', 3, 2)} SELECT owner_id, s AS content, {H16('s')} AS content_hash, sources FROM (SELECT *, unnest(['first fact', 'second fact']) AS s FROM made)",
    "importance_by_model": f"""WITH {MEM} SELECT id, CASE length(content) % 6 WHEN 0 THEN 0.87::double WHEN 1 THEN 1.0::double WHEN 3 THEN 0.25::double WHEN 4 THEN 1.0::double ELSE {_importance("content")} END AS importance FROM mem""",
    "contradictions_by_model": f"""WITH {MEM}, recent AS (SELECT *, {NEWEST} AS p FROM mem WHERE status = 'active' AND tier <> 'archived')
      SELECT owner_id, id AS memory_id, 0.8::double AS similarity, certainty FROM recent WHERE p IN (1, 3)""",
    "triples_by_model": f"""WITH {MEM}, t AS (SELECT owner_id AS session_id, role AS from_entity, 'speaks' AS relation, 'turn ' || CAST(ts_ms AS VARCHAR) AS to_entity, id AS memory_id FROM mem)
      SELECT session_id, {H16("session_id || ':' || from_entity || ':' || relation || ':' || to_entity")} AS id, from_entity, relation, to_entity, memory_id FROM t""",
    "strings_of_replies": f"WITH {MEM} SELECT id, owner_id || '/' || role AS strings FROM mem",
    "reflect_insights": f"WITH {MEM}, {_recall(4, LIVE, QUERY, False)}, w AS (SELECT *, 0.5::double * 0.6::double + certainty * 0.4::double AS weight FROM fused) SELECT owner_id, string_agg(content, chr(10) ORDER BY weight DESC, position) AS insights FROM w GROUP BY owner_id",
    "extract_by_model": "SELECT CAST(conv_id AS VARCHAR) AS window_id, 'c1' AS id, 'The ' || arg_min(role, turn) || ' spoke first at 2024-05-01T00:00:00Z' AS canonical_text, CAST(NULL AS VARCHAR) AS reason FROM conversations GROUP BY conv_id",
    "embedded_rows": f"WITH {MEM} SELECT id, CASE WHEN regexp_matches(content, '\\S') THEN 64 ELSE -1 END AS dimensions, CASE WHEN regexp_matches(content, '\\S') THEN 1.0::double END AS size FROM mem",
    "table_claims_validated": _VALID,
    "table_claims_known": f"""WITH c AS (SELECT *, {O._DUP} AS h FROM {CLAIMS}) SELECT window_id, id,
      CASE WHEN h IN (SELECT h FROM c WHERE pos % 2 = 1) OR row_number() OVER (PARTITION BY window_id, h ORDER BY pos) > 1 THEN 'duplicate' END AS reason FROM c""",
    "eval_claim_index": f"SELECT window_id, id, canonical_text AS chunk FROM ({_VALID}) WHERE reason IS NULL",
    "eval_noise": f"""WITH signals AS (SELECT k, {CODE} AS term, {SECRET} AS content FROM range(100) r(k)), pool AS (SELECT DISTINCT content FROM (SELECT content FROM signals UNION ALL SELECT text FROM conversations)),
      s AS (SELECT k, p.content, {_score("p.content", "term")} AS score FROM signals JOIN pool p ON contains(lower(p.content), term)),
      best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, content) AS p FROM s WHERE score > 0) WHERE p = 1)
      SELECT k AS query_id, coalesce(contains(lower(b.content), CAST(k * 37 AS VARCHAR)), false) AS correct FROM signals LEFT JOIN best b USING (k)""",
    "eval_noise_words": f"""WITH asked AS {_rows(list(enumerate(["tion", "the", "and", "que", "ing"])), "query_id, term")}, pool AS (SELECT DISTINCT text AS content FROM conversations),
      s AS (SELECT query_id, content, {_score("content", "term")} AS score FROM asked CROSS JOIN pool)
      SELECT query_id, content FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, content) AS p FROM s WHERE score > 0) WHERE p = 1""",
    "eval_retention": f"""WITH signals AS (SELECT k, d AS days, 'aged' || CAST(d AS VARCHAR) AS owner_id, {CODE} AS term, {SECRET} AS content, {EPOCH} - d * {DAY_MS} AS ts_ms, 's' || CAST(k AS VARCHAR) AS id FROM range(60) r(k) CROSS JOIN (SELECT CAST(unnest([30, 60, 90]) AS BIGINT) AS d)),
      pool AS (SELECT owner_id, content, ts_ms, id FROM signals UNION ALL SELECT owner_id, term || ' is nothing', {EPOCH}, 'n' || CAST(k AS VARCHAR) FROM signals WHERE k % 3 = 0),
      best AS (SELECT * FROM (SELECT s.k, s.days, p.content AS answer, row_number() OVER (PARTITION BY s.k, s.days ORDER BY p.ts_ms DESC, p.id) AS n FROM signals s JOIN pool p ON p.owner_id = s.owner_id AND list_contains(regexp_split_to_array(lower(p.content), '[^a-z0-9_]+'), s.term)) WHERE n = 1),
      judged AS (SELECT days, contains(lower(answer), CAST(k * 37 AS VARCHAR)) AS c FROM best)
      SELECT days, count(*) AS total, count(*) FILTER (c) AS correct, avg(CAST(c AS INTEGER)) AS accuracy FROM judged GROUP BY days""",
    "eval_model_judge": f"WITH {MEM} SELECT id, contains(lower(content), 'the') OR contains('the', lower(content)) OR length(content) % 2 = 0 AS correct FROM mem",
    "eval_report_files": "SELECT role AS mode, count(*) AS total, avg(CAST(length(text) % 3 = 0 AS INTEGER)) AS score FROM conversations GROUP BY role",
    "throughput_by_type": """WITH r AS (SELECT event_type, count(*) * 1000 AS stored, (epoch_ms(max(ts)) - epoch_ms(min(ts))) / 1000.0::double AS seconds FROM events GROUP BY event_type)
      SELECT event_type, stored, CAST(floor(stored / seconds + 0.5::double) AS BIGINT) AS per_second FROM r""",
    "synthetic_stacks": _stacks(600),
    "question_set": f"SELECT stack_id AS id, CAST(floor(stack_id / 2) AS BIGINT) AS window_index, question, expected FROM ({_stacks(20)})",
    "agent_accesses": f"""WITH a AS (SELECT CAST(label AS VARCHAR) AS owner_id, {EPOCH} + vec_id * 1000 AS ts_ms FROM embeddings), b AS (SELECT *, {H16("owner_id || ':' || CAST(ts_ms AS VARCHAR) || ':' || CAST(ts_ms AS VARCHAR)")} AS id FROM a)
      SELECT owner_id, id, 0.5::double AS importance, CASE WHEN seen THEN 2 ELSE 0 END AS access_count, CASE WHEN seen THEN {2 * EPOCH + 50} ELSE ts_ms END AS accessed_ms
      FROM (SELECT *, id = (SELECT min(id) FROM b WHERE owner_id = '1') AS seen FROM b)""",
    "metadata_filter": "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '26'",
}
