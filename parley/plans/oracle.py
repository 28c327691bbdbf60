"""DuckDB SQL of the queries, written apart from their Spark plans."""

from __future__ import annotations

from parley.functions.text import FUNCTION_WORDS
from parley.operators.analytics import PRICES
from parley.operators.relations import ALIASES
from parley.operators.relations import TOPICS as NODE_TOPICS
from parley.sources.tables import DAY_US, MODELS, NOUNS, STATUSES, TOPICS, TYPES, VERBS

AT = 1_705_320_000_000_000


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _case(column: str, values: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


INACTIVE = _in(["superseded", "modified", "invalidated", "archived"])
OPEN = _in(["in_progress", "pending", "failed", "contested"])

NODES = f"""
n0 AS (SELECT event_id AS node_id, user_id AS session_id, {_case("event_type", TYPES)} AS type,
  {_list(VERBS)}[event_id % 7 + 1] || ' ' || {_list(TOPICS)}[event_id % 5 + 1] || ' ' || {_list(NOUNS)}[event_id % 11 + 1] AS label,
  {_list(STATUSES)}[event_id % 9 + 1] AS status, round(least(value, 500.0) / 500, 3) AS importance,
  round(0.5::DOUBLE + (event_id % 50) / 100.0::DOUBLE, 2) AS confidence, event_id % 5 AS topic, epoch_us(ts) AS valid_from FROM events),
nodes AS (SELECT *, CASE WHEN type = 'decision' THEN lead(valid_from) OVER (PARTITION BY session_id, type, topic ORDER BY valid_from, node_id) END AS valid_until FROM n0)
"""
EDGES = """
e0 AS (SELECT event_id, user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
edges AS (SELECT user_id AS session_id, before AS source_id, event_id AS target_id,
   CASE event_id % 4 WHEN 0 THEN 'FIXES' WHEN 1 THEN 'PART_OF' WHEN 2 THEN 'DEPENDS_ON' ELSE 'RELATED_TO' END AS type, round(0.5::DOUBLE + (event_id % 10) / 20.0::DOUBLE, 2) AS weight
   FROM e0 WHERE before IS NOT NULL
  UNION ALL SELECT user_id, event_id, before, 'RELATED_TO', 1.0 FROM e0 WHERE before IS NOT NULL AND event_id % 3 = 0)
"""
TRANSITIONS = """
transitions AS (SELECT * FROM (SELECT session_id, topic, node_id AS from_id, label AS from_label, lead(node_id) OVER w AS to_id, lead(label) OVER w AS to_label,
   lead(valid_from) OVER w AS ts_us, round(lead(confidence) OVER w - confidence, 2) AS confidence_delta FROM nodes WHERE type = 'decision'
   WINDOW w AS (PARTITION BY session_id, topic ORDER BY valid_from, node_id)) WHERE to_id IS NOT NULL)
"""
REQUESTS = f"""
r0 AS (SELECT *, CAST(floor(value * 40) AS BIGINT) + 100 AS original, CAST(floor(value * (event_id % 7) * 2) AS BIGINT) AS saved FROM events),
requests AS (SELECT event_id AS request_id, user_id AS session_id, epoch_us(ts) AS ts_us, event_type,
  {_case("event_type", {k: v[0] for k, v in MODELS.items()})} AS provider, {_case("event_type", {k: v[1] for k, v in MODELS.items()})} AS model,
  original - saved AS input_sent, CAST(floor(value * 3) AS BIGINT) + 1 AS output_tokens, saved FROM r0)
"""
_MATCH = " ".join(f"WHEN contains(model, '{k}') THEN '{k}'" for k in sorted(PRICES, key=lambda k: (-len(k), k)))
_MATCH_P = " ".join(f"WHEN contains(provider, '{k}') THEN '{k}'" for k in sorted(PRICES, key=lambda k: (-len(k), k)))


def _rate(k: int) -> str:
    return "CASE WHEN provider = 'ollama' THEN 0.0 " + " ".join(f"WHEN price_key = '{n}' THEN {p[k]}" for n, p in PRICES.items()) + f" ELSE {(0.003, 0.015)[k]} END::DOUBLE"


PRICED = f"""
p0 AS (SELECT *, coalesce(CASE {_MATCH} END, CASE {_MATCH_P} END, 'default') AS price_key FROM requests),
priced AS (SELECT *, input_sent / 1000.0::DOUBLE * {_rate(0)} + output_tokens / 1000.0::DOUBLE * {_rate(1)} AS cost, saved / 1000.0::DOUBLE * {_rate(0)} AS cost_saved FROM p0)
"""
QUESTION = "which database schema and cache timeout should we fix"
ASKED = sorted({w for w in QUESTION.split() if len(w) > 2})
BOOST = "CASE type WHEN 'goal' THEN 1.25 WHEN 'decision' THEN 1.20 WHEN 'task' THEN 1.0 WHEN 'error' THEN 0.95 WHEN 'file' THEN 0.90 ELSE 1.0 END::DOUBLE"
WORDS = "list_distinct(list_filter(string_split(label, ' '), lambda w: length(w) >= 3))"


def _scored(boost: str = BOOST) -> str:
    return f"""
    now_ AS (SELECT max(valid_from) AS t FROM nodes),
    scored AS (SELECT * FROM (SELECT *, round((0.6::DOUBLE * len(list_intersect({_list(ASKED)}, {WORDS})) / {len(ASKED)} + 0.3::DOUBLE * importance
       + 0.1::DOUBLE * (1 / (1 + 0.1::DOUBLE * ((SELECT t FROM now_) - valid_from) / {DAY_US}))) * {boost}, 6) AS score
       FROM nodes WHERE status NOT IN {INACTIVE}) WHERE score > 0.05)
    """


_KIND_BOOST = f"(CASE WHEN type IN ('decision', 'error') THEN {BOOST} * 1.5 ELSE {BOOST} / 1.25 END * CASE WHEN status IN {OPEN} THEN 1.3 ELSE 1.0 END)"
MESSAGES = "messages AS (SELECT conv_id AS session_id, turn, role, coalesce(text, '') AS text FROM conversations)"
TOK = "CASE WHEN length({0}) = 0 THEN 0 ELSE greatest(1, length({0}) // 4) END"
TOKENS = f"tok AS (SELECT *, {TOK.format('text')} + {TOK.format('role')} + 4 AS tokens FROM messages)"
SPLIT = """
s0 AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS tail, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS from_end FROM tok),
split AS (SELECT session_id, least(coalesce(min(CASE WHEN role = 'user' AND tail <= 400 THEN turn END), min(CASE WHEN from_end <= 2 THEN turn END)), min(CASE WHEN from_end <= 2 THEN turn END)) AS split_turn FROM s0 GROUP BY session_id)
"""
ARCHIVE = """
a0 AS (SELECT *, substr(sha1(role || ':' || text), 1, 20) AS msg_hash FROM messages),
archive AS (SELECT session_id, msg_hash, turn AS seq, role, substr(text, 1, 200000) AS content FROM a0 QUALIFY row_number() OVER (PARTITION BY session_id, msg_hash ORDER BY turn) = 1)
"""
CLAIMS = "claims AS (SELECT session_id, ts_us, request_id AS claim_id, request_id % 9 AS principal FROM requests), owners AS (SELECT session_id, arg_min(principal, (ts_us, claim_id)) AS owner, min(ts_us) AS since FROM claims GROUP BY session_id)"
CHECKPOINTS = "checkpoints AS (SELECT session_id, ts_us, request_id AS checkpoint_id, CASE WHEN request_id % 6 = 0 THEN 'manual' ELSE 'auto' END AS trigger FROM requests)"
OBSERVED = """
observed AS (SELECT session_id % 11 AS principal, 'k' || (request_id % 23) AS key, request_id AS value, ts_us FROM requests),
pref0 AS (SELECT principal, key, arg_max(value, (ts_us, value)) AS value, max(ts_us) AS ts_us FROM observed GROUP BY principal, key),
prefs AS (SELECT *, row_number() OVER (PARTITION BY principal ORDER BY ts_us DESC, key) AS place FROM pref0 QUALIFY place <= 12)
"""
DOT = "list_sum(list_transform(list_zip(a.embedding, q.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
NORM = "sqrt(list_sum(list_transform({0}.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"


def _blended(k: int, weight: float, top: int) -> str:
    """Every pair's score, of which the best stay."""
    return _with(_near(k), "q AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 20 = 0)") + f"""SELECT q.query_id, e.vec_id, round((e.vec_id % 10) / 10.0::DOUBLE + coalesce(round({weight}::DOUBLE * r.similarity / (SELECT max(similarity) FROM ranked WHERE query_id = q.query_id), 6), 0), 6) AS score,
      row_number() OVER (PARTITION BY q.query_id ORDER BY round((e.vec_id % 10) / 10.0::DOUBLE + coalesce(round({weight}::DOUBLE * r.similarity / (SELECT max(similarity) FROM ranked WHERE query_id = q.query_id), 6), 0), 6) DESC, e.vec_id)::INT AS place
      FROM embeddings e CROSS JOIN q LEFT JOIN ranked r ON r.vec_id = e.vec_id AND r.query_id = q.query_id QUALIFY place <= {top}"""


def _near(k: int) -> str:
    return f"""near AS (SELECT q.vec_id AS query_id, a.vec_id AS vec_id, round({DOT} / ({NORM.format('a')} * {NORM.format('q')}), 6) AS similarity
      FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q WHERE a.vec_id <> q.vec_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM near QUALIFY rank <= {k})"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + " "


_LANGS = ", ".join(f"len(list_filter(w, lambda x: x IN {_in(ws)})) AS n_{lang}" for lang, ws in FUNCTION_WORDS.items())

SQL: dict[str, str] = {
    "usage_periods": _with(REQUESTS, PRICED, "m AS (SELECT max(ts_us) AS t FROM requests)") + " UNION ALL ".join(
        f"SELECT '{n}' AS period, count(*) AS requests, CAST(coalesce(sum(saved), 0) AS BIGINT) AS tokens_saved, CAST(coalesce(sum(input_sent + output_tokens), 0) AS BIGINT) AS tokens_used, round(coalesce(sum(cost_saved), 0), 4) AS cost_saved, round(coalesce(sum(cost), 0), 4) AS cost_actual, "
        f"round(CASE WHEN sum(saved + input_sent + output_tokens) = 0 THEN 0.0 ELSE sum(saved) / sum(saved + input_sent + output_tokens)::DOUBLE * 100 END, 4) AS savings_pct FROM priced, m WHERE ts_us >= t - {k * DAY_US}"
        for n, k in (("daily", 1), ("weekly", 7), ("monthly", 30))),
    "usage_layers": _with(REQUESTS) + "SELECT layer, CAST(sum(tokens) AS BIGINT) AS tokens FROM (SELECT 'compression' AS layer, saved // 2 AS tokens FROM requests UNION ALL SELECT 'window', saved - saved // 2 FROM requests UNION ALL SELECT 'layer_' || event_type, request_id % 3 FROM requests) GROUP BY layer",
    "usage_providers": _with(REQUESTS) + "SELECT provider, count(*) AS requests, CAST(sum(saved) AS BIGINT) AS saved FROM requests GROUP BY provider",
    "usage_costs": _with(REQUESTS, PRICED) + "SELECT price_key, count(*) AS requests, round(sum(cost), 4) AS cost, round(sum(cost_saved), 4) AS cost_saved FROM priced GROUP BY price_key",
    "usage_context_windows": _with(REQUESTS) + "SELECT DISTINCT model, CASE model WHEN 'claude-3-haiku' THEN 200000 WHEN 'gpt-4o-mini' THEN 128000 WHEN 'gemini-1.5-pro' THEN 1000000 WHEN 'llama3' THEN 32000 WHEN 'mistral-large' THEN 128000 END::BIGINT AS context_window FROM requests",
    "usage_retained": _with(REQUESTS) + f"SELECT request_id, ts_us, saved FROM requests WHERE ts_us >= (SELECT max(ts_us) FROM requests) - {14 * DAY_US} ORDER BY ts_us DESC, request_id DESC LIMIT 2000",
    "usage_sliding": _with(REQUESTS, f"daily AS (SELECT ts_us // {DAY_US} AS day, count(*) AS n, sum(saved) AS saved FROM requests GROUP BY 1)") + "SELECT day, CAST(sum(n) OVER w AS BIGINT) AS requests, CAST(sum(saved) OVER w AS BIGINT) AS saved FROM daily WINDOW w AS (ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)",
    "usage_percentiles": _with(REQUESTS) + "SELECT provider, quantile_cont(output_tokens::DOUBLE, 0.5) AS p50, quantile_cont(output_tokens::DOUBLE, 0.95) AS p95, quantile_cont(output_tokens::DOUBLE, 0.99) AS p99 FROM requests GROUP BY provider",
    "busiest_sessions": _with(REQUESTS) + "SELECT session_id, count(*) AS requests, max(ts_us) AS last_at, CAST(sum(saved) AS BIGINT) AS saved FROM requests GROUP BY session_id ORDER BY requests DESC, session_id LIMIT 10",
    "token_buckets": _with(REQUESTS, "o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts_us, request_id) AS k FROM requests)",
        "f AS (SELECT session_id, k, request_id, ts_us, true AS allowed, 3.0::DOUBLE AS level FROM o WHERE k = 1 UNION ALL SELECT session_id, k, request_id, ts_us, refilled >= 1, CASE WHEN refilled >= 1 THEN refilled - 1 ELSE refilled END FROM (SELECT o.*, least(4.0::DOUBLE, f.level + (o.ts_us - f.ts_us) / 1e6 * (1.0::DOUBLE / 7200)) AS refilled FROM o JOIN f ON o.session_id = f.session_id AND o.k = f.k + 1))") + "SELECT session_id, request_id, allowed, round(level, 6) AS tokens FROM f",
    "rank_nodes": _with(NODES, _scored()) + "SELECT node_id, session_id, type, label, status, score FROM scored ORDER BY score DESC, node_id LIMIT 12",
    "rank_nodes_by_kind": _with(NODES, _scored(_KIND_BOOST)) + "SELECT node_id, session_id, type, label, status, score FROM scored ORDER BY score DESC, node_id LIMIT 20",
    "rank_nodes_by_session": _with(NODES, _scored()) + "SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, node_id) AS rank, node_id, score FROM scored QUALIFY rank <= 3",
    "search_by_type": _with(NODES, _scored(), "pool AS (SELECT * FROM scored ORDER BY score DESC, node_id LIMIT 12)") + "SELECT node_id, type, score FROM pool WHERE type IN ('task', 'decision') ORDER BY score DESC, node_id LIMIT 6",
    "nodes_valid_at": _with(NODES) + f"SELECT session_id, type, count(*) AS n FROM nodes WHERE valid_from <= {AT} AND (valid_until IS NULL OR valid_until > {AT}) GROUP BY session_id, type",
    "query_at_time": _with(NODES) + f"SELECT node_id, session_id, type, label, round((0.7::DOUBLE * len(list_intersect(['auth', 'token'], string_split(label, ' '))) / 2 + 0.3::DOUBLE * importance) * CASE type WHEN 'goal' THEN 1.25 WHEN 'decision' THEN 1.20 WHEN 'task' THEN 1.0 WHEN 'error' THEN 0.90 WHEN 'file' THEN 0.85 ELSE 1.0 END::DOUBLE, 6) AS score FROM nodes WHERE valid_from <= {AT} AND (valid_until IS NULL OR valid_until > {AT}) AND score > 0.05::DOUBLE ORDER BY score DESC, node_id LIMIT 12",
    "importance_decay": _with(NODES, f"""d0 AS (SELECT node_id, importance, type, ((SELECT max(valid_from) FROM nodes) - valid_from) / {DAY_US}.0::DOUBLE AS days, greatest(0, ((SELECT max(valid_from) FROM nodes) - valid_from) / {DAY_US}.0::DOUBLE - node_id % 5) AS elapsed,
      CASE WHEN type = 'task' AND status = 'completed' THEN 0.15 WHEN type = 'error' AND status = 'completed' THEN 0.20 WHEN type = 'decision' AND status = 'superseded' THEN 0.30 WHEN type = 'decision' AND status = 'archived' THEN 0.25 WHEN type = 'task' AND status = 'failed' THEN 0.10 WHEN type = 'task' AND status = 'in_progress' THEN 0.05 END::DOUBLE AS rate FROM nodes),
      d1 AS (SELECT *, greatest(0.10::DOUBLE, round(importance * greatest(0.5::DOUBLE, pow(1 - rate, elapsed)), 3)) AS decayed FROM d0 WHERE rate IS NOT NULL AND days > CASE type WHEN 'task' THEN 3 WHEN 'error' THEN 1 ELSE 0 END)""") + "SELECT node_id, importance, decayed FROM d1 WHERE abs(importance - decayed) > 0.005::DOUBLE",
    "archive_superseded": _with(NODES) + f"SELECT CASE WHEN type = 'decision' AND status IN ('superseded', 'modified') AND (SELECT max(valid_from) FROM nodes) - valid_until >= {7 * DAY_US} THEN 'archived' ELSE status END AS status, count(*) AS n FROM nodes GROUP BY 1",
    "prune_selection": _with(NODES, f"p0 AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS size, type <> 'goal' AND NOT (type = 'decision' AND status NOT IN {INACTIVE}) AS loose FROM nodes)") + f"SELECT session_id, node_id, importance FROM p0 WHERE loose QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY importance, CASE WHEN status IN {INACTIVE} THEN 0 ELSE 1 END, valid_from, node_id) <= size - 40",
    "graph_stats": _with(NODES, EDGES, "ec AS (SELECT session_id, count(*) AS n_edges FROM edges GROUP BY session_id)") + f"SELECT n.session_id, count(*) AS n_nodes, round(avg(confidence), 3) AS avg_confidence, " + ", ".join(f"count(*) FILTER (type = '{t}') AS n_{t}" for t in ("goal", "decision", "task", "error", "file")) + f", count(*) FILTER (status NOT IN {INACTIVE}) AS n_live, coalesce(any_value(n_edges), 0) AS n_edges FROM nodes n LEFT JOIN ec ON n.session_id = ec.session_id GROUP BY n.session_id",
    "session_summaries": _with(NODES) + "SELECT session_id, type, count(*) AS n, max(valid_from) AS updated_at FROM nodes GROUP BY session_id, type",
    "live_edges": _with(NODES, EDGES) + f"SELECT e.* FROM edges e JOIN nodes a ON a.node_id = source_id JOIN nodes b ON b.node_id = target_id WHERE a.status NOT IN {INACTIVE} AND b.status NOT IN {INACTIVE}",
    "impact_of_word": _with(NODES, EDGES) + "SELECT DISTINCT m.node_id AS match_id, x.way, x.edge_type, x.other_id, o.type AS other_type, o.label AS other_label FROM nodes m JOIN (SELECT source_id AS match_id, target_id AS other_id, 'out' AS way, type AS edge_type FROM edges UNION ALL SELECT target_id, source_id, 'in', type FROM edges) x ON m.node_id = x.match_id JOIN nodes o ON o.node_id = x.other_id WHERE list_contains(string_split(m.label, ' '), 'billing')",
    "change_chains": _with(NODES, TRANSITIONS, "g AS (SELECT session_id, topic, node_id FROM nodes WHERE type = 'decision')") + "SELECT min(node_id) AS chain, count(*) AS n FROM g GROUP BY session_id, topic HAVING count(*) > 1",
    "why_changed": _with(NODES, TRANSITIONS, "g AS (SELECT session_id, topic, node_id, label, min(node_id) OVER (PARTITION BY session_id, topic) AS chain, count(*) OVER (PARTITION BY session_id, topic) AS n FROM nodes WHERE type = 'decision')") + "SELECT chain, node_id FROM g WHERE n > 1 AND chain IN (SELECT chain FROM g WHERE list_contains(string_split(label, ' '), 'migrate'))",
    "decision_history": _with(NODES) + "SELECT session_id, topic, row_number() OVER w AS step, node_id, label, lead(node_id) OVER w AS superseded_by FROM nodes WHERE type = 'decision' WINDOW w AS (PARTITION BY session_id, topic ORDER BY valid_from, node_id)",
    "transitions_newest_first": _with(NODES, TRANSITIONS) + "SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts_us DESC, from_id DESC) AS rank, from_id, to_id, confidence_delta FROM transitions QUALIFY rank <= 5",
    "consistency_audit": _with(NODES, EDGES, TRANSITIONS, f"""f AS (SELECT 'missing_transition' AS finding, session_id, node_id AS ref FROM nodes WHERE type = 'decision' AND status = 'superseded' AND node_id NOT IN (SELECT from_id FROM transitions)
      UNION ALL SELECT 'edge_to_inactive', e.session_id, source_id FROM edges e JOIN nodes t ON t.node_id = target_id WHERE t.status IN {INACTIVE}
      UNION ALL SELECT 'edge_ends', e.session_id, source_id FROM edges e JOIN nodes s ON s.node_id = source_id JOIN nodes t ON t.node_id = target_id WHERE (e.type = 'FIXES' AND NOT (s.type IN ('task', 'decision') AND t.type = 'error')) OR (e.type = 'PART_OF' AND NOT (s.type = 'task' AND t.type = 'goal')) OR (e.type = 'DEPENDS_ON' AND NOT (s.type IN ('file', 'task', 'decision') AND t.type IN ('dependency', 'file', 'task')))
      UNION ALL SELECT 'low_confidence', session_id, node_id FROM nodes WHERE status NOT IN {INACTIVE} AND confidence < 0.55::DOUBLE)""") + "SELECT finding, session_id, count(*) AS n, min(ref) AS first_ref FROM f GROUP BY finding, session_id",
    "contradictions": _with(NODES, f"d AS (SELECT *, string_split(label, ' ') AS p FROM nodes WHERE type = 'decision' AND status NOT IN {INACTIVE})") + "SELECT a.session_id, a.node_id AS first_id, b.node_id AS second_id FROM d a JOIN d b ON a.session_id = b.session_id AND a.topic = b.topic AND a.p[3] = b.p[3] AND a.p[1] <> b.p[1] AND a.node_id < b.node_id",
    "hotspots": _with(NODES, EDGES) + "SELECT node_id, any_value(label) AS label, count(*) AS n_in, any_value(importance) AS importance FROM nodes JOIN edges ON target_id = node_id GROUP BY node_id ORDER BY n_in DESC, importance DESC, label, node_id LIMIT 8",
    "type_flows": _with(NODES, EDGES) + "SELECT s.type AS source_type, t.type AS target_type, count(*) AS n FROM edges JOIN nodes s ON s.node_id = source_id JOIN nodes t ON t.node_id = target_id GROUP BY 1, 2",
    "error_task_links": _with(NODES, f"w AS (SELECT *, {WORDS} AS ws FROM nodes)", "x AS (SELECT e.session_id, e.node_id AS error_id, t.node_id AS task_id, e.status AS es, t.status AS ts, len(e.ws) AS ne, len(t.ws) AS nt, len(list_intersect(e.ws, t.ws)) AS shared FROM w e JOIN w t ON e.session_id = t.session_id AND e.type = 'error' AND t.type = 'task')",
        f"y AS (SELECT *, CASE WHEN shared / least(ne, nt)::DOUBLE >= 0.6 AND ts = 'completed' THEN 'FIXES' WHEN shared >= 2 AND es IN {OPEN} AND ts IN {OPEN} THEN 'BLOCKS' END AS relation FROM x WHERE shared > 0)") + "SELECT session_id, error_id, task_id, relation, shared::BIGINT AS shared FROM y WHERE relation IS NOT NULL",
    "snapshot_diff": _with(NODES, "b AS (SELECT node_id, status FROM nodes WHERE node_id % 10 <> 3)", "a AS (SELECT node_id, CASE WHEN node_id % 5 = 0 THEN 'completed' ELSE status END AS status FROM nodes WHERE node_id % 7 <> 2)", "j AS (SELECT coalesce(b.node_id, a.node_id) AS node_id, b.status AS old_status, a.status AS new_status FROM b FULL JOIN a ON a.node_id = b.node_id)") + "SELECT node_id, CASE WHEN old_status IS NULL THEN 'added' WHEN new_status IS NULL THEN 'removed' ELSE 'status_changed' END AS change, old_status, new_status FROM j WHERE old_status IS NULL OR new_status IS NULL OR old_status <> new_status",
    "status_moves": _with(NODES, "m AS (SELECT status, lag(status) OVER (PARTITION BY session_id, type, topic ORDER BY valid_from, node_id) AS before FROM nodes)", "ok AS (SELECT DISTINCT status AS before, status FROM nodes UNION SELECT split_part(p, '>', 1), split_part(p, '>', 2) FROM (SELECT unnest(string_split('pending>in_progress pending>completed pending>failed pending>invalidated in_progress>completed in_progress>failed in_progress>pending in_progress>invalidated completed>superseded completed>modified completed>invalidated completed>in_progress completed>contested failed>in_progress failed>completed failed>invalidated superseded>archived superseded>invalidated modified>archived modified>invalidated contested>completed contested>superseded contested>modified contested>invalidated', ' ')) AS p))") + "SELECT m.before, m.status, count(*) AS n, bool_or(ok.status IS NOT NULL) AS allowed FROM m LEFT JOIN ok ON ok.before = m.before AND ok.status = m.status WHERE m.before IS NOT NULL GROUP BY 1, 2",
    "label_validation": _with(NODES, """v AS (SELECT node_id, 0.5::DOUBLE + CASE WHEN length(label) < 8 THEN -0.2 WHEN length(label) < 15 THEN -0.05 ELSE 0 END + CASE WHEN length(label) > 20 THEN 0.1 ELSE 0 END + 0.1
       + CASE type WHEN 'decision' THEN CASE WHEN regexp_matches(label, '^(use|adopt|drop|migrate)') THEN 0.15 ELSE -0.1 END WHEN 'task' THEN CASE WHEN regexp_matches(label, '^(fix|add|test|review|migrate)') THEN 0.12 ELSE -0.2 END WHEN 'error' THEN 0.15 WHEN 'goal' THEN CASE WHEN length(label) < 20 THEN -0.2 ELSE 0.15 END ELSE 0 END AS s FROM nodes)""") + "SELECT node_id, round(greatest(0, least(1, s))::DOUBLE, 4) AS score, round(greatest(0, least(1, s))::DOUBLE, 4) >= 0.65::DOUBLE AS accepted FROM v",
    "node_keys": _with(NODES) + "SELECT node_id, substr(sha1(type || ':' || label), 1, 12) AS node_key FROM nodes",
    "graph_export": _with(NODES, EDGES, f"l AS (SELECT * FROM nodes WHERE status NOT IN {INACTIVE})", """ne AS (SELECT session_id, count(*) AS n_nodes, string_agg('{"node_id":' || node_id || ',"type":"' || type || '","label":"' || label || '","status":"' || status || '"}', ',' ORDER BY node_id) AS j FROM l GROUP BY 1)""",
      """le AS (SELECT session_id, count(*) AS n_edges, string_agg('{"source_id":' || source_id || ',"target_id":' || target_id || ',"type":"' || type || '"}', ',' ORDER BY source_id, target_id, type) AS j FROM edges WHERE source_id IN (SELECT node_id FROM l) AND target_id IN (SELECT node_id FROM l) GROUP BY 1)""")
      + """SELECT ne.session_id, n_nodes, coalesce(n_edges, 0) AS n_edges, md5('{"nodes":[' || ne.j || ']' || CASE WHEN le.j IS NULL THEN '' ELSE ',"edges":[' || le.j || ']' END || '}') AS json_md5 FROM ne LEFT JOIN le ON ne.session_id = le.session_id""",
    "resume_lines": _with(NODES, f"r AS (SELECT *, row_number() OVER (PARTITION BY session_id, type ORDER BY valid_from DESC, importance DESC, node_id) AS place FROM nodes WHERE status NOT IN {INACTIVE})") + "SELECT session_id, type, place, type || ': ' || label AS line FROM r WHERE place <= CASE type WHEN 'goal' THEN 1 WHEN 'decision' THEN 3 WHEN 'error' THEN 2 WHEN 'task' THEN 3 WHEN 'file' THEN 2 END",
    "session_tokens": _with(MESSAGES, TOKENS) + "SELECT session_id, count(*) AS n_messages, CAST(sum(tokens) + 2 AS BIGINT) AS tokens, sum(tokens) + 2 > 600 AS needs_windowing FROM tok GROUP BY session_id",
    "window_split": _with(MESSAGES, TOKENS, SPLIT) + "SELECT session_id, split_turn FROM split",
    "window_apply": _with(MESSAGES, TOKENS, SPLIT, "o AS (SELECT session_id, sum(tokens) + 2 > 400 AS over FROM tok GROUP BY 1)") + "SELECT m.session_id, m.turn, m.role FROM messages m JOIN split s ON m.session_id = s.session_id JOIN o ON o.session_id = m.session_id WHERE NOT over OR role = 'system' OR turn >= split_turn",
    "repeated_lines": _with("l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)",
        "g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (SELECT *, CASE WHEN line IS DISTINCT FROM lag(line) OVER (PARTITION BY doc_id ORDER BY pos) OR pos = 1 THEN 1 ELSE 0 END AS new FROM l))",
        "r AS (SELECT doc_id, run, any_value(line) AS line, count(*) AS n FROM g GROUP BY doc_id, run)",
        "s AS (SELECT doc_id, run, CASE WHEN n >= 2 AND length(trim(line)) > 20 THEN line || chr(10) || '[previous line repeated ' || (n - 1) || ' more times]' ELSE array_to_string(list_transform(range(n), lambda x: line), chr(10)) END AS shown FROM r)") + "SELECT doc_id, md5(string_agg(shown, chr(10) ORDER BY run)) AS collapsed_md5 FROM s GROUP BY doc_id",
    "repeated_replies": _with(MESSAGES, "m2 AS (SELECT * FROM messages UNION ALL SELECT session_id, turn + 100, role, replace(text, ' ', '  ') FROM messages WHERE role = 'assistant')", r"k AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS size FROM m2)", r"h AS (SELECT *, min(turn) OVER (PARTITION BY session_id, lower(regexp_replace(text, '\s+', ' ', 'g'))) AS first_turn FROM k WHERE size >= 3 AND role = 'assistant' AND length(text) > 200)") + "SELECT session_id, turn, first_turn FROM h WHERE turn > first_turn",
    "last_queries": _with(MESSAGES, r"u AS (SELECT * FROM messages WHERE role = 'user' AND len(string_split_regex(trim(text), '\s+')) >= 4)") + "SELECT session_id, max(turn) AS turn, md5(arg_max(text, turn)) AS text_md5 FROM u GROUP BY session_id",
    "guarded_requests": _with(MESSAGES, "probe AS (SELECT session_id, max(turn) + 1 AS turn, 'user' AS role, CASE WHEN session_id % 3 = 0 THEN 2 ELSE 0 END AS n FROM messages GROUP BY session_id)", "m2 AS (SELECT session_id, turn, role, 0 AS n FROM messages UNION ALL SELECT * FROM probe)", "a AS (SELECT *, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY session_id) AS answered FROM m2)") + "SELECT session_id, turn, n::BIGINT AS n_patterns, n > 0 AS blocked FROM a WHERE role = 'user' AND turn > coalesce(answered, -1)",
    "archive_search": _with(MESSAGES, ARCHIVE, "x AS (SELECT *, len(list_filter(['the', 'and', 'tion', 'eau'], lambda t: contains(lower(content), t))) AS matched FROM archive)") + "SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY matched DESC, seq DESC, msg_hash) AS rank, seq, matched::BIGINT AS matched FROM x WHERE matched > 0 QUALIFY rank <= 5",
    "archive_counts": _with(MESSAGES, ARCHIVE) + "SELECT session_id, count(*) AS n, min(msg_hash) AS first_hash FROM archive GROUP BY session_id",
    "log_head_tail": "WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents) SELECT doc_id, len(a)::BIGINT AS n_lines, md5(CASE WHEN len(a) > 10 THEN array_to_string(a[1:5], chr(10)) || chr(10) || '[' || (len(a) - 10) || ' lines omitted]' || chr(10) || array_to_string(a[len(a) - 4:len(a)], chr(10)) ELSE array_to_string(a, chr(10)) END) AS shown_md5 FROM l",
    "truncated_to_budget": _with("l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)", f"s AS (SELECT *, sum({TOK.format('line')}) OVER (PARTITION BY doc_id ORDER BY pos) AS used FROM l)") + "SELECT doc_id, count(*) FILTER (used <= 300) AS n_lines, CAST(coalesce(max(used) FILTER (used <= 300), 0) AS BIGINT) AS tokens, md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (used <= 300), '')) AS kept_md5 FROM s GROUP BY doc_id",
    "path_index": _with("p AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(coalesce(url, ''), '((?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+)', 1))) AS path FROM pages)") + "SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, count(DISTINCT path) AS n_paths, count(*) AS n_mentions FROM p GROUP BY 1",
    "injected_context": _with(NODES, _scored(), "best AS (SELECT session_id, label FROM scored QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY score DESC, node_id) = 1)", MESSAGES, "last AS (SELECT session_id, max(turn) AS turn, arg_max(text, turn) AS text FROM messages WHERE role = 'user' GROUP BY session_id)") + "SELECT l.session_id, l.turn, md5(CASE WHEN b.label IS NULL THEN text ELSE text || chr(10) || chr(10) || 'Memory: ' || b.label END) AS text_md5 FROM last l LEFT JOIN best b ON l.session_id = b.session_id",
    "token_counts": f"SELECT lang, count(*) AS n, CAST(sum({TOK.format('text')}) AS BIGINT) AS tokens FROM documents GROUP BY lang",
    "redaction_counts": r"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'))::BIGINT AS n_email, len(regexp_extract_all(coalesce(text, ''), '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b'))::BIGINT AS n_ip,
      len(regexp_extract_all(coalesce(text, ''), '\+[0-9]{1,2} \([0-9]{3}\) [0-9]{3}-[0-9]{4}'))::BIGINT AS n_phone, len(regexp_extract_all(coalesce(text, ''), '\b[0-9]{16}\b'))::BIGINT AS n_card, len(regexp_extract_all(coalesce(text, ''), '\b[0-9a-f]{40}\b'))::BIGINT AS n_secret FROM documents""",
    "redacted_texts": r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', '[email]', 'g'), '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b', '[ip]', 'g'),
      '\+[0-9]{1,2} \([0-9]{3}\) [0-9]{3}-[0-9]{4}', '[phone]', 'g'), '\b[0-9]{16}\b', '[card]', 'g'), '\b[0-9a-f]{40}\b', '[secret]', 'g')) AS text_md5 FROM documents""",
    "squeezed_texts": r"SELECT doc_id, length(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'))::BIGINT AS n_chars FROM documents",
    "language_scores": rf"WITH x AS (SELECT doc_id, string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}]+') AS w FROM documents) SELECT doc_id, {_LANGS} FROM x",
    "sensitive_prompts": r"""WITH x AS (SELECT doc_id, coalesce(text, '') AS text FROM documents) SELECT doc_id, regexp_matches(lower(text), '\bmy (name|address|password|account)\b') OR regexp_matches(lower(text), '\b(as i|you) (said|mentioned)\b') OR regexp_matches(lower(text), '\b(above|earlier|previous(ly)?)\b') OR regexp_matches(lower(text), '\bthis (file|code|error)\b')
      OR regexp_matches(lower(text), '\b(our|my) (project|repo|app)\b') OR (length(text) > 800 AND (contains(text, chr(10)) OR contains(text, '```'))) AS is_sensitive FROM x""",
    "column_stats": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, min({c})::DOUBLE AS lowest, max({c})::DOUBLE AS highest, round(avg({c}), 4) AS mean FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")),
    "column_types": "SELECT * FROM (VALUES ('o_orderkey', 'number'), ('o_orderstatus', 'text'), ('o_totalprice', 'number'), ('o_orderdate', 'date'), ('o_orderpriority', 'text')) t(\"column\", kind)",
    "identifier_columns": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) = count({c}) AND max({c}) - min({c}) + 1 = count({c}) AS is_identifier FROM part" for c in ("p_partkey", "p_size")),
    "missing_cells": "WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_name END AS c_name, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS c_mktsegment FROM customer) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN coalesce(length(trim({c}::VARCHAR)), 0) = 0 THEN 1.0 ELSE 0.0 END) * 100, 4) AS missing_pct FROM c" for c in ("c_custkey", "c_name", "c_mktsegment")),
    "categorical_columns": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_values, string_agg(DISTINCT {c}::VARCHAR, ', ' ORDER BY {c}::VARCHAR) AS \"values\" FROM orders HAVING count(DISTINCT {c}) BETWEEN 2 AND 10" for c in ("o_orderstatus", "o_orderpriority", "o_custkey")),
    "group_breakdown": "SELECT CASE WHEN grouping(o_orderstatus) = 0 THEN 'o_orderstatus' ELSE 'o_orderpriority' END AS dimension, coalesce(o_orderstatus, o_orderpriority) AS value, count(*) AS n, round(sum(o_totalprice), 2) AS sum_o_totalprice, round(avg(o_totalprice), 4) AS avg_o_totalprice FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))",
    "measure_spread": "WITH m AS (SELECT l_returnflag, avg(l_quantity) AS q, avg(l_extendedprice) AS e FROM lineitem GROUP BY 1) " + " UNION ALL ".join(f"SELECT '{n}' AS measure, round(CASE WHEN count(*) < 2 THEN 0.0 ELSE (max({c}) - min({c})) / CASE WHEN avg({c}) = 0 THEN 1.0 ELSE abs(avg({c})) END END, 6) AS spread FROM m" for n, c in (("l_quantity", "q"), ("l_extendedprice", "e"))),
    "stratified_sample": "WITH p AS (SELECT 'first' AS reason, min(o_orderkey) AS o_orderkey FROM orders UNION ALL SELECT 'last', max(o_orderkey) FROM orders UNION ALL SELECT 'o_totalprice_low', (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1) UNION ALL SELECT 'o_totalprice_high', (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) UNION ALL SELECT 'rare', o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) <= 2)) SELECT o_orderkey, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM p GROUP BY o_orderkey",
    "ranked_groups": "SELECT p_brand AS value, round(avg(p_retailprice), 4) AS mean, count(*) AS n FROM part GROUP BY p_brand ORDER BY mean DESC, value LIMIT 5",
    "even_sample": "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, greatest(1, (SELECT count(*) FROM orders) // 20) AS step FROM orders) SELECT o_orderkey FROM o WHERE p % step = 0",
    "nearest_vectors": _with(_near(5)) + "SELECT query_id, rank, vec_id, similarity FROM ranked",
    "similar_hits": _with(_near(1)) + "SELECT query_id, vec_id AS best_id, similarity, similarity >= 0.92 AS hit FROM ranked",
    "blended_scores": _blended(4, 0.4, 10),
    "blended_scores_all": _blended(10, 0.9, 25),
    "nearest_vectors_all": _with(_near(10)) + "SELECT query_id, rank, vec_id, similarity FROM ranked",
    "similar_hits_all": _with(_near(1)) + "SELECT query_id, vec_id AS best_id, similarity, similarity >= 0.8 AS hit FROM ranked",
    "sniffed_files": """WITH s AS (SELECT html AS c FROM pages UNION ALL SELECT text FROM documents), n AS (SELECT regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) AS name FROM pages),
      t AS (SELECT CASE WHEN ends_with(name, '.html') THEN 'xml' ELSE 'xml' END AS kind FROM n UNION ALL SELECT CASE WHEN h[1] IN ('{', '[') THEN 'json' WHEN h[1] = '<' THEN 'xml' WHEN contains(h, chr(9)) AND contains(h, chr(10)) THEN 'tsv' WHEN contains(h, ',') AND contains(h, chr(10)) THEN 'csv' ELSE 'text' END FROM (SELECT substr(ltrim(coalesce(text, '')), 1, 512) AS h FROM documents))
      SELECT kind, count(*) AS n FROM t GROUP BY kind""",
    "decisive_profiles": r"""WITH x AS (SELECT doc_id, string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') AS w, list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '(\d+)'))) AS d FROM documents)
      SELECT doc_id, (len(list_filter(w, lambda x: x IN ('enable', 'add', 'allow', 'with'))) - len(list_filter(w, lambda x: x IN ('not', 'no', 'never', 'without', 'disable', 'remove'))))::BIGINT AS polarity, len(d)::BIGINT AS n_literals, md5(array_to_string(d, ',')) AS literals_md5 FROM x""",
    "cache_keys": _with(MESSAGES) + "SELECT session_id, turn, substr(sha256(session_id || ':' || role || ':' || text), 1, 24) AS key FROM messages",
    "cache_eviction": _with(REQUESTS) + "SELECT session_id, request_id, CAST(sum(output_tokens * 4) OVER (PARTITION BY session_id ORDER BY ts_us DESC, request_id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM requests QUALIFY used <= 4000",
    "cache_stats": _with(REQUESTS) + f"SELECT provider, count(*) AS entries, CAST(sum(output_tokens * 4) AS BIGINT) AS bytes, count(*) FILTER (ts_us < {AT - 7 * DAY_US}) AS expired FROM requests GROUP BY provider",
    "latest_checkpoints": _with(REQUESTS, CHECKPOINTS) + "SELECT session_id, arg_max(checkpoint_id, (ts_us, checkpoint_id)) AS checkpoint_id, max(ts_us) AS ts_us, count(*) AS n FROM checkpoints GROUP BY session_id",
    "retained_checkpoints": _with(REQUESTS, CHECKPOINTS) + "SELECT session_id, ts_us, checkpoint_id, trigger FROM checkpoints QUALIFY trigger <> 'auto' OR row_number() OVER (PARTITION BY session_id, trigger ORDER BY ts_us DESC, checkpoint_id DESC) <= 5",
    "session_owners": _with(REQUESTS, CLAIMS) + "SELECT session_id, owner, since FROM owners",
    "access_checks": _with(REQUESTS, CLAIMS, "asked AS (SELECT DISTINCT session_id, request_id % 4 AS principal FROM requests)") + "SELECT a.session_id, a.principal, o.owner IS NULL OR o.owner = a.principal AS allowed FROM asked a LEFT JOIN (SELECT * FROM owners WHERE session_id % 5 <> 0) o ON o.session_id = a.session_id",
    "owned_sessions": _with(REQUESTS, CLAIMS) + "SELECT session_id, owner, since FROM owners WHERE owner = 3 ORDER BY since DESC, session_id LIMIT 100",
    "preferences": _with(REQUESTS, OBSERVED) + "SELECT principal, key, value, ts_us, place FROM prefs",
    "preference_context": _with(REQUESTS, OBSERVED, "pl AS (SELECT *, key || '=' || value AS line, sum(length(key || '=' || value) + 2) OVER (PARTITION BY principal ORDER BY place) AS used FROM prefs)") + "SELECT principal, string_agg(line, '; ' ORDER BY place) AS context FROM pl WHERE place <= 4 AND used <= 60 GROUP BY principal",
    "delta_writes": _with(NODES, "w AS (SELECT node_id, status FROM nodes WHERE node_id % 8 <> 0)", "c AS (SELECT node_id, CASE WHEN node_id % 10 = 4 THEN 'archived' ELSE status END AS status FROM nodes WHERE node_id % 6 <> 1)", "j AS (SELECT coalesce(w.node_id, c.node_id) AS node_id, CASE WHEN w.node_id IS NULL THEN 'insert' WHEN c.node_id IS NULL THEN 'delete' WHEN w.status <> c.status THEN 'update' END AS action FROM w FULL JOIN c ON c.node_id = w.node_id)") + "SELECT node_id, action FROM j WHERE action IS NOT NULL",
    "gone_elsewhere": _with(NODES) + "SELECT node_id FROM nodes WHERE node_id % 13 = 0",
    "recall_across_sessions": _with(NODES, _scored(), REQUESTS, CLAIMS, "pool AS (SELECT session_id FROM (SELECT * FROM owners WHERE owner = 3 AND session_id <> 1 ORDER BY since DESC, session_id LIMIT 5) UNION ALL SELECT 1)") + "SELECT session_id, node_id, score FROM scored WHERE session_id IN (SELECT session_id FROM pool) ORDER BY score DESC, node_id LIMIT 10",
    "expired_sessions": _with(REQUESTS) + f"SELECT session_id, max(ts_us) AS last_at FROM requests GROUP BY session_id HAVING max(ts_us) < (SELECT max(ts_us) FROM requests) - {DAY_US}",
    "part_of_links": _with(NODES, "g AS (SELECT session_id, arg_max(node_id, (valid_from, node_id)) AS goal_id FROM nodes WHERE type = 'goal' GROUP BY session_id)") + "SELECT n.session_id, node_id AS task_id, goal_id FROM nodes n JOIN g ON n.session_id = g.session_id WHERE type = 'task'",
    "related_links": _with(NODES, f"al(w, s) AS (VALUES {', '.join(f"('{a}', '{s}')" for s, own in ALIASES.items() for a in own)})", "w0 AS (SELECT session_id, type, node_id, unnest(list_filter(string_split(label, ' '), lambda x: length(x) >= 4)) AS w FROM nodes WHERE type IN ('task', 'decision'))", "w1 AS (SELECT * FROM w0 UNION SELECT session_id, type, node_id, s FROM w0 JOIN al ON al.w = w0.w)") + "SELECT d.session_id, d.node_id AS decision_id, t.node_id AS task_id, count(DISTINCT d.w) AS shared FROM w1 d JOIN w1 t ON d.session_id = t.session_id AND d.w = t.w WHERE d.type = 'decision' AND t.type = 'task' GROUP BY 1, 2, 3",
    "current_decisions": _with(NODES) + f"SELECT session_id, topic, arg_max(node_id, (valid_from, node_id)) AS current_id, arg_max(label, (valid_from, node_id)) AS label, count(*) - 1 AS superseded FROM nodes WHERE type = 'decision' AND status NOT IN {INACTIVE} GROUP BY session_id, topic",
    "node_topics": _with(NODES, f"tp(t, w) AS (VALUES {', '.join(f"('{t}', '{w}')" for t, ws in NODE_TOPICS.items() for w in ws)})", "x AS (SELECT DISTINCT node_id, t FROM nodes JOIN tp ON list_contains(string_split(label, ' '), w))", "y AS (SELECT * FROM x UNION ALL SELECT node_id, '(unclassified)' FROM nodes WHERE node_id NOT IN (SELECT node_id FROM x))") + "SELECT t AS topic, count(*) AS n, min(node_id) AS first_id FROM y GROUP BY t",
    "nodes_not_in_payload": _with(NODES, MESSAGES, "sets AS (SELECT session_id, string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+') AS ws FROM messages UNION ALL SELECT session_id, string_split('as said ' || label, ' ') FROM nodes WHERE node_id % 3 = 0)") + "SELECT session_id, node_id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM sets s WHERE s.session_id = n.session_id AND list_has_all(s.ws, string_split(n.label, ' ')))",
    "preferences_said": _with(MESSAGES) + "SELECT session_id, turn FROM messages WHERE role = 'user' AND session_id % 4 = 0",
    "longest_error_runs": _with(NODES, "r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY valid_from, node_id) AS place, row_number() OVER (PARTITION BY session_id, type IN ('error', 'task') ORDER BY valid_from, node_id) AS own FROM nodes)", "g AS (SELECT session_id, place - own AS island, count(*) AS length, min(place) AS start, arg_min(node_id, place) AS first_id FROM r WHERE type IN ('error', 'task') GROUP BY 1, 2)") + "SELECT session_id, length, first_id FROM g QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY length DESC, start) = 1",
    "new_messages": _with(MESSAGES) + "SELECT session_id, turn, substr(sha1(text), 1, 16) AS hash FROM messages m WHERE NOT EXISTS (SELECT 1 FROM messages k WHERE k.session_id = m.session_id AND k.turn % 3 <> 2 AND k.text = m.text)",
    "prompt_cache_billing": _with(MESSAGES, f"u AS (SELECT *, sum({TOK.format('text')} + 4) OVER (PARTITION BY session_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto FROM messages)", "s AS (SELECT *, coalesce(lag(upto) OVER (PARTITION BY session_id ORDER BY turn), 0) AS before FROM u WHERE role = 'user')", "b AS (SELECT *, CASE WHEN before >= 64 THEN before ELSE 0 END AS rd FROM s)") + "SELECT session_id, count(*) AS requests, CAST(sum(upto) AS BIGINT) AS uncached, round(sum(0.1::DOUBLE * rd + 1.25::DOUBLE * (upto - rd)), 4) AS cached FROM b GROUP BY session_id",
    "word_retention": _with(MESSAGES, TOKENS, SPLIT, "o AS (SELECT session_id, sum(tokens) + 2 > 400 AS over FROM tok GROUP BY 1)", "k AS (SELECT m.session_id, m.text FROM messages m JOIN split s ON m.session_id = s.session_id JOIN o ON o.session_id = m.session_id WHERE NOT over OR role = 'system' OR turn >= split_turn)",
        *(f"{n} AS (SELECT DISTINCT session_id, w FROM (SELECT session_id, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS w FROM {t}) WHERE length(w) >= 3)" for n, t in (("aw", "messages"), ("kw", "k")))) + "SELECT a.session_id, count(*) AS needed, count(kw.w) AS kept, round(count(kw.w) / count(*)::DOUBLE, 6) AS retention FROM aw a LEFT JOIN kw ON kw.session_id = a.session_id AND kw.w = a.w GROUP BY a.session_id",
    "recall_at_six": _with(NODES, _scored(), "top AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY score DESC, node_id) <= 6)", "c AS (SELECT session_id, unnest(['database', 'cache', 'billing']) AS expected FROM (SELECT DISTINCT session_id FROM nodes))", "h AS (SELECT c.session_id, expected, bool_or(coalesce(contains(label, expected), false)) AS hit FROM c LEFT JOIN top ON top.session_id = c.session_id GROUP BY 1, 2)") + "SELECT expected, count(*) AS cases, count(*) FILTER (hit) AS hits, round(avg(hit::INT), 6) AS recall FROM h GROUP BY expected",
    "label_quality": _with(NODES) + "SELECT type, count(*) AS n, round(avg(length(label)), 4) AS mean_chars, count(*) FILTER (length(label) >= 20) AS truncated, count(DISTINCT label) AS distinct_labels FROM nodes GROUP BY type",
    "graph_counts": _with(NODES, EDGES, "l AS (SELECT source_id AS node_id FROM edges UNION SELECT target_id FROM edges)") + "SELECT session_id, count(*) AS n, count(*) FILTER (type = 'error' AND status = 'completed') AS resolved, count(*) FILTER (type = 'error' AND status <> 'completed') AS open, count(*) FILTER (node_id NOT IN (SELECT node_id FROM l)) AS unlinked FROM nodes GROUP BY session_id",
    "relevant_texts": r"WITH x AS (SELECT doc_id, len(list_intersect(['and', 'for', 'the', 'version', 'license', 'public'], string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+')))::BIGINT AS shared FROM documents) SELECT doc_id, shared FROM x WHERE shared > 0 ORDER BY shared DESC, doc_id DESC LIMIT 5",
    "table_lines": "WITH x AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: len(string_split(l, '|')) >= 3) AS w FROM documents) SELECT doc_id, len(list_filter(w, lambda b: b))::BIGINT AS n_table_lines, coalesce(list_position(w[1:4], true), 0)::BIGINT AS table_start FROM x",
    "content_texts": _with(MESSAGES) + "SELECT session_id, turn, md5(CASE WHEN turn % 3 IN (0, 1) THEN text ELSE '' END) AS text_md5 FROM messages",
}

SQL["history_at"] = SQL["query_at_time"]
