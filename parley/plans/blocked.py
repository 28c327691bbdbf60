"""Queries of what a whole session says at once: context blocks, answers to asked questions, edges of folded sessions, deletions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import blocks, connect, fold, passes, ranking, stores, windows
from parley.operators.compress import RECORD_CLOSE, RECORD_OPEN
from parley.operators.vocabulary import CANONICAL, FUNCTION_WORDS, SCAFFOLD_PARTS
from parley.plans.conversed import _TALK
from parley.plans.inferred import ARTIFACTS
from parley.plans.oracle import EDGES, INACTIVE, MESSAGES, NODES, OPEN, TOK, TRANSITIONS, _case, _in
from parley.sources import tables as S
from parley.sources.settle import settled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- context blocks

BUDGET = 90
_NAMES = "['Goal', 'Working on', 'Done', 'Decided', 'Conflicting (unresolved)', 'Changes', 'Note', 'Avoid', 'Noted', 'Files', 'Env', 'Open issues']"
_APART = "[' | ', ' | ', ' | ', ' | ', ' | ', ' | ', ' | ', ' | ', ' | ', ', ', ', ', ' | ']"
_URGENCY = "[0, 2, 5, 3, 1, 4, 4, 1, 6, 7, 8, 1]"
_WORDS = "list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''))"
_OWN = "list_transform(list_filter({0}, lambda x: x.section = s), lambda x: x.item)"
_RENDER = f"""array_to_string(list_filter(list_transform(range(0, 12), lambda s: CASE WHEN len({_OWN}) > 0 THEN {_NAMES}[s + 1] || ': '
  || CASE WHEN s IN (9, 10) THEN array_to_string({_OWN}, ', ') ELSE array_to_string({_OWN}, ' | ') END END), lambda t: t IS NOT NULL), chr(10))"""
_ITEMS = f"""{NODES}, {TRANSITIONS},
told AS (SELECT session_id, node_id, status, importance, valid_from, topic, type AS old_type, CASE WHEN type = 'file' AND node_id % 23 = 0 THEN 'environment' WHEN type = 'file' AND node_id % 29 = 0 THEN 'summary' ELSE type END AS type,
  CASE WHEN type = 'file' AND node_id % 23 <> 0 AND node_id % 29 <> 0 THEN '/home/dev/' || replace(label, ' ', '/') ELSE label END AS label,
  CASE node_id % 3 WHEN 0 THEN NULL WHEN 1 THEN label ELSE 'cheaper to run for user ' || session_id END AS summary FROM nodes),
clock AS (SELECT max(valid_from) AS now FROM nodes),
goals AS (SELECT session_id, 0 AS section, row_number() OVER (PARTITION BY session_id ORDER BY importance DESC, node_id) - 1 AS place, label AS item FROM told WHERE type = 'goal'),
opens AS (SELECT session_id, status, row_number() OVER (PARTITION BY session_id, status ORDER BY importance DESC, valid_from DESC, node_id) - 1 AS r, label FROM told WHERE type = 'task' AND status IN ('in_progress', 'pending')),
few AS (SELECT session_id, least(count(*) FILTER (status = 'in_progress'), count(*) FILTER (status = 'pending')) AS m FROM opens WHERE r < 4 GROUP BY session_id),
wip AS (SELECT session_id, 1 AS section, CASE WHEN r < m THEN 2 * r + CASE status WHEN 'pending' THEN 1 ELSE 0 END ELSE r + m END AS place, label AS item FROM opens JOIN few USING (session_id) WHERE r < 4),
ended AS (SELECT *, row_number() OVER (PARTITION BY session_id, substr(label, 1, 20) ORDER BY valid_from DESC, importance DESC, node_id) AS of_kind FROM told WHERE type = 'task' AND status = 'completed'),
done AS (SELECT session_id, 2 AS section, row_number() OVER (PARTITION BY session_id ORDER BY valid_from DESC, importance DESC, node_id) - 1 AS place, label AS item FROM ended WHERE of_kind = 1),
decided AS (SELECT session_id, 3 AS section, row_number() OVER (PARTITION BY session_id ORDER BY importance DESC, node_id) - 1 AS place, label || CASE WHEN length(coalesce(summary, '')) BETWEEN 8 AND 60
    AND len(list_intersect({_WORDS.format('summary')}, {_WORDS.format('label')})) / len({_WORDS.format('summary')}) < 0.5 THEN ' (' || summary || ')' ELSE '' END AS item FROM told WHERE type = 'decision' AND status = 'completed'),
disputed AS (SELECT session_id, node_id, label, lead(node_id) OVER w AS next_id, lead(label) OVER w AS next_label FROM told WHERE type = 'decision' AND status = 'contested' WINDOW w AS (PARTITION BY session_id, topic ORDER BY valid_from, node_id)),
conflicting AS (SELECT session_id, 4 AS section, row_number() OVER (PARTITION BY session_id ORDER BY least(node_id, next_id), greatest(node_id, next_id)) - 1 AS place,
  '''' || substr(CASE WHEN node_id < next_id THEN label ELSE next_label END, 1, 45) || ''' vs ''' || substr(CASE WHEN node_id < next_id THEN next_label ELSE label END, 1, 45) || '''' AS item FROM disputed WHERE next_id IS NOT NULL),
changes AS (SELECT session_id, 5 AS section, row_number() OVER (PARTITION BY session_id ORDER BY ts_us DESC, to_id) - 1 AS place, from_label || ' -> ' || to_label || CASE WHEN abs(confidence_delta) >= 0.05
  THEN ' (confidence ' || CASE WHEN confidence_delta > 0 THEN '+' ELSE '-' END || CAST(round(abs(confidence_delta) * 100) AS INT) || '%)' ELSE '' END AS item FROM transitions),
note AS (SELECT session_id, 6 AS section, 0 AS place, count(*) || ' decision(s) changed recently' AS item FROM told, clock WHERE type = 'decision' AND status = 'superseded' AND now - valid_from < 3 * 86400000000
  AND session_id NOT IN (SELECT session_id FROM transitions) GROUP BY session_id),
avoid AS (SELECT session_id, 7 AS section, row_number() OVER (PARTITION BY session_id ORDER BY node_id) - 1 AS place, '[DO NOT USE] ' || substr(label, 1, 40) AS item FROM told WHERE type = 'decision' AND status = 'invalidated'),
noted AS (SELECT session_id, 8 AS section, row_number() OVER (PARTITION BY session_id ORDER BY valid_from DESC, importance DESC, node_id) - 1 AS place, label AS item FROM told WHERE type = 'summary'),
files AS (SELECT session_id, 9 AS section, row_number() OVER (PARTITION BY session_id ORDER BY importance DESC, valid_from DESC, node_id) - 1 AS place, '~' || substr(label, 10) AS item FROM told WHERE type = 'file'),
env AS (SELECT session_id, 10 AS section, row_number() OVER (PARTITION BY session_id ORDER BY node_id) - 1 AS place, label AS item FROM told WHERE type = 'environment'),
failures AS (SELECT session_id, 11 AS section, row_number() OVER (PARTITION BY session_id ORDER BY importance DESC, valid_from DESC, node_id) - 1 AS place, label AS item FROM told WHERE type = 'error' AND status = 'failed'),
items AS (SELECT * FROM (FROM goals UNION ALL FROM wip UNION ALL FROM done UNION ALL FROM decided UNION ALL FROM conflicting UNION ALL FROM changes UNION ALL FROM note UNION ALL FROM avoid UNION ALL FROM noted UNION ALL FROM files UNION ALL FROM env UNION ALL FROM failures)
  WHERE place < [2, 8, 6, 6, 3, 3, 1, 2, 1, 10, 4, 3][section + 1])"""


def _told(spark, d):
    """Nodes with summaries, environments and notes; edges of open conflicts; transitions; the log's clock."""
    n = S.nodes(spark, d)
    i, file = F.col("node_id"), F.col("type") == "file"
    kind = F.when(file & (i % 23 == 0), "environment").when(file & (i % 29 == 0), "summary").otherwise(F.col("type"))
    summary = F.when(i % 3 == 1, F.col("label")).when(i % 3 == 2, F.concat(F.lit("cheaper to run for user "), F.col("session_id").cast("string")))
    path = F.concat(F.lit("/home/dev/"), F.translate("label", " ", "/"))
    told = n.withColumn("summary", summary).withColumn("kind", kind).withColumn("label", F.when(F.col("kind") == "file", path).otherwise(F.col("label"))).withColumn("type", F.col("kind")).drop("kind")
    by = S.W.partitionBy("session_id", "topic").orderBy("valid_from", "node_id")
    edges = n.filter("type = 'decision' AND status = 'contested'").select("session_id", i.alias("source_id"), F.lead("node_id").over(by).alias("target_id"), F.lit("CONFLICTS_WITH").alias("type")).filter("target_id IS NOT NULL")
    return told, edges, S.transitions(spark, d), S.latest(n, "valid_from")


@query(f"WITH {_ITEMS} SELECT session_id, section, CAST(place AS BIGINT) AS place, item FROM items")
def context_items(spark, d):
    """What each section of each session's block would show."""
    return blocks.items(*_told(spark, d)).select("session_id", "section", F.col("place").cast("bigint").alias("place"), "item")


@query(f"""WITH RECURSIVE {_ITEMS},
steps AS (SELECT *, {_URGENCY}[section + 1] AS urgency, row_number() OVER (PARTITION BY session_id ORDER BY place, {_URGENCY}[section + 1], section, item) AS step FROM items),
packed AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS used, CAST([] AS STRUCT(urgency INT, section INT, item VARCHAR)[]) AS kept FROM items
  UNION ALL SELECT session_id, step, CASE WHEN used + cost <= {BUDGET} THEN used + cost ELSE used END, CASE WHEN used + cost <= {BUDGET} THEN list_append(kept, {{'urgency': urgency, 'section': section, 'item': item}}) ELSE kept END
    FROM (SELECT p.session_id, s.step, p.used, p.kept, s.urgency, s.section, s.item, CASE WHEN list_contains(list_transform(p.kept, lambda x: x.section), s.section)
      THEN greatest(1, length({_APART}[s.section + 1] || s.item) // 4) ELSE greatest(1, length({_NAMES}[s.section + 1] || ': ' || s.item) // 4) + 1 END AS cost FROM packed p JOIN steps s ON s.session_id = p.session_id AND s.step = p.step + 1)),
ends AS (SELECT session_id, arg_max(kept, step) AS kept FROM packed GROUP BY session_id),
cut AS (SELECT session_id, 0 AS round, kept, {_RENDER.format('kept')} AS block FROM ends
  UNION ALL SELECT session_id, round, kept, {_RENDER.format('kept')} FROM (SELECT session_id, round + 1 AS round, list_filter(kept, lambda x, i: i <> list_max(list_transform(kept, lambda y, j: CASE WHEN y.section = worst.section THEN j END))) AS kept
    FROM (SELECT *, list_sort(list_transform(kept, lambda x: {{'u': x.urgency, 'n': len(list_filter(kept, lambda y: y.section = x.section)), 'm': -x.section, 'section': x.section}}), 'DESC')[1] AS worst FROM cut WHERE length(block) // 4 > {BUDGET})))
SELECT session_id, len(kept) AS n_items, CASE WHEN block = '' THEN 0 ELSE greatest(1, length(block) // 4) END AS tokens, block FROM (SELECT session_id, arg_max(kept, round) AS kept, arg_max(block, round) AS block FROM cut GROUP BY session_id)""")
def context_blocks(spark, d):
    """What a resumed session is told: its block under the budget."""
    return blocks.pack(blocks.items(*_told(spark, d)), BUDGET)


# --- answers to many questions

_ENDS = [". Which token handlers failed", " Where is the billing route?", " what did we decide about it", ". Is timeout_handler still broken right now", ". What is left to do in authConfig", ""]
_ONE = "CASE WHEN length({0}) > 4 AND {0} LIKE '%ies' THEN left({0}, length({0}) - 3) || 'y' WHEN length({0}) > 3 AND {0} LIKE '%s' AND {0} NOT LIKE '%ss' THEN left({0}, length({0}) - 1) END"
_HUMPS = "x"
for _pattern in ("([a-z])([A-Z0-9])", "([A-Z])([A-Z][a-z])", "([A-Z])([0-9])", "([0-9])([A-Za-z])"):
    _HUMPS = f"regexp_replace({_HUMPS}, '{_pattern}', '\\1 \\2', 'g')"
_ASKS = {
    "error": "broke|broken|break|breaks|breaking|fail|fails|failed|failing|failure|wrong|bug|bugs|error|errors|issue|issues|problem|problems|unsafe|crash[^ ]*|slow[^ ]*|leak[^ ]*|regress[^ ]*|not safe",
    "decision": "chose|choose|chosen|pick|picked|decide[^ ]*|decision[^ ]*|went with|go with|going with|why do we use|why did we use|why are we using|which one do we|which one did we",
    "task": "left|remaining|todo|next|pending|done|finished|checking|progress|status|verify[^ ]*|to do|still need",
    "file": "file|files|module|path|where is|where are|where does",
}


@query(rf"""WITH {ARTIFACTS},
weights AS (SELECT event_id AS node_id, round(least(value, 500.0) / 500, 3) AS importance FROM events),
asked AS (SELECT conv_id * 1000 + turn AS id, coalesce(text, '') || ['{"', '".join(_ENDS)}'][(conv_id // 20 + turn) % 6 + 1] AS t FROM conversations WHERE role = 'user' AND conv_id % 20 = 0),
texts AS (SELECT 'q' AS src, id, t FROM asked UNION ALL SELECT 'n', node_id, label FROM artifacts WHERE status NOT IN {INACTIVE}),
raw AS (SELECT src, id, regexp_replace(x, '^[.,!?:;()\[\]"''`]+|[.,!?:;()\[\]"''`]+$', '', 'g') AS x FROM (SELECT src, id, unnest(string_split_regex(t, '\s+')) AS x FROM texts) WHERE x <> ''),
parts AS (SELECT src, id, unnest(string_split_regex(lower(regexp_replace({_HUMPS}, '[^A-Za-z0-9]+', ' ', 'g')), ' ')) AS w FROM raw WHERE regexp_matches(x, '[a-z][A-Z]|[_/.-]')),
own AS (SELECT DISTINCT * FROM (SELECT src, id, lower(x) AS w FROM raw UNION ALL SELECT * FROM parts WHERE w NOT IN {_in(SCAFFOLD_PARTS)}) WHERE length(w) > 2 AND w NOT IN {_in(FUNCTION_WORDS)}),
forms AS (SELECT * FROM own UNION SELECT src, id, {_ONE.format('w')} FROM own WHERE {_ONE.format('w')} IS NOT NULL),
bare AS (SELECT src, id, regexp_replace(w, '^[.,!?:;()\[\]]+|[.,!?:;()\[\]]+$', '', 'g') AS w FROM forms),
known AS (SELECT src, id, coalesce({_case('w', CANONICAL)}, {_case(f"coalesce({_ONE.format('w')}, w)", CANONICAL)}, {_ONE.format('w')}, w) AS w FROM bare),
words AS (FROM forms UNION FROM known),
sizes AS (SELECT id, greatest((SELECT count(*) FROM words WHERE src = 'q' AND words.id = asked.id), 1) AS n_words,
  ' ' || array_to_string(list_filter(string_split_regex(lower(t), '[^a-z0-9'']+'), lambda w: w <> ''), ' ') || ' ' AS line FROM asked),
aims AS (SELECT id, n_words, {', '.join(f"regexp_matches(line, ' ({p}) ') AS {k}" for k, p in _ASKS.items())}, regexp_matches(line, ' (still|currently|right now|at the moment|so far|are we) ') AS now FROM sizes),
met AS (SELECT q.id AS question_id, n.id AS node_id, count(*) AS shared FROM words q JOIN words n ON q.w = n.w WHERE q.src = 'q' AND n.src = 'n' GROUP BY 1, 2),
clock AS (SELECT max(valid_from) AS now_us FROM artifacts),
every AS (SELECT a.id AS question_id, n.node_id, coalesce(m.shared, 0) AS shared, n_words, n.status IN {OPEN} AND now AS lifted, importance, valid_from, type,
  CASE type WHEN 'goal' THEN 1.25 WHEN 'decision' THEN 1.2 WHEN 'task' THEN 1.0 WHEN 'error' THEN 0.95 WHEN 'dependency' THEN 0.7 ELSE 0.9 END::DOUBLE AS base, CASE type WHEN 'error' THEN error WHEN 'decision' THEN decision WHEN 'task' THEN task WHEN 'file' THEN file ELSE false END AS hit, error OR decision OR task OR file AS aimed
  FROM aims a CROSS JOIN artifacts n JOIN weights USING (node_id) LEFT JOIN met m ON m.question_id = a.id AND m.node_id = n.node_id WHERE n.status NOT IN {INACTIVE}),
scored AS (SELECT question_id, node_id, (0.6::DOUBLE * shared / n_words + (0.3::DOUBLE * importance + 0.1::DOUBLE / (1 + 0.1::DOUBLE * ((now_us - valid_from) / 86400000000.0::DOUBLE))))
  * (CASE WHEN hit THEN base * 1.5::DOUBLE WHEN aimed THEN base / 1.25::DOUBLE ELSE base END * CASE WHEN lifted THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END) AS value FROM every, clock)
SELECT question_id, rank, node_id, round(value, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY value DESC, node_id) AS rank FROM scored WHERE round(value, 6) > 0.05) WHERE rank <= 12""")
def answered_questions(spark, d):
    """The twelve best nodes for every question of conversations whose id 20 divides, against all nodes."""
    end = S.pick(_ENDS, (F.floor(F.col("session_id") / 20).cast("bigint") + F.col("turn")) % 6)
    asked = S.messages(spark, d).filter("role = 'user' AND session_id % 20 = 0").select((F.col("session_id") * 1000 + F.col("turn")).alias("question_id"), F.concat("text", end).alias("question"))
    n = S.artifacts(spark, d)
    return ranking.rank(n, asked, S.latest(n, "valid_from"))


# --- folded conversations with their edges

_WORK = [
    " The goal is to speed up the checkout. We decided to use celery for the queue.", " I added a session store in src/auth/session.py.\n- [ ] write load tests for session.py", " TimeoutError in session.py again. We switched from celery to kafka.",
    " POST /api/session fails. We decided to use redis for the session cache.\n- [x] fix the timeout of the session store",
]


def _folded(spark, d) -> DataFrame:
    """Nodes of every conversation, with a statement behind each message; settled, as every relation looks at them."""
    m = S.messages(spark, d)
    told = m.withColumn("text", F.concat("text", S.pick(_WORK, F.col("turn") % 4), S.pick(_TALK, (F.col("session_id") + F.col("turn")) % 4)))
    facts = passes.conversation_facts(told).withColumnRenamed("first_turn", "turn")
    return settled(fold.fold_sessions(facts, passes.parts(spark, m.count())))


@query()
def folded_conversations(spark, d):
    """The graph of every conversation; tested by hand."""
    return _folded(spark, d)


@query()
def folded_edges(spark, d):
    """The edges of every conversation's graph; tested against loops over all pairs."""
    return connect.edges(_folded(spark, d))


@query()
def folded_changes(spark, d):
    """Which decision replaced which, in every conversation; tested by hand."""
    return connect.changes(_folded(spark, d))


# --- windows with tools

_STEPS = f"""{MESSAGES},
m0 AS (SELECT session_id, turn, CASE WHEN role = 'assistant' AND (session_id + turn) % 4 = 3 THEN 'tool' ELSE role END AS role, CASE WHEN role = 'assistant' AND (session_id + turn) % 4 = 3 THEN text || ' src/lib' || turn % 3 || '/mod' || turn || '.py, (./setup.cfg) 3/4 http://x.y/z' ELSE text END AS text,
  CASE WHEN role = 'assistant' AND (session_id + turn) % 4 = 1 THEN 'src/app/main' || turn || '.py' END AS arg FROM messages),
tok AS (SELECT *, {TOK.format('text')} + {TOK.format('role')} + 4 AS tokens FROM m0),
total AS (SELECT session_id, sum(tokens) + 2 AS total, coalesce(sum(tokens) FILTER (role = 'system'), 0) AS base FROM tok GROUP BY 1),
conv AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY session_id) AS n, sum(tokens) OVER (PARTITION BY session_id ORDER BY turn DESC) + 2 AS tail, bool_or(role = 'tool') OVER (PARTITION BY session_id) AS tools FROM tok WHERE role <> 'system'),
step AS (SELECT *, max(pos) OVER (PARTITION BY session_id) AS newest FROM conv JOIN total USING (session_id) WHERE (role = 'user' OR role = 'assistant' AND arg IS NOT NULL) AND total > 300 AND n > 3),
early AS (SELECT session_id, coalesce(min(pos) FILTER (pos >= n - 3 AND (NOT tools OR tail <= 200)), max(newest)) AS pos FROM step GROUP BY 1),
held AS (SELECT s.session_id, coalesce(max(s.pos) FILTER (base + 2 + tail >= 150), min(s.pos)) AS pos FROM step s JOIN early e ON s.session_id = e.session_id AND s.pos <= e.pos GROUP BY 1),
cut AS (SELECT s.session_id, s.pos AS split, s.turn AS split_turn, s.role AS opens_with FROM step s JOIN held h ON h.session_id = s.session_id AND h.pos = s.pos WHERE s.pos > 0)"""


def _agent_turns(spark, d):
    """Conversations with some turns of tools, and calls of others."""
    place = (F.col("session_id") + F.col("turn")) % 4
    tool, caller = (F.col("role") == "assistant") & (place == 3), (F.col("role") == "assistant") & (place == 1)
    shown = F.concat("text", F.lit(" src/lib"), (F.col("turn") % 3).cast("string"), F.lit("/mod"), F.col("turn").cast("string"), F.lit(".py, (./setup.cfg) 3/4 http://x.y/z"))
    call = F.array(F.struct(F.lit("read").alias("name"), F.concat(F.lit("src/app/main"), F.col("turn").cast("string"), F.lit(".py")).alias("arguments")))
    return S.messages(spark, d).select("session_id", "turn", F.when(tool, "tool").otherwise(F.col("role")).alias("role"), F.when(tool, shown).otherwise(F.col("text")).alias("text"), F.when(caller, call).alias("calls"))


@query(f"WITH {_STEPS} SELECT session_id, split, split_turn, opens_with FROM cut")
def agent_cuts(spark, d):
    """Where sessions with tools are cut."""
    return windows.cuts(_agent_turns(spark, d), 300, 3, 400, 150)


@query(rf"""WITH {_STEPS},
gone AS (SELECT c.session_id, c.turn, CASE WHEN c.role = 'tool' THEN c.text ELSE '' END || chr(10) || coalesce(c.arg, '') AS t FROM conv c JOIN cut USING (session_id) WHERE c.turn < split_turn),
words AS (SELECT session_id, turn, generate_subscripts(ws, 1) AS k, unnest(ws) AS w FROM (SELECT session_id, turn, string_split_regex(t, '\s+') AS ws FROM gone)),
bare AS (SELECT session_id, turn, k, regexp_replace(regexp_replace(w, '^["''`()\[\]{{}}<>,;:!?]+|["''`()\[\]{{}}<>,;:!?]+$', '', 'g'), '\.+$', '') AS w FROM words),
path AS (SELECT session_id, min((turn, k)) AS place, p FROM (SELECT *, regexp_replace(w, '^\./', '') AS p FROM bare WHERE length(w) BETWEEN 4 AND 300 AND regexp_full_match(w, '[\w./@+~][\w./@+~-]*'))
  WHERE CASE WHEN contains(p, '/') THEN regexp_matches(p, '[A-Za-z]') ELSE regexp_full_match(p, '.*[^.].*\.[A-Za-z0-9]+') AND lower(regexp_extract(p, '([^.]*)$', 1)) IN {tuple(windows.ENDINGS)} END GROUP BY session_id, p),
named AS (SELECT session_id, place, CASE WHEN contains(p, '/') THEN regexp_extract(p, '^(.*/)[^/]*$', 1) ELSE '(no directory)' END AS folder, regexp_extract(p, '([^/]*)$', 1) AS name FROM path),
lines AS (SELECT session_id, folder, min(place) AS first, folder || ': ' || string_agg(name, ' ' ORDER BY place) AS line FROM named GROUP BY 1, 2),
fits AS (SELECT *, sum(greatest(1, length(line) // 4) + 1) OVER (PARTITION BY session_id ORDER BY first DESC, folder ROWS UNBOUNDED PRECEDING) AS used FROM lines),
index AS (SELECT session_id, '{windows.HEAD}' || chr(10) || string_agg(line, chr(10) ORDER BY first, folder) AS index FROM fits WHERE used + {len(windows.HEAD) // 4} <= 40 GROUP BY 1),
sent AS (SELECT m.session_id, CASE WHEN split IS NOT NULL AND role = 'system' THEN 0 ELSE 3 END AS part, turn, role, text FROM tok m LEFT JOIN cut USING (session_id) WHERE split IS NULL OR role = 'system' OR turn >= split_turn
  UNION ALL SELECT c.session_id, 1, NULL, 'system', '@OPEN' || chr(10) || 'Session ' || c.session_id || chr(10) || '@CLOSE' || chr(10) || chr(10) || CASE WHEN index IS NULL THEN '' ELSE '@OPEN' || chr(10) || index || chr(10) || '@CLOSE' || chr(10) || chr(10) END || '[' || split || ' earlier messages omitted]' FROM cut c LEFT JOIN index USING (session_id)
  UNION ALL SELECT session_id, 2, NULL, 'user', '{windows.LEAD}' FROM cut WHERE opens_with <> 'user')
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY part, turn NULLS FIRST) - 1 AS place, role, md5(text) AS text_md5 FROM sent""".replace("@OPEN", RECORD_OPEN).replace("@CLOSE", RECORD_CLOSE))
def agent_windows(spark, d):
    """What is sent of sessions with tools: the bridge in place of what went, and the tail."""
    m = _agent_turns(spark, d)
    contexts = m.select("session_id").distinct().select("session_id", F.concat(F.lit("Session "), F.col("session_id").cast("string")).alias("block"))
    return windows.applied(m, contexts, 300, 3, 400, 150, 40).select("session_id", "place", "role", F.md5("text").alias("text_md5"))


# --- deletion


@query(f"""WITH {MESSAGES}, {NODES}, {EDGES}, {TRANSITIONS},
store AS (SELECT session_id, 'archive' AS store FROM messages UNION ALL SELECT session_id, 'edges' FROM edges UNION ALL SELECT session_id, 'nodes' FROM nodes UNION ALL SELECT session_id, 'transitions' FROM transitions),
doomed AS (SELECT DISTINCT session_id FROM nodes WHERE session_id % 10 = 0), names AS (SELECT DISTINCT store FROM store)
SELECT d.session_id, n.store, count(s.session_id) AS removed FROM doomed d CROSS JOIN names n LEFT JOIN store s ON s.session_id = d.session_id AND s.store = n.store GROUP BY 1, 2""")
def deletion_counts(spark, d):
    """What the deletion of every tenth session takes from each store."""
    kept = {"archive": S.messages(spark, d), "edges": S.edges(spark, d), "nodes": S.nodes(spark, d), "transitions": S.transitions(spark, d)}
    return stores.deletion_counts(kept, S.nodes(spark, d).filter("session_id % 10 = 0").select("session_id"))
