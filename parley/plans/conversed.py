"""Queries of what conversations state, show and recall, each beside its DuckDB SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import mentions, messages, passes, recall, stores, tools
from parley.plans.inferred import ARTIFACTS, _with
from parley.plans.oracle import MESSAGES
from parley.plans.requested import _weave
from parley.sources import tables as S
from parley.sources.settle import shared_dir
from parley.streaming import states

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- mentions and passes

_SHOWN = '\n| a | b |\nHe said "we use oracle" and "a 404 came".\n```py\nx = "y"\nKeyError: k\n```\n1: one\n2: two\n3: three\n4 no\n“quoted” end'
_ERROR = r"^\s*(?:Traceback|FAILED|ERROR|FATAL|panic:|fatal:|error:|Error:|error\[|npm ERR|Uncaught|[^:\s]*(?:Error|Exception):)"
_BLANK = "repeat(' ', length({0}))"
_LINES = f"array_to_string(list_transform(string_split(@, chr(10)), lambda x: CASE WHEN regexp_matches(x, '{_ERROR}') THEN x ELSE {_BLANK.format('x')} END), chr(10))"
_QUOTED = f"CASE WHEN length(@) > 302 OR len(list_filter(string_split_regex(@, '[^A-Za-z0-9_]+'), lambda w: regexp_full_match(w, '.*(Error|Exception)|[45][0-9][0-9]|E[A-Z]{{4,}}'))) > 0 THEN @ ELSE {_BLANK.format('@')} END"
_RUN = "coalesce(ns[i] AND ((coalesce(ns[i + 1], false) AND coalesce(ns[i + 2], false)) OR (i > 1 AND coalesce(ns[i - 1], false) AND coalesce(ns[i + 1], false)) OR (i > 2 AND coalesce(ns[i - 1], false) AND coalesce(ns[i - 2], false))), false)"


@query(
    f"""WITH x AS (SELECT doc_id, coalesce(text, '') || '{_SHOWN}' AS t FROM documents), a AS (SELECT doc_id, {_weave("t", "(?s)```[^\\n]*\\n.*?```", _LINES)} AS t FROM x),
  b AS (SELECT doc_id, string_split(t, chr(10)) AS ls, list_transform(string_split(t, chr(10)), lambda x: regexp_matches(x, '^[ \\t]*[0-9]{{1,6}}(:|\\t| [|] )')) AS ns FROM a),
  c AS (SELECT doc_id, array_to_string(list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN regexp_matches(ls[i], '^[ \\t]*[|].*[|][ \\t]*$') OR {_RUN} THEN {_BLANK.format('ls[i]')} ELSE ls[i] END), chr(10)) AS t FROM b)
  SELECT doc_id, length(t)::BIGINT AS n_chars, md5({_weave("t", '["“][^"“”\\n]+["”]', _QUOTED)}) AS masked_md5 FROM c"""
)
def masked_mentions(spark, d):
    t = F.concat(F.coalesce("text", F.lit("")), F.lit(_SHOWN))
    out = S.read(spark, d, "documents").select("doc_id", mentions.mask(t).alias("m"))
    return out.select("doc_id", F.length("m").cast("bigint").alias("n_chars"), F.md5("m").alias("masked_md5"))


_TALK = [
    " The goal is to speed up the checkout. Can we use redis for sessions?", " Sounds good. I added a session store.\n- [ ] write load tests", ' He said "we decided to use oracle". We switched from celery to kafka.', " The icon set was updated. The login form is failing.",
]


@query()
def conversation_facts(spark, d):
    """What every conversation states, with a statement behind each message; tested by labelled sessions and by hand."""
    m = S.messages(spark, d)
    end = S.pick(_TALK, F.col("turn") % 4)
    return passes.conversation_facts(m.withColumn("text", F.concat("text", end)))


@query(_with(MESSAGES, "n AS (SELECT session_id, turn, role, text AS own, lead(role) OVER w AS next_role, lead(t) OVER w AS reply FROM (SELECT session_id, turn, role, text, CASE WHEN role = 'assistant' AND (session_id + turn) % 3 = 0 THEN 'Yes, ' ELSE '' END || text AS t FROM messages WHERE role <> 'system') WINDOW w AS (PARTITION BY session_id ORDER BY turn))",
  r"c AS (SELECT *, list_filter(string_split_regex(lower('can we use redis ' || own), '[^\p{L}]+'), lambda w: w <> '') AS ws FROM n)",
  "e AS (SELECT *, len(list_filter(ws, lambda w: w IN ('the', 'and', 'of', 'to', 'is', 'that', 'it', 'for', 'with', 'was'))) AS english, greatest(len(list_filter(ws, lambda w: w IN ('der', 'die', 'und', 'das', 'nicht', 'mit', 'von', 'ist', 'ein', 'zu'))), len(list_filter(ws, lambda w: w IN ('le', 'la', 'les', 'des', 'et', 'est', 'une', 'que', 'dans', 'pour'))), len(list_filter(ws, lambda w: w IN ('el', 'los', 'las', 'del', 'para', 'por', 'con', 'una', 'como', 'su')))) AS others FROM c)")
  + r"""SELECT session_id, turn, 'redis' || turn AS label FROM e WHERE role = 'user' AND 100 * length(regexp_replace(own, '[^\p{Latin}]', '', 'g')) >= 70 * length(regexp_replace(own, '[^\p{L}]', '', 'g')) AND NOT (others >= 2 AND 2 * others >= english) AND next_role = 'assistant' AND regexp_matches(reply, '(?i)^\W*(yes|yeah|yep|sure|ok|okay|agreed|sounds good|good idea|great idea|makes sense|absolutely|of course|done|let''s do (it|that)|go ahead|works for me|that works|perfect)\b')
  AND NOT regexp_matches(regexp_extract(reply, '^[^.!?\n]*'), '(?i)\b(but|however|instead|rather|not|don''t|no)\b')""")
def accepted_choices(spark, d):
    """Users' proposals that the next turn accepts, one planted before each user's text."""
    m = S.messages(spark, d)
    yes = F.when((F.col("role") == "assistant") & ((F.col("session_id") + F.col("turn")) % 3 == 0), "Yes, ").otherwise("")
    ask = F.when(F.col("role") == "user", F.concat(F.lit("Can we use redis"), F.col("turn"), F.lit("? "))).otherwise(yes)
    said = m.withColumn("text", F.concat(ask, "text"))
    found = passes.accepted(said, passes.message_facts(said))
    return found.filter("kind = 'decision' AND label RLIKE '^redis[0-9]+$'").select("session_id", "turn", "label")


@query(_with(ARTIFACTS, "t AS (SELECT DISTINCT session_id, CASE WHEN node_id % 3 = 0 THEN 'Use ' || topic ELSE label END AS label FROM artifacts WHERE type = 'decision')", "w AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(label), '[^a-z0-9_]+'), lambda x: length(x) > 1)) AS ws FROM t)")
  + "SELECT session_id, label FROM w a WHERE NOT EXISTS (SELECT 1 FROM w b WHERE a.session_id = b.session_id AND len(b.ws) > len(a.ws) AND list_has_all(b.ws, a.ws))")
def exact_decisions(spark, d):
    n = S.artifacts(spark, d).filter("type = 'decision'")
    short = F.when(F.col("node_id") % 3 == 0, F.substring_index("label", " ", 2)).otherwise(F.col("label"))
    return passes.drop_vaguer(n.select("session_id", F.col("type").alias("kind"), short.alias("label")).distinct()).select("session_id", "label")


# --- tools

_QUOTE = "to_json(coalesce(text, ''))"


@query(f"""WITH m AS (SELECT conv_id AS session_id, turn, (conv_id + turn) % 6 AS k FROM conversations)
  SELECT session_id, turn, 'file' AS kind, unnest(CASE k WHEN 0 THEN ['src/a' || turn || '.py', 'x/y.go'] WHEN 1 THEN ['lib/b' || session_id || '.ts', 'lib/c.ts'] WHEN 4 THEN ['d.rs'] ELSE [] END) AS label FROM m
  UNION ALL SELECT session_id, turn, 'error', unnest(CASE k WHEN 2 THEN ['TypeError: bad ' || turn] WHEN 3 THEN ['ERROR failed'] ELSE [] END) FROM m""")
def tool_signals(spark, d):
    """Every message's text inside a tool call or result of four shapes, every sixth cut off."""
    t, turn, conv = F.col("text"), F.col("turn").cast("string"), F.col("session_id").cast("string")
    js = lambda c: F.to_json(F.struct(c.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6)  # noqa: E731  a JSON string
    shapes = [
        F.concat(F.lit('{"role":"assistant","content":'), js(t), F.lit(',"tool_calls":[{"function":{"name":"edit_file","arguments":'), js(F.concat(F.lit('{"path":"src/a'), turn, F.lit('.py"}'))), F.lit('}},{"function":{"name":"read_file","arguments":"{\\"path\\":\\"no.py\\"}"}},{"function":{"name":"write","arguments":"{broken"}},7,{"function":{"name":"patch","arguments":{"files":[{"filename":"x/y.go"}]}}}]}')),
        F.concat(F.lit('{"role":"assistant","content":[{"type":"text","text":'), js(t), F.lit('},{"type":"tool_use","name":"Write","input":{"file_path":"lib/b'), conv, F.lit('.ts","edits":[{"path":"lib/c.ts"}]}},{"type":"tool_use","name":"NotebookRead","input":{"path":"no"}}]}')),
        F.concat(F.lit('{"role":"user","content":[{"type":"tool_result","is_error":true,"content":[{"type":"text","text":'), js(F.concat(t, F.lit("\nTypeError: bad "), turn)), F.lit('}]}]}')),
        F.concat(F.lit('{"role":"tool","content":'), js(F.concat(F.lit("ERROR failed\n"), t)), F.lit("}")),
        F.lit('{"role":"model","content":[{"functionCall":{"name":"apply","args":{"path":"d.rs"}}},{"functionCall":5}]}'),
        F.concat(F.lit('{"role":"assistant","content":'), js(t)),
    ]
    raw = S.pick_column(shapes, (F.col("session_id") + F.col("turn")) % 6)
    return tools.signals(S.messages(spark, d).select("session_id", "turn", raw.alias("raw")), ["session_id", "turn"])


@query("""SELECT conv_id AS session_id, turn, CASE WHEN turn % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS n, md5('{"t":' || turn || ',"s":"} \\" {"}') AS first_md5 FROM conversations""")
def recovered_objects(spark, d):
    """Replies that list two objects, every second one broken off in the last string; the text of the message is the second's."""
    one = F.concat(F.lit('{"t":'), F.col("turn"), F.lit(',"s":"} \\" {"}'))
    reply = F.concat(F.lit("Here: ["), one, F.lit(","), F.to_json(F.struct("text")), F.lit("]"))
    cut = F.when(F.col("turn") % 2 == 0, reply).otherwise(reply.substr(F.lit(1), F.length(reply) - 3))
    found = S.messages(spark, d).select("session_id", "turn", tools.whole_objects(cut).alias("o"))
    return found.select("session_id", "turn", F.size("o").cast("bigint").alias("n"), F.md5(F.get("o", F.lit(0))).alias("first_md5"))


# --- recall


@query(_with(MESSAGES, "q AS (SELECT session_id, arg_max(text, turn) AS question FROM messages WHERE role = 'user' GROUP BY 1)", r"a AS (SELECT session_id, min(turn) AS seq, text, substr(sha1(role || ':' || text), 1, 20) AS h FROM messages GROUP BY session_id, role, text)",
  r"w AS (SELECT a.session_id, seq, h, len(list_intersect(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda x: length(x) >= 3)), list_distinct(list_filter(string_split_regex(lower(question), '[^\p{L}\p{N}_]+'), lambda x: length(x) >= 3)))) AS matched FROM a JOIN q USING (session_id))")
  + "SELECT session_id AS question_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY matched DESC, seq DESC, h) AS rank, seq, matched FROM w WHERE matched > 0 QUALIFY rank <= 5")
def indexed_search(spark, d):
    """Of every session the archived turns that answer its last question, from an index written in two parts."""
    m = S.messages(spark, d)
    rows = messages.archive_rows(m).select("session_id", "msg_hash", "seq", "content")
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    recall.append(rows.filter("seq % 2 = 0"), path)
    recall.append(rows, path)
    asked = m.filter("role = 'user'").groupBy("session_id").agg(F.max_by("text", "turn").alias("question")).withColumn("question_id", F.col("session_id"))
    return recall.searched(spark, path, asked, 5).select("question_id", "session_id", "rank", "seq", "matched")


@query()
def grown_excerpts(spark, d):
    """Of every document the lines around its first words, within 120 tokens; tested by brute force."""
    t = F.coalesce("text", F.lit(""))
    from parley.functions import text as T

    out = S.read(spark, d, "documents").select("doc_id", recall.excerpt(t, F.slice(T.words(t), 1, 3), 120).alias("e"))
    return out.select("doc_id", F.md5("e").alias("excerpt_md5"), F.length("e").cast("bigint").alias("n_chars"))


@query()
def span_notes(spark, d):
    """What the dropped first half of every session must not lose, with a rule behind each message; tested by brute force."""
    m = S.messages(spark, d)
    split = messages.split_point(m, 400)
    rule = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(". The payload of turn "), F.col("turn"), F.lit(" must stay under 500 KB for uploads."))).otherwise("")
    dropped = m.join(split, "session_id").filter("turn < split_turn").select("session_id", "turn", "role", F.concat("text", rule).alias("text"))
    return recall.span_notes(dropped, S.nodes(spark, d).select("session_id", "label"))


@query()
def observed_preferences(spark, d):
    """What every principal prefers after all statements of its conversations; tested by brute force."""
    lead = S.pick(["Always use tabs, please. ", "I prefer dark mode. ", "Keep answers brief. ", ""], (F.col("session_id") + F.col("turn")) % 4)
    m = S.messages(spark, d).filter("role = 'user'")
    said = m.select((F.col("session_id") % 997).alias("principal"), F.col("turn").alias("ts_us"), F.col("session_id").alias("id"), F.concat(lead, "text").alias("text"))
    return stores.observed_preferences(said).select("principal", "key", F.md5("text").alias("text_md5"), "ts_us", "n")


# --- states


@query(_with(MESSAGES, "r AS (SELECT session_id, 0 AS request_id, turn, role, text FROM messages WHERE turn < 2 UNION ALL SELECT session_id, 1, turn, role, text FROM messages)", "n AS (SELECT *, row_number() OVER (PARTITION BY session_id, request_id, role, text ORDER BY turn) AS nth FROM r)")
  + "SELECT session_id, min(request_id)::BIGINT AS request_id, arg_min(turn, request_id) AS turn, md5(text) AS text_md5 FROM n GROUP BY session_id, role, text, nth")
def resent_histories(spark, d):
    """New messages where every session sends its first two turns, then all again."""
    m = S.messages(spark, d)
    requests = m.filter("turn < 2").withColumn("request_id", F.lit(0).cast("bigint")).unionByName(m.withColumn("request_id", F.lit(1).cast("bigint")))
    return states.new_messages_of_table(requests).select("session_id", "request_id", "turn", F.md5("text").alias("text_md5"))


@query()
def cache_operations(spark, d):
    """Every event as an operation on its user's cache of three days and 4,000 bytes; tested against a plain cache."""
    e = S.read(spark, d, "events")
    i = F.col("event_id")
    op = F.when(i % 9 == 0, "invalidate").when(i % 2 == 0, "set").otherwise("get")
    ops = e.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("scope"), i.alias("op_id"), op.alias("op"), F.col("event_type").alias("key"), (F.floor(F.col("value") * 10)).cast("bigint").alias("bytes"))
    return states.cache_of_table(ops, 3 * 86_400_000, 4000)
