"""Queries of the rules around a request, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.functions.secrets import redact_json
from parley.operators import cache, digest, extract, reports, stores
from parley.operators import messages as M
from parley.operators import requests as R
from parley.plans.inferred import ARTIFACTS, _with
from parley.plans.oracle import DOT, MESSAGES, NODES, NORM, REQUESTS, SPLIT, TOKENS, TRANSITIONS
from parley.sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(_with(ARTIFACTS) + "SELECT node_id, CASE WHEN type = 'file' THEN 'file' WHEN type = 'endpoint' THEN 'endpoint' WHEN type = 'dependency' THEN 'dependency' ELSE 'note' END AS type FROM artifacts")
def corrected_types(spark, d):
    n = S.artifacts(spark, d)
    label = F.when(F.col("type") == "dependency", F.concat("label", F.lit("==1.2"))).otherwise(F.col("label"))
    return n.select("node_id", R.corrected_type(F.lit("note"), label).alias("type"))


@query(_with(REQUESTS) + "SELECT request_id, saved // 2 + (saved - saved // 2) + request_id % 3 AS by_layers, -(request_id % 3) AS added_by_proxy FROM requests")
def net_layers(spark, d):
    return R.net_layers(S.requests(spark, d))


@query(_with(REQUESTS) + "SELECT request_id, substr(sha256(concat_ws('|', session_id, model, '0.2', '-', md5(CAST(saved AS VARCHAR)))), 1, 16) AS context FROM requests")
def cache_contexts(spark, d):
    return S.requests(spark, d).select("request_id", R.cache_context(F.col("session_id").cast("string"), [F.col("model"), F.lit("0.2"), F.lit(None)], F.md5(F.col("saved").cast("string"))).alias("context"))


@query(_with(REQUESTS) + "SELECT request_id, CASE request_id % 3 WHEN 0 THEN 'key:' || substr(sha256('k' || session_id % 7), 1, 16) WHEN 1 THEN 'ip:10.0.0.' || session_id % 7 ELSE 'ip:unknown' END AS key FROM requests")
def rate_limit_keys(spark, d):
    i, s = F.col("request_id"), F.col("session_id") % 7
    return S.requests(spark, d).select("request_id", R.limit_key(F.when(i % 3 == 0, F.concat(F.lit("k"), s)), F.when(i % 3 == 1, F.concat(F.lit("10.0.0."), s))).alias("key"))


@query(_with(MESSAGES) + "SELECT session_id, turn FROM messages QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) = 2")
def cache_breakpoints(spark, d):
    return R.breakpoints(S.messages(spark, d))


@query(_with(REQUESTS) + "SELECT request_id, input_sent + saved // 2 + request_id % 9 AS tokens FROM requests")
def whole_prompt_tokens(spark, d):
    r = S.requests(spark, d)
    return r.select("request_id", (F.col("input_sent") + F.col("layers")["compression"] + F.col("request_id") % 9).alias("tokens"))


@query(_with(NODES, TRANSITIONS) + "SELECT from_id, from_label || ' -> ' || to_label || CASE WHEN abs(confidence_delta) >= 0.05::DOUBLE THEN ' (confidence ' || CASE WHEN confidence_delta > 0 THEN '+' ELSE '-' END || round(abs(confidence_delta) * 100)::INT || '%)' ELSE '' END AS line FROM transitions")
def transition_lines(spark, d):
    return S.transitions(spark, d).select("from_id", R.transition_line(F.col("from_label"), F.col("to_label"), F.col("confidence_delta")).alias("line"))


_REASONS = """said AS (SELECT conv_id AS session_id, turn, coalesce(text, '') || ['. It was too slow. SRE', '. it crashed and leaked; nobody', '. For the price, ml', '. A leak, PM', '. Taste. Coding'][(conv_id + turn) % 5 + 1] AS t FROM conversations)"""


@query(rf"""WITH {_REASONS} SELECT session_id, turn, CASE lower(regexp_extract(t, '([^ ]*)$', 1)) WHEN 'sre' THEN 'ops' WHEN 'ml' THEN 'research' WHEN 'pm' THEN 'product' ELSE 'coding' END AS pack,
  CASE WHEN regexp_matches(t, '(?i)\b(slow|latency|timeout|timeouts|memory|throughput)\b') THEN 'performance' WHEN regexp_matches(t, '(?i)\b(bug|bugs|broke|crash\w*|error|errors|fail\w*)\b') THEN 'failure' WHEN regexp_matches(t, '(?i)\b(cost|price|expensive|budget)\b') THEN 'cost'
  WHEN regexp_matches(t, '(?i)\b(security|leak\w*|vulnerab\w*)\b') THEN 'security' ELSE 'preference' END AS trigger FROM said""")
def packs_and_triggers(spark, d):
    end = S.pick([". It was too slow. SRE", ". it crashed and leaked; nobody", ". For the price, ml", ". A leak, PM", ". Taste. Coding"], (F.col("session_id") + F.col("turn")) % 5)
    m = S.messages(spark, d).select("session_id", "turn", F.concat("text", end).alias("t"))
    return m.select("session_id", "turn", R.domain_pack(F.concat(F.lit(" "), F.substring_index("t", " ", -1))).alias("pack"), R.trigger(F.col("t")).alias("trigger"))


def _notes(spark, d):
    """Whole documents with notes behind some."""
    i = F.col("doc_id") % 3
    note = F.when(i == 0, "\nOpen issues:\n- login fails\n2) cache is slow\n\nFixed:\n* export\nNotes:\n- not one").when(i == 1, "\nsrc/a/b.py\nsrc/a/c.py\n- x\ntext\n- y\n- z").otherwise("\nplain")
    return S.read(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), note).alias("t"))


_NOTES = """lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS place FROM (SELECT doc_id, string_split(coalesce(text, '') || chr(10) || CASE doc_id % 3 WHEN 0 THEN 'Open issues:' || chr(10) || '- login fails' || chr(10) || '2) cache is slow' || chr(10) || chr(10) || 'Fixed:' || chr(10) || '* export' || chr(10) || 'Notes:' || chr(10) || '- not one'
  WHEN 1 THEN 'src/a/b.py' || chr(10) || 'src/a/c.py' || chr(10) || '- x' || chr(10) || 'text' || chr(10) || '- y' || chr(10) || '- z' ELSE 'plain' END, chr(10)) AS ls FROM documents))"""
_ITEM = r"^\s*(?:[-*+]|[0-9]+[.)])\s+"


@query(rf"""WITH {_NOTES}, kinds AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)^\s*(?:#+\s*)?(?:known |open )?(?:issue|problem|bug|error|failure)s?\s*:?\s*$') THEN 'open' WHEN regexp_matches(line, '(?i)^\s*(?:#+\s*)?(?:fixed|resolved|done|completed)\s*:?\s*$') THEN 'resolved'
    WHEN regexp_matches(line, '^\s*(?:#+\s*\S.*|[A-Za-z][\w ]{{0,40}}:)\s*$') AND NOT regexp_matches(line, '{_ITEM}.') THEN 'other' END AS kind FROM lines),
  unders AS (SELECT *, last_value(kind IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY place) AS under FROM kinds)
  SELECT doc_id, place, under, trim(regexp_extract(line, '{_ITEM}(.+)$', 1)) AS item FROM unders WHERE under IN ('open', 'resolved') AND trim(regexp_extract(line, '{_ITEM}(.+)$', 1)) <> ''""")
def problem_items(spark, d):
    return R.problem_items(_notes(spark, d), "doc_id", "t")


@query(rf"""WITH {_NOTES}, listed AS (SELECT doc_id, place, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS island FROM lines WHERE regexp_matches(line, '{_ITEM}|^\s*[\w./-]+/[\w.-]+\s*$'))
  SELECT doc_id, min(place) AS first_line, count(*) AS n_lines FROM listed GROUP BY doc_id, island HAVING count(*) >= 3""")
def listing_runs(spark, d):
    return R.listings(_notes(spark, d), "doc_id", "t")


@query(_with(NODES, "t AS (SELECT session_id, label, row_number() OVER (PARTITION BY session_id ORDER BY importance DESC, node_id) AS rank FROM nodes WHERE type = 'decision' AND status = 'completed' QUALIFY rank <= 3)") + "SELECT session_id, greatest(1, length('KEY DECISIONS: ' || string_agg(label, ' | ' ORDER BY rank)) // 4)::BIGINT AS tokens FROM t GROUP BY session_id")
def resume_tokens(spark, d):
    n = S.nodes(spark, d).filter("type = 'decision' AND status = 'completed'")
    return reports.critical_resume(n).select("session_id", T.count_tokens(F.col("block")).alias("tokens"))


@query(_with(REQUESTS) + "SELECT request_id, session_id FROM requests WHERE session_id <> 5")
def deleted_session(spark, d):
    return stores.without_session(S.requests(spark, d), 5).select("request_id", "session_id")


@query(_with(REQUESTS) + "SELECT request_id, session_id FROM requests WHERE session_id % 10 <> 0")
def deleted_checkpoints(spark, d):
    r = S.requests(spark, d)
    gone = r.select("session_id").filter("session_id % 10 = 0").distinct()
    return stores.released(r, gone).select("request_id", "session_id")


@query("SELECT doc_id, strlen(coalesce(text, '')) + strlen(left(coalesce(text, ''), 500)) + 700 AS nbytes FROM documents")
def entry_sizes(spark, d):
    t = F.coalesce("text", F.lit(""))
    return S.read(spark, d, "documents").select("doc_id", R.entry_size(t, t).alias("nbytes"))


@query(_with(NODES) + "SELECT session_id, node_id, label, importance FROM nodes WHERE session_id % 7 <> 0")
def migrated_blobs(spark, d):
    n = S.nodes(spark, d)
    blobs = n.groupBy("session_id").agg(F.to_json(F.collect_list(F.struct("node_id", "label", "importance"))).alias("blob"))
    broken = blobs.withColumn("blob", F.when(F.col("session_id") % 7 == 0, "{not json").otherwise(F.col("blob")))
    return R.from_blobs(broken, "node_id: bigint, label: string, importance: double")


@query(_with(NODES) + """SELECT status, split_part(m, '>', 2) AS next, count(*) AS n FROM nodes JOIN (SELECT unnest(string_split('pending>in_progress pending>completed pending>failed pending>invalidated in_progress>completed in_progress>failed in_progress>pending in_progress>invalidated completed>superseded completed>modified completed>invalidated completed>in_progress completed>contested '
  || 'failed>in_progress failed>completed failed>invalidated superseded>archived superseded>invalidated modified>archived modified>invalidated contested>completed contested>superseded contested>modified contested>invalidated', ' ')) AS m) ON status = split_part(m, '>', 1) GROUP BY 1, 2""")
def ontology(spark, d):
    """The moves that are open to the graph's nodes, with how many stand before each."""
    from parley.operators.graph import STATUS_MOVES

    moves = F.create_map(*(x for a, bs in STATUS_MOVES.items() for x in (F.lit(a), F.array(*map(F.lit, bs)))))
    return S.nodes(spark, d).select("status", F.explode(F.try_element_at(moves, F.col("status"))).alias("next")).groupBy("status", "next").agg(F.count("*").alias("n"))


@query(f"""WITH newest AS (SELECT * FROM embeddings ORDER BY vec_id DESC LIMIT 2000), q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0),
  n AS (SELECT q.vec_id AS query_id, a.vec_id AS best_id, round({DOT} / ({NORM.format('a')} * {NORM.format('q')}), 6) AS similarity FROM newest a, q WHERE a.vec_id <> q.vec_id)
  SELECT query_id, best_id, similarity, similarity >= 0.92 AS hit FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, best_id) = 1""")
def newest_similar(spark, d):
    v = S.read(spark, d, "embeddings").select("vec_id", "embedding")
    q = v.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return cache.hits(v.orderBy(F.desc("vec_id")).limit(2000), q)


_PREFERENCES = """said AS (SELECT conv_id AS session_id, turn, CASE (conv_id + turn) % 3 WHEN 0 THEN 'Always use tabs, please. ' WHEN 1 THEN 'tabs: ' ELSE '' END || coalesce(text, '') AS t FROM conversations),
  w AS (SELECT session_id, turn, list_filter(string_split_regex(lower(t), '[^a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN ('the', 'and', 'for', 'with', 'are', 'this', 'that', 'you', 'our', 'please', 'can', 'could', 'would', 'does')) AS ws FROM said)"""


@query(f"WITH {_PREFERENCES} SELECT session_id, turn, array_to_string(ws[1:3], '-') AS key, coalesce(list_contains(ws, 'tabs'), false) AS about_tabs FROM w")
def preference_keys(spark, d):
    lead = S.pick(["Always use tabs, please. ", "tabs: ", ""], (F.col("session_id") + F.col("turn")) % 3)
    m = S.messages(spark, d).select("session_id", "turn", F.concat(lead, "text").alias("t"))
    return m.select("session_id", "turn", R.preference_key(F.col("t")).alias("key"), F.coalesce(R.same_preference(F.col("t"), F.lit("tabs")), F.lit(False)).alias("about_tabs"))


@query(_with(ARTIFACTS, "e AS (SELECT session_id, node_id, noun, q, topic, CASE WHEN node_id % 5 = 2 THEN 'ValueError' ELSE 'TimeoutError' END AS class FROM artifacts JOIN a0 USING (node_id, session_id, noun, topic) WHERE type = 'error')") + "SELECT a.session_id, a.node_id AS first_id, b.node_id AS second_id FROM e a JOIN e b ON a.session_id = b.session_id AND a.node_id < b.node_id AND a.class <> b.class AND a.noun = b.noun")
def conflicting_errors(spark, d):
    e = S.artifacts(spark, d).filter("type = 'error'")
    own = F.regexp_replace(F.regexp_replace("label", " of .*$", ""), r"\.py", "")
    return R.conflicting_errors(e.withColumn("label", F.when(F.col("node_id") % 5 == 2, F.replace(own, F.lit("TimeoutError"), F.lit("ValueError"))).otherwise(own)))


@query(_with(ARTIFACTS, "t AS (SELECT session_id, node_id, list_filter(string_split_regex(lower(label || CASE WHEN node_id % 5 = 0 THEN ' once more' ELSE '' END), '[^a-z0-9_]+'), lambda w: length(w) >= 3) AS ws FROM artifacts WHERE type = 'task')") + "SELECT a.session_id, a.node_id, min(b.node_id) AS by FROM t a JOIN t b ON a.session_id = b.session_id AND a.node_id <> b.node_id AND len(a.ws) < len(b.ws) AND len(list_intersect(a.ws, b.ws)) >= 0.75::DOUBLE * len(a.ws) AND len(list_filter(range(1, len(list_filter(a.ws, lambda x: list_contains(b.ws, x)))), lambda k: list_position(a.ws, list_filter(a.ws, lambda x: list_contains(b.ws, x))[k + 1]) - list_position(a.ws, list_filter(a.ws, lambda x: list_contains(b.ws, x))[k]) > 1 AND list_position(b.ws, list_filter(a.ws, lambda x: list_contains(b.ws, x))[k + 1]) - list_position(b.ws, list_filter(a.ws, lambda x: list_contains(b.ws, x))[k]) > 1)) = 0 GROUP BY 1, 2")
def subsumed_tasks(spark, d):
    t = S.artifacts(spark, d).filter("type = 'task'")
    return R.subsumed(t.withColumn("label", F.when(F.col("node_id") % 5 == 0, F.concat("label", F.lit(" once more"))).otherwise(F.col("label"))))


@query(_with(NODES) + "SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY node_id % 4 DESC, CASE WHEN node_id % 4 = 0 THEN valid_from END DESC NULLS LAST, importance DESC, node_id) AS place, node_id FROM nodes")
def latest_first(spark, d):
    return R.latest_first(S.nodes(spark, d).withColumn("turn", F.when(F.col("node_id") % 4 != 0, F.col("node_id") % 4)).withColumnRenamed("valid_from", "updated_at"))


@query(_with(MESSAGES, TOKENS, SPLIT, "k AS (SELECT t.session_id, sum(tokens) AS kept FROM tok t WHERE turn >= 2 GROUP BY 1)") + "SELECT s.session_id, CASE WHEN s.session_id % 3 <> 0 AND coalesce(kept, 0) <= 900 THEN 2 ELSE split_turn END AS split_turn, s.session_id % 3 <> 0 AND coalesce(kept, 0) <= 900 AS reused FROM split s LEFT JOIN k USING (session_id)")
def frozen_cuts(spark, d):
    m = S.messages(spark, d)
    cuts = m.select("session_id").distinct().withColumn("split_turn", F.lit(2).cast("bigint"))
    stored = R.prefix_digest(m, cuts).withColumn("digest", F.when(F.col("session_id") % 3 == 0, "changed").otherwise(F.col("digest")))
    return R.frozen_cuts(m, stored, M.split_point(m, 400), 900)


@query(_with(NODES, "p AS (SELECT session_id, node_id, label, row_number() OVER (PARTITION BY session_id ORDER BY node_id) - 1 AS k FROM nodes)") + """SELECT session_id, md5('{"nodes":[' || string_agg('{"id":"' || node_id || '","type":"text","text":"' || label || '","x":' || (k % 4 * 300) || ',"y":' || (k // 4 * 120) || '}', ',' ORDER BY k) || ']}') AS json_md5 FROM p GROUP BY session_id""")
def canvases(spark, d):
    return R.canvas(S.nodes(spark, d)).select("session_id", F.md5("json").alias("json_md5"))


@query("""WITH e AS (SELECT *, event_type = 'purchase' AS bought FROM events WHERE event_id % 4 <> 0)
  SELECT event_id, '$' AS path, CASE WHEN bought THEN 'OBJECT<id: BIGINT, tags: ARRAY<STRING>, who: OBJECT<kind: STRING, user: BIGINT>>' ELSE 'OBJECT<id: BIGINT, who: STRING>' END AS kind FROM e
  UNION ALL SELECT event_id, unnest(CASE WHEN bought THEN ['$.id', '$.tags', '$.tags[0]', '$.who', '$.who.kind', '$.who.user'] ELSE ['$.id', '$.who'] END), unnest(CASE WHEN bought THEN ['BIGINT', 'ARRAY<STRING>', 'STRING', 'OBJECT<kind: STRING, user: BIGINT>', 'STRING', 'BIGINT'] ELSE ['BIGINT', 'STRING'] END) FROM e""")
def json_schemas(spark, d):
    """Of every event as JSON, in two shapes; every fourth is cut off."""
    i, kind = F.col("event_id"), F.col("event_type")
    bought = F.to_json(F.struct(i.alias("id"), F.struct(F.col("user_id").alias("user"), kind.alias("kind")).alias("who"), F.array(kind).alias("tags")))
    t = F.when(kind == "purchase", bought).otherwise(F.to_json(F.struct(i.alias("id"), kind.alias("who"))))
    return digest.json_paths(S.read(spark, d, "events").select("event_id", F.when(i % 4 == 0, F.substring(t, 1, 9)).otherwise(t).alias("t")), "event_id", "t")


@query(_with(NODES, "h AS (SELECT DISTINCT session_id, type AS kind, lower(label) AS norm FROM nodes WHERE node_id % 3 <> 0)", "m AS (SELECT DISTINCT session_id, type AS kind, lower(label) AS norm FROM nodes WHERE node_id % 3 <> 1)") + "SELECT coalesce(h.session_id, m.session_id) AS session_id, coalesce(h.kind, m.kind) AS kind, coalesce(m.norm, h.norm) AS label, CASE WHEN h.norm IS NOT NULL AND m.norm IS NOT NULL THEN 0.95 WHEN m.norm IS NOT NULL THEN 0.80 ELSE 0.65 END::DOUBLE AS confidence FROM h FULL JOIN m ON h.session_id = m.session_id AND h.kind = m.kind AND h.norm = m.norm")
def confidence_tiers(spark, d):
    n = S.nodes(spark, d).select("session_id", F.col("type").alias("kind"), "label", "node_id")
    return extract.merge_tiers(n.filter("node_id % 3 <> 0"), n.filter("node_id % 3 <> 1"))


@query(_with(NODES, "t AS (SELECT DISTINCT session_id, type, label, list_distinct(string_split(label, ' ')) AS ws FROM nodes WHERE node_id % 2 = 0)", "f AS (SELECT DISTINCT session_id, type, label, list_distinct(string_split(label, ' ')) AS ws FROM nodes WHERE node_id % 3 = 0)", "p AS (SELECT t.type, t.session_id || t.label AS t, f.session_id || f.label AS f FROM t JOIN f ON t.session_id = f.session_id AND t.type = f.type WHERE len(list_intersect(t.ws, f.ws)) >= 0.6::DOUBLE * len(t.ws))", "c AS (SELECT type, (SELECT count(*) FROM t WHERE t.type = k.type) AS n_true, (SELECT count(*) FROM f WHERE f.type = k.type) AS n_found, (SELECT count(DISTINCT t) FROM p WHERE p.type = k.type) AS covered, (SELECT count(DISTINCT f) FROM p WHERE p.type = k.type) AS good FROM (SELECT DISTINCT type FROM nodes) k)", "r AS (SELECT *, round(good / n_found::DOUBLE, 6) AS precision, round(covered / n_true::DOUBLE, 6) AS recall FROM c)") + "SELECT type AS kind, n_true, n_found, precision, recall, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM r")
def extraction_scores(spark, d):
    n = S.nodes(spark, d).select("session_id", F.col("type").alias("kind"), "label", "node_id")
    return extract.evaluate(n.filter("node_id % 3 = 0").drop("node_id"), n.filter("node_id % 2 = 0").drop("node_id"))


@query("""SELECT conv_id AS session_id, turn, '{"role":"' || role || '","apiToken":' || CASE WHEN length(to_json(coalesce(text, ''))) >= 8 THEN '"[REDACTED]"' ELSE to_json(coalesce(text, '')) END || ',"n":' || turn || '}' AS arguments FROM conversations""")
def redacted_arguments(spark, d):
    """Every message's text as the secret of a tool call."""
    call = F.to_json(F.struct(F.col("role"), F.col("text").alias("apiToken"), F.col("turn").alias("n")))
    return S.messages(spark, d).select("session_id", "turn", redact_json(call).alias("arguments"))


_MAIL = r"[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_CARD = r"[.-]?[0-9]+(?: [0-9]{4}){3}-?|[.-]?[0-9]+-?"


def _weave(t: str, pattern: str, rule: str) -> str:
    """A rule over the finds of a pattern, as SQL; ``@`` is a find."""
    return f"list_reduce(list_transform(list_zip(string_split_regex({t}, '{pattern}'), list_append(regexp_extract_all({t}, '{pattern}'), '')), lambda z: z[1] || CASE WHEN z[2] = '' THEN '' ELSE {rule.replace('@', 'z[2]')} END), lambda a, b: a || b)"


_DIGITS = "regexp_replace(@, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(0, length({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN substr({_DIGITS}, (length({_DIGITS}) - i)::INT, 1)::INT ELSE 2 * substr({_DIGITS}, (length({_DIGITS}) - i)::INT, 1)::INT // 10 + 2 * substr({_DIGITS}, (length({_DIGITS}) - i)::INT, 1)::INT % 10 END)) % 10 = 0"


@query(rf"""WITH x AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN ' mail ann.b@corp.example.com or git@host.org, ssn 123-45-6789, card 4111 1111 1111 1111 not 4111111111111112' WHEN 1 THEN ' db postgres://ann:pw@host/db, clone git@hub.example.com:x/y' WHEN 2 THEN ' {{"dbPassword": "hunter22"}}' ELSE ' none' END AS t FROM documents),
  k AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(://)[^\s/:@]*:[^\s/@]+@', '\1[REDACTED]@', 'g'), '(?i)("dbPassword": "|\btoken = ")[^"\n]{{8,}}"', '\1[REDACTED]"', 'g') AS t FROM x),
  m AS (SELECT doc_id, {_weave('t', _MAIL + '(?:[:/(]|)', "CASE WHEN right(@, 1) IN (':', '/', '(') OR lower(split_part(@, '@', 1)) IN ('git', 'hg', 'svn') THEN @ ELSE '[REDACTED]' END").replace("split_part(z[2], 'z[2]', 1)", "split_part(z[2], chr(64), 1)")} AS t FROM k),
  c AS (SELECT doc_id, {_weave('t', _CARD, f"CASE WHEN left(@, 1) NOT IN ('.', '-') AND right(@, 1) <> '-' AND length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN} THEN '[REDACTED]' ELSE @ END")} AS t FROM m)
  SELECT doc_id, md5(regexp_replace(t, '(^|[^0-9-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}($|[^0-9-])', '\1[REDACTED]\2', 'g')) AS text_md5 FROM c""")
def redacted_persons(spark, d):
    """Credentials, addresses, card numbers and social security numbers of whole documents."""
    from parley.functions.secrets import redact_all

    said = S.pick([" mail ann.b@corp.example.com or git@host.org, ssn 123-45-6789, card 4111 1111 1111 1111 not 4111111111111112", " db postgres://ann:pw@host/db, clone git@hub.example.com:x/y", ' {"dbPassword": "hunter22"}', " none"], F.col("doc_id") % 4)
    return S.read(spark, d, "documents").select("doc_id", F.md5(redact_all(F.concat(F.coalesce("text", F.lit("")), said))).alias("text_md5"))
