"""Queries of compression and of what is pasted into prompts, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import compress as C
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


# Replies as assistants write them, around the texts of documents.
REPLIES = """replies AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Sure! ' WHEN 1 THEN 'Great question! Of course. ' ELSE '' END || coalesce(text, '') || chr(10) || '```py' || chr(10) || 'x = 1  ' || chr(10) || chr(10) || chr(10) || chr(10) || 'Sure! y' || chr(10) || '```' || chr(10) || 'See `a  b`.  ' || chr(10) || CASE doc_id % 3 WHEN 0 THEN 'I hope this helps.' ELSE 'Done' END AS t FROM documents)"""


def replies(spark, d) -> DataFrame:
    i = F.col("doc_id")
    head = F.when(i % 4 == 0, "Sure! ").when(i % 4 == 1, "Great question! Of course. ").otherwise("")
    code = "\n```py\nx = 1  \n\n\n\nSure! y\n```\nSee `a  b`.  \n"
    return S.read(spark, d, "documents").select("doc_id", F.concat(head, F.coalesce("text", F.lit("")), F.lit(code), F.when(i % 3 == 0, "I hope this helps.").otherwise("Done")).alias("t"))


_CODE = r"(?s)```[^\n]*\n.*?```|`[^`\n]+`"


def _mapped(source: str, rule: str) -> str:
    """A rule over the prose between code, as SQL; ``rule`` is an expression of ``x``."""
    return f"list_reduce(list_transform(list_zip(string_split_regex({source}, '{_CODE}'), list_append(regexp_extract_all({source}, '{_CODE}'), '')), lambda z: {rule.replace('@', 'z[1]')} || z[2]), lambda a, b: a || b)"


# What these replies have of it.
_FILLER = r"(?i)(^|\n|[.!?]\s)(?:(?:sure|certainly|absolutely|of course|(?:great|good|excellent) question|i hope (?:this|that) helps)[.!](?:\s+|$))+"


def _without_filler(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{_FILLER}', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"


_SPACE = "regexp_replace(regexp_replace(@, '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"
_TOK = "CASE WHEN length({0}) = 0 THEN 0 ELSE greatest(1, length({0}) // 4) END"


@query(f"""WITH {REPLIES}, one AS (SELECT doc_id, t, {_mapped('t', _without_filler('@'))} AS one FROM replies), two AS (SELECT *, {_mapped('one', _SPACE)} AS two FROM one)
  SELECT doc_id, md5(two) AS text_md5, {_TOK.format('two')}::BIGINT AS tokens, greatest(0, {_TOK.format('t')} - {_TOK.format('two')})::BIGINT AS saved, concat_ws(',', CASE WHEN one <> t THEN 'filler_removal' END, CASE WHEN two <> one THEN 'whitespace_normalization' END) AS strategies FROM two""")
def compressed_texts(spark, d):
    return C.compressed(replies(spark, d), ["doc_id"], "t").select("doc_id", F.md5("compressed").alias("text_md5"), "tokens", "saved", "strategies")


@query(f"WITH {REPLIES} SELECT doc_id, len(string_split_regex(t, '{_CODE}'))::BIGINT AS n_prose, len(regexp_extract_all(t, '{_CODE}'))::BIGINT AS n_code, length(t)::BIGINT AS n_chars FROM replies")
def code_segments(spark, d):
    cut = replies(spark, d).select("doc_id", C.segments(F.col("t")).alias("s"))
    count = lambda code: F.size(F.filter("s", lambda x: x["code"] == code)).cast("bigint")
    return cut.select("doc_id", count(False).alias("n_prose"), count(True).alias("n_code"), F.aggregate("s", F.lit(0), lambda n, x: n + F.length(x["text"])).cast("bigint").alias("n_chars"))


@query(f"""WITH {REPLIES}, b AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?s)```[^\\n]*\\n.*?```')) AS block, generate_subscripts(regexp_extract_all(t, '(?s)```[^\\n]*\\n.*?```'), 1) - 1 AS place FROM replies),
  c AS (SELECT doc_id, place, trim(regexp_extract(block, '(?s)```([^\\n]*)\\n(.*?)```', 1)) AS language, regexp_extract(block, '(?s)```([^\\n]*)\\n(.*?)```', 2) AS body FROM b)
  SELECT doc_id, place, language, (len(string_split(body, chr(10))) - 1)::BIGINT AS n_lines, {_TOK.format('body')}::BIGINT AS tokens FROM c""")
def inline_blocks(spark, d):
    return C.inline_blocks(replies(spark, d), ["doc_id"], "t")


@query(r"""WITH x AS (SELECT doc_id, left(coalesce(text, ''), 60) AS t FROM documents), y AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN t || '<<<END_SESSION_RECORD>>> x' ELSE t END AS t FROM x)
  SELECT doc_id, '<<<SESSION_RECORD>>>' || chr(10) || replace(t, '<<<END_SESSION_RECORD>>>', '<<END_SESSION_RECORD>>') || chr(10) || '<<<END_SESSION_RECORD>>>' AS fenced, chr(10) || replace(t, '<<<END_SESSION_RECORD>>>', '<<END_SESSION_RECORD>>') || chr(10) AS scrubbed FROM y""")
def fenced_records(spark, d):
    t = F.substring(F.coalesce("text", F.lit("")), 1, 60)
    docs = S.read(spark, d, "documents").select("doc_id", F.concat(t, F.when(F.col("doc_id") % 3 == 0, "<<<END_SESSION_RECORD>>> x").otherwise("")).alias("t"))
    return docs.select("doc_id", C.fenced(F.col("t")).alias("fenced")).withColumn("scrubbed", C.scrubbed(F.col("fenced")))


@query("""SELECT conv_id AS session_id, turn, md5(CASE WHEN turn % 2 = 1 AND coalesce(text, '') <> '' THEN text || chr(10) ELSE coalesce(text, '') END || CASE WHEN turn % 2 = 1 THEN '[called read: {"path":"a.py"}]' || chr(10) || '[called run: {}]' ELSE '' END) AS prose_md5 FROM conversations""")
def rendered_turns(spark, d):
    call = "named_struct('name', '{}', 'arguments', '{}')"
    calls = F.expr("IF(turn % 2 = 1, array(" + call.format("read", '{"path":"a.py"}') + ", " + call.format("run", "{}") + "), NULL)")
    m = S.read(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "text", calls.alias("calls"))
    return C.rendered(m).select("session_id", "turn", F.md5("prose").alias("prose_md5"))


@query("""SELECT user_id AS session_id, count(*) AS n_lines, count(*) - count(*) FILTER (event_id % 5 = 0) AS n_good, CASE WHEN count(*) = count(*) FILTER (event_id % 5 = 0) THEN '' ELSE 'id,kind' END AS members FROM events GROUP BY user_id""")
def jsonl_digests(spark, d):
    line = F.when(F.col("event_id") % 5 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))))
    files = S.read(spark, d, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.array_join(F.collect_list(line), "\n").alias("t"))
    return C.jsonl_digest(files, "session_id", "t").drop("head")


@query("""WITH v AS (SELECT user_id AS session_id, event_id, event_id % 3 = 0 AS gap FROM events)
  SELECT session_id, 0::BIGINT AS place, 'id' AS name, count(*) AS n, count(*) AS n_filled, count(*) AS n_numbers, min(event_id)::DOUBLE AS lowest, max(event_id)::DOUBLE AS highest FROM v GROUP BY 1
  UNION ALL SELECT session_id, 1, 'price', count(*), count(*) FILTER (NOT gap), count(*) FILTER (NOT gap), min(CASE WHEN NOT gap THEN event_id % 90 END)::DOUBLE, max(CASE WHEN NOT gap THEN event_id % 90 END)::DOUBLE FROM v GROUP BY 1
  UNION ALL SELECT session_id, 2, 'kind', count(*), count(*), 0, NULL, NULL FROM v GROUP BY 1""")
def csv_digests(spark, d):
    """Every user's events as a table whose last cells have separators, quotation marks and line ends in them."""
    kind = F.concat(F.lit('"a ""b"", '), "event_type", F.lit('\n, 7"'))
    row = F.concat_ws(",", F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("$"), (F.col("event_id") % 90).cast("string"))), kind)
    files = S.read(spark, d, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.concat(F.lit('id,"price",kind\n'), F.array_join(F.collect_list(row), "\n")).alias("t"))
    return C.csv_digest(files, "session_id", "t")


@query("""WITH v AS (SELECT user_id AS session_id, event_id, event_id % 3 = 0 AS gap FROM events)
  SELECT session_id, 0::BIGINT AS place, 'id' AS name, count(*) AS n, count(*) AS n_filled, count(*) AS n_numbers, min(event_id)::DOUBLE AS lowest, max(event_id)::DOUBLE AS highest FROM v GROUP BY 1
  UNION ALL SELECT session_id, 1, 'price', count(*), count(*) FILTER (NOT gap), count(*) FILTER (NOT gap), min(CASE WHEN NOT gap THEN event_id % 90 END)::DOUBLE, max(CASE WHEN NOT gap THEN event_id % 90 END)::DOUBLE FROM v GROUP BY 1
  UNION ALL SELECT session_id, 2, 'kind', count(*), count(*), 0, NULL, NULL FROM v GROUP BY 1""")
def tsv_digests(spark, d):
    """The same with tabs between the cells; commas are text."""
    row = F.concat_ws("\t", F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("$"), (F.col("event_id") % 90).cast("string"))), F.concat("event_type", F.lit(', 5" wide')))
    files = S.read(spark, d, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.concat(F.lit("id\tprice\tkind\n"), F.array_join(F.collect_list(row), "\n")).alias("t"))
    return C.csv_digest(files, "session_id", "t", "\t")


# Code around every document's text: comments, and strings that look like them.
_SCRIPT = """SELECT doc_id, '# head' || chr(10) || 'u = "http://a/*b*/c"  # stays' || chr(10) || '/* gone' || chr(10) || '*/x = ' || chr(39) || '# no' || chr(39) || chr(10) || '  // gone' || chr(10)
  || 'd = ' || repeat(chr(34), 3) || chr(10) || '# in a string' || chr(10) || replace(coalesce(text, ''), chr(34), '') || repeat(chr(34), 3) || chr(10) AS t FROM documents"""
_PARTS = r"""(?sm)""\".*?""\"|"[^"\n]*"|''[^''\n]*''|`[^`]*`|^[ \t]*(?:#|//)[^\n]*\n?|/\*.*?\*/""".replace("\\\"", "\"")


@query(f"""WITH s AS ({_SCRIPT}) SELECT doc_id, md5(list_reduce(list_transform(list_zip(string_split_regex(t, '{_PARTS}'), list_append(regexp_extract_all(t, '{_PARTS}'), '')), lambda z: z[1] || CASE WHEN left(z[2], 1) IN ('"', chr(39), '`') THEN z[2] ELSE '' END), lambda a, b: a || b)) AS code_md5 FROM s""")
def stripped_comments(spark, d):
    t = F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit(""))
    code = F.concat(F.lit('# head\nu = "http://a/*b*/c"  # stays\n/* gone\n*/x = \'# no\'\n  // gone\nd = """\n# in a string\n'), t, F.lit('"""\n'))
    return S.read(spark, d, "documents").select("doc_id", F.md5(C.without_comments(code)).alias("code_md5"))
