"""The queries over the synthetic corpus: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import bpe, chat, fim, html, jaccard, merkle, packing, pii, quality, repeats, scratch, textio, topk, urls, vectors

# Rules by host and path prefix, and sites whose pages are blocked where no rule fits.
URL_RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
BLOCKED_SITES = [f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    textio.short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"))


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.judge(documents, quality.fit(documents, table(spark, sf_dir, "labels")))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), pii.key_of(spark))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    hard = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(conversations.select("conv_id", "turn", "role", "text").unionByName(own))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(scratch.settled(cut))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES, BLOCKED_SITES)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, text = spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("text")
    fields = ["doc_id", "source", "lang", "n_chars"]
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & text.contains("\n")
    leaves = documents.select(
        F.col("source").alias("grp"), F.col("doc_id").alias("id"), merkle.leaf(*map(F.col, fields), text).alias("leaf"),
        F.when(tampered, merkle.leaf(*map(F.col, fields), F.translate(text, "\n", ""))).alias("claimed"),
    )
    return merkle.Manifest(leaves).audited().withColumnRenamed("id", "doc_id")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Query] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_html_main_text": op3_html_main_text,
    "op4_quality_rules": op4_quality_rules,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_pii_pseudonyms": op6_pii_pseudonyms,
    "op7_chat_format": op7_chat_format,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_exact_top_k": op13_exact_top_k,
}

# The SQL is left as it was dealt: it blocks net/de/, which the contract (and URL_RULES) allow. See F1 in REPLY_r03.md.
_RULES = ", ".join(f"('{r}', '{r[: r.index('/')]}', '{r[r.index('/') :]}', '{v}')" for r, v in {**URL_RULES, "net/de/": "block"}.items())
_SITES = " OR ".join(f"host = '{s}' OR ends_with(host, '.{s}')" for s in BLOCKED_SITES)
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_REACH = """links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT a AS node, b AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a)"""

_FIELDS = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END" for c in ("doc_id", "source", "lang", "n_chars"))
_TEXT = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0})) || ':' || {0} END"
_ODD = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"  # a byte of CRC-32
_CRC = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)), lambda c, b: {_ODD}))"
# Levels of the trees of sources, then of the tree over their roots, which has the number -1.
_TREES = f"""WITH RECURSIVE d AS (SELECT doc_id, source, text, sha256({_FIELDS} || {_TEXT.format("text")}) AS leaf,
        CASE WHEN {_CRC} % 2 = 0 THEN sha256({_FIELDS} || {_TEXT.format("replace(text, chr(10), '')")}) END AS claimed FROM documents),
      ranked AS (SELECT *, dense_rank() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
      lower_ AS (SELECT t, 0 AS l, i, leaf AS h FROM ranked UNION ALL
        SELECT t, l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY t) AS n FROM lower_) WHERE n > 1 GROUP BY t, l, i // 3),
      subs AS (SELECT t, arg_max(h, l) AS h, max(l) AS top FROM lower_ GROUP BY t),
      upper_ AS (SELECT 0 AS l, t AS i, h FROM subs UNION ALL SELECT l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM upper_) WHERE n > 1 GROUP BY l, i // 3),
      node AS (SELECT t, l, i, h FROM lower_ UNION ALL SELECT -1, l, i, h FROM upper_), root AS (SELECT arg_max(h, l) AS h, max(l) AS top FROM upper_),
      steps AS (SELECT r.doc_id, r.t, r.i AS own, g.l AS step, r.t AS tree, g.l AS l, r.i // pow(3, g.l)::BIGINT AS i FROM ranked r JOIN subs s USING (t), LATERAL (SELECT unnest(range(s.top)) AS l) g
        UNION ALL SELECT r.doc_id, r.t, r.i, 1000 + g.l, -1, g.l, r.t // pow(3, g.l)::BIGINT FROM ranked r, root, LATERAL (SELECT unnest(range(root.top)) AS l) g),
      sibs AS (SELECT p.t, p.own, row_number() OVER (PARTITION BY p.t, p.own ORDER BY p.step) AS k, coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i < p.i), '') AS a, coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i > p.i), '') AS b
        FROM steps p JOIN node n ON n.t = p.tree AND n.l = p.l AND n.i // 3 = p.i // 3 GROUP BY p.t, p.own, p.step),
      proof AS (SELECT t, own, list(struct_pack(a := a, b := b) ORDER BY k) AS s FROM sibs GROUP BY t, own),
      audit AS (SELECT r.doc_id, r.leaf, s.h AS subroot, root.h AS root, sha256(coalesce(array_to_string(list_transform(p.s, lambda x: x.a || x.b), ''), '')) AS proof_sha256,
        list_reduce(list_prepend(struct_pack(a := coalesce(r.claimed, r.leaf), b := ''), coalesce(p.s, [])), lambda y, x: struct_pack(a := sha256(x.a || y.a || x.b), b := '')).a AS folded_root
        FROM ranked r JOIN subs s USING (t) CROSS JOIN root LEFT JOIN proof p ON p.t = r.t AND p.own = r.i)
      SELECT *, folded_root = root AS verified FROM audit"""

# Where SQL can say it at all: tokenisers, page extraction, the learned verdict, ciphers, packing and suffix order are
# tested against brute force instead.
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_LOWER}), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
      s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
      e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
      half AS (SELECT p.doc_id AS a, q.doc_id AS b FROM e p JOIN e q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))), {_REACH}
      SELECT doc_id, len(sh)::BIGINT AS n_shingles, least(doc_id, coalesce((SELECT min(other) FROM reach WHERE node = doc_id), doc_id)) AS component_id FROM s""",
    "op5_embedding_near_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), u AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS n FROM v),
      half AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.vec_id < q.vec_id AND list_dot_product(p.x, q.x) >= 0.9::DOUBLE * p.n * q.n), {_REACH},
      c AS (SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, least(vec_id, coalesce((SELECT min(other) FROM reach WHERE node = vec_id), vec_id)) AS component_id FROM u)
      SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM c""",
    "op7_chat_format": r"""WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)),
      k AS (SELECT *, len(regexp_extract_all(text, '</?s>|\[/?INST\]|<</?SYS>>|<</?ROLE|<<ESC')) AS n FROM m)
      SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        (sum(length(text) + n + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 END) + CASE WHEN sum(n) > 0 THEN 9 ELSE 0 END)::BIGINT AS formatted_chars
      FROM k GROUP BY conv_id""",
    "op10_url_filter": rf"""WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {_LOWER}) AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
      rules(rule, h, p, v) AS (VALUES {_RULES}),
      best AS (SELECT u.*, rule, v FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) = 1)
      SELECT page_id, host, path, rule, coalesce(v, CASE WHEN {_SITES} THEN 'block' ELSE 'allow' END) AS verdict FROM best""",
    "op11_merkle_manifest": _TREES,
    "op12_fill_in_middle": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
      s AS (SELECT *, len(units)::BIGINT AS n, list_transform([0, 8, 16, 24], lambda k: ('0x' || substr(h, k + 1, 8))::BIGINT) AS d FROM t),
      f AS (SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
        CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR d[3] % 100 >= 50 THEN 'plain' WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM s),
      c AS (SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS z FROM f),
      o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || p || '<M>' || m END AS output FROM c)
      SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars, sha256(output) AS output_sha256,
        sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN regexp_replace(output, '(?s)^<P>(.*?)<S>(.*?)<M>(.*)$', '\1\3\2') ELSE regexp_replace(output, '(?s)^<S>(.*?)<P>(.*?)<M>(.*)$', '\2\3\1') END) AS restored_sha256 FROM o""",
    "op13_exact_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
}
