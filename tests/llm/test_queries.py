"""The registered queries against DuckDB, and the pipeline against its stages done plainly."""

from __future__ import annotations

import re

import corpus_pipeline
import duckdb
import pytest
from brute import jaccard as brute_jaccard
from brute import repeats as brute_repeats

from parley.llm import pii, quality, queries

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages conversations".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_parity(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    expected = con.sql(queries.ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(expected.columns)
    place = [expected.columns.index(c) for c in order]
    assert sorted(map(tuple, df.select(order).collect()), key=repr) == sorted((tuple(r[k] for k in place) for r in expected.fetchall()), key=repr)


def test_all_are_there():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    good = {r.doc_id: texts[r.doc_id] for r in quality.judge(docs, model).filter("kept").collect()}
    single = {i: good[i] for i, (_, c) in brute_jaccard(list(good.items())).items() if c == i}
    cut = {i: v[4].decode("utf-8", "ignore") for i, v in brute_repeats(list(single.items())).items()}
    frame = spark.createDataFrame(list(cut.items()), "doc_id bigint, text string")
    private = {r.doc_id: r.text for r in pii.pseudonymise(frame, pii.key_of(spark)).collect()}

    from parley.llm import packing
    import public_tokenizers

    expected = packing.pieces(spark.createDataFrame(list(private.items()), "doc_id bigint, text string"), public_tokenizers.path("byte_bpe_50k.json"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    found = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, expected.select(columns).collect()))


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
