"""Pseudonyms and quality scores of the whole smallest table against plain second writings."""

from __future__ import annotations

import numpy as np
import pytest
import regex
from brute import log_ratios, pseudonym
from pyspark.sql import functions as F

from parley.llm import pii, quality
from parley.llm.textio import span_hashes, window_hashes

DATA = "/root/testdata/sf0.001"
KEY = "a key of the tests"
PLANTED = [
    "card 4111 1111 1111 1111, 4111111111111111, bad 4111111111111112, amex 3782 822463 10005", "ssn 123-45-6789, 666-12-1234, 900-12-1234", "on 1987-03-04, 04/03/1987, 4.3.1987 or 31.02.1999 and 1899-12-31",
    "mail éré.34@mail7.example.com and a+b@x.co, not a@b", "hosts 10.0.0.1, 256.1.1.1, 1.2.3.4.5", "+1 (017) 555-7713, +12125550123, (212) 555-0123, 212-555-0123, +1", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce " + "AB" * 20,
]


def test_pseudonyms_of_all_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(PLANTED)], "doc_id bigint, text string"))
    alphabets = pii.PLAIN
    # Digits and words of other scripts do not occur here, so their classes need not be ASCII.
    find = regex.compile(pii.ANY)
    expected = {r.doc_id: r.text and find.sub(lambda m: pseudonym(m[0], KEY, alphabets), r.text) for r in docs.collect()}
    found = {r.doc_id: r.text for r in pii.pseudonymise(docs, KEY).collect()}
    assert found == expected
    assert sum(found[r.doc_id] != r.text for r in docs.collect()) >= len(PLANTED)


def test_scores_of_all_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").filter("doc_id % 3 <> 1")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.fit(docs, labels)
    ids, kind = quality.labelled(labels)
    first = quality.mix64(ids.view(np.uint64)) % np.uint64(2) == 0

    def buckets(words):
        if not words:
            return []
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        size = np.array([len(w.encode()) for w in words])
        ends = np.cumsum(size + 1) - 1
        h = span_hashes(data, ends - size, ends)
        return (np.concatenate([h, window_hashes(h, 2)]) >> np.uint64(48)).tolist()

    scores = log_ratios({r.doc_id: r.text for r in docs.collect()}, set(ids[first & (kind == 1)].tolist()), buckets, quality.SMOOTHING)
    judged = quality.judge(docs, model).select("doc_id", "score", "base_failed", "kept").collect()
    assert {r.doc_id: r.score for r in judged} == pytest.approx(scores, abs=1e-9)
    assert all(r.kept == (not r.base_failed and r.score >= model.threshold) for r in judged)
    # The threshold is one of the held-out scores, and no other cut makes fewer errors on them.
    held = [(scores[i], q) for i, q in zip(ids[~first].tolist(), kind[~first].tolist(), strict=True) if i in scores and not next(r.base_failed for r in judged if r.doc_id == i)]
    errors = lambda cut: sum((s >= cut) != (q == 1) for s, q in held)
    assert errors(model.threshold - 1e-9) == min(errors(s - 1e-9) for s, _ in held)


def test_an_ipv4_beyond_255_stays(spark):
    out = spark.createDataFrame([("256.1.1.1 and 1.2.3.4.5",)], "text string")
    assert pii.pseudonymise(out, KEY).select(F.col("text")).collect()[0][0].startswith("256.1.1.1 ")


def test_one_number_has_one_pseudonym_in_all_spellings(spark):
    rows = ["+1 212 555 0123", "+12125550123", "+1 (212) 555-0123", "+49 30 1234567", "+49301234567", "+358 40 123 4567", "+358401234567"]
    out = [r.text for r in pii.pseudonymise(spark.createDataFrame([(t,) for t in rows], "text string"), KEY).collect()]
    digits = ["".join(c for c in t if c.isdigit()) for t in out]
    assert len({*digits[:3]}) == 1 and digits[3] == digits[4] and digits[5] == digits[6] and len(set(digits)) == 3
    assert all(a != b and [c for c in a if not c.isdigit()] == [c for c in b if not c.isdigit()] for a, b in zip(rows, out, strict=True))
    assert out[0].startswith("+1 ") and out[3].startswith("+49 ") and out[5].startswith("+358 ")


def test_letters_of_other_scripts_move(spark):
    names = ["иван.петров@пример.рф", "łukasz@przykład.pl", "γιώργος@παράδειγμα.ελ", "用户@例子.公司", "x@" + "a." * 300 + "com", "x@" + "ab-c." * 200 + "7"]
    out = [r.text for r in pii.pseudonymise(spark.createDataFrame([(t,) for t in names], "text string"), KEY).collect()]
    assert out[0].endswith(".рф") and out[1].endswith(".pl") and out[3].endswith(".公司") and out[4].endswith(".com")
    for a, b in zip(names, out, strict=True):
        cut = a.rindex(".")
        assert len(a) == len(b) and a.count(".") == b.count(".") and regex.fullmatch(r"[\p{L}\p{N}._%+@-]+", b)
        letters = [(x, y) for x, y in zip(a[:cut], b, strict=False) if x.isalpha()]
        assert sum(x == y for x, y in letters) < max(2, len(letters) // 4), (a, b)
    there = pii.permute_text(F.lit("Ελληνικά и кириллица 漢字 ñ ł"), KEY)
    assert spark.range(1).select(pii.permute_text(there, KEY, inverse=True)).collect()[0][0] == "Ελληνικά и кириллица 漢字 ñ ł"


def test_no_plan_shows_the_key(spark, capsys):
    out = pii.pseudonymise(spark.createDataFrame([("+1 212 555 0123", 1)], "text string, key int"), "key-of-this-very-test")
    assert out.columns == ["text", "key"]
    for how in ("extended", "formatted", "codegen"):
        out.explain(how)
    out.collect()
    assert "key-of-this-very-test" not in capsys.readouterr().out
