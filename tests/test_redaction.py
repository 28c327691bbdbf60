"""Credentials and personal data in texts, filler, comments, scopes and questions: hand-worked cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from parley.functions.secrets import redact_all, redact_secrets, secret_name
from parley.operators import compress as C
from parley.operators import decisions as D
from parley.operators import vocabulary as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


@pytest.mark.parametrize(
    "text, expected",
    [
        ('{"password": "hunter22"}', '{"password": "[REDACTED]"}'),
        ("{'api_key': 'abc\\'def'}", "{'api_key': '[REDACTED]'}"),
        ('dbPassword = "longer than that"', 'dbPassword = "[REDACTED]"'),
        ("token: abcd1234efgh", "token: [REDACTED]"),
        ("token = get_token()", "token = get_token()"),
        ("secret: settings.key12345", "secret: settings.key12345"),
        ("token: something", "token: something"),
        ("token_count = 123456789", "token_count = 123456789"),
        ("max_tokens: 100000000", "max_tokens: 100000000"),
        ("DB_PASS=s3cret", "DB_PASS=[REDACTED]"),
        ("AWS_SECRET_ACCESS_KEY_ID='abc/def+ghi'", "AWS_SECRET_ACCESS_KEY_ID=[REDACTED]"),
        ("see postgres://ann:pw@host/db and https://host/a@b", "see postgres://[REDACTED]@host/db and https://host/a@b"),
        ("-----BEGIN RSA PRIVATE KEY-----\nMIIE\n-----END RSA PRIVATE KEY----- x", "[REDACTED PRIVATE KEY] x"),
        ("AKIA" + "A" * 16, "[REDACTED]"),
        ("monkey: banana12345", "monkey: banana12345"),
        ("", ""),
    ],
)
def test_secrets(spark, text, expected):
    assert one(spark, redact_secrets(F.lit(text))) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("to ann.b+c@corp.example.com, not git@host.org", "to [REDACTED], not git@host.org"),
        ("clone git@hub.example.com:x/y or me@hub.example.com:x", "clone git@hub.example.com:x/y or me@hub.example.com:x"),
        ("w@np.linalg.inv(cov)", "w@np.linalg.inv(cov)"),
        ("card 4111 1111 1111 1111 or 4111-1111-1111-1111, no 4111111111111112", "card [REDACTED] or [REDACTED], no 4111111111111112"),
        ("4111111111111111 4111111111111111", "[REDACTED] [REDACTED]"),
        ("ssn 123-45-6789, not 123-45-67890 or 9123-45-6789", "ssn [REDACTED], not 123-45-67890 or 9123-45-6789"),
        ('{"token": "a1b2c3d4", "mail": "a@b.org"}', '{"token": "[REDACTED]", "mail": "[REDACTED]"}'),
    ],
)
def test_persons(spark, text, expected):
    assert one(spark, redact_all(F.lit(text))) == expected


def test_long_texts_need_no_stack(spark):
    text = '{"token": "' + "a\\n" * 200_000 + '"} ' + "x = 1\n" * 50_000 + '"""' + 'a "b" ' * 100_000 + '"""'
    assert one(spark, F.length(redact_secrets(F.lit(text)))) == len(text) - 600_000 + len("[REDACTED]")
    assert one(spark, C.without_comments(F.lit(text))) == text


def test_secret_names(spark):
    names = {"password": True, "userPassword": True, "X-Api-Key": True, "client_secret": True, "secretary": False, "keyboard": False, "tokenizer": False, "accessKey": True, "DB_PASS": True, "db_pass": False, "public_key": False}
    assert {n: one(spark, secret_name(F.lit(n))) for n in names} == names


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Certainly! It is Paris.", "It is Paris."),
        ("Great question! Of course. That's a good question. Yes.", "Yes."),
        ("As an AI language model, Paris is it.", "As an AI language model, Paris is it."),
        ("As an AI language model, I think so.", "I think so."),
        ("Use it. I hope this helps! Feel free to ask about the rest of it.", "Use it. "),
        ("Sure, it is. Certainly not.", "Sure, it is. Certainly not."),
    ],
)
def test_filler(spark, text, expected):
    assert one(spark, C.without_filler(F.lit(text))) == expected


@pytest.mark.parametrize(
    "code, expected",
    [
        ('u = "http://a/*b*/c"\n', 'u = "http://a/*b*/c"\n'),
        ("d = '''\n# in\n'''\n# out\nx", "d = '''\n# in\n'''\nx"),
        ('"""\n// in "quotes" \\""" still\n"""\n  // out\ny /* z */ = 1', '"""\n// in "quotes" \\""" still\n"""\ny  = 1'),
        ("#!/bin/sh\n# gone\necho '# kept' # behind\n", "#!/bin/sh\necho '# kept' # behind\n"),
    ],
)
def test_comments(spark, code, expected):
    assert one(spark, C.without_comments(F.lit(code))) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Use redis for the order queue because it is fast", ["order", "queue"]),
        ("Use redis for session caching", ["session", "caching"]),
        ("Use redis for speed", []),
        ("The billing service now uses kafka", ["billing"]),
        ("the public web api is using jwt", ["public", "web", "api"]),
        ("Kafka for all of it", []),
        ("", []),
    ],
)
def test_scopes(spark, text, expected):
    assert one(spark, D.scope(F.lit(text))) == expected


def test_questions(spark):
    asked = {"Why did the build crash?": ["error"], "which file is it": ["file"], "What did we decide": ["decision"], "anything left to do": ["task"], "slowly it leaks": ["error"], "the weather": []}
    assert {q: one(spark, V.intents(F.lit(q))) for q in asked} == asked
    assert one(spark, V.asks_about_now(F.lit("Is it still red?"))) and not one(spark, V.asks_about_now(F.lit("distill it")))
    assert sorted(one(spark, V.query_words(F.lit("parseHTTPReply in src/old_code.py2")))) == sorted(["parsehttpreply", "parse", "http", "reply", "src/old_code.py2", "old", "code"])


def test_csv_records(spark):
    text = 'id,"a ""b""",note\r\n1,"x, y",plain\n\n2,"two\nlines",5" wide\n3,,"open'
    assert one(spark, C.csv_records(F.lit(text))) == [["id", 'a "b"', "note"], ["1", "x, y", "plain"], ["2", "two\nlines", '5" wide'], ["3", "", '"open']]
    assert one(spark, C.csv_records(F.lit('a\tb\n"1\t2"\t3'), "\t")) == [["a", "b"], ["1\t2", "3"]]
    assert one(spark, C.csv_records(F.lit(""))) == []
