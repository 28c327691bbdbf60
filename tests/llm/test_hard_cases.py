"""Nulls, very long texts, names that clash and inputs made to break an operator, for all ten."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import time
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from brute import base_features
from brute import jaccard as brute_jaccard
from brute import repeats as brute_repeats
from pyspark.sql import functions as F

from parley.llm import bpe, chat, html, jaccard, packing, pii, quality, repeats, textio, urls, vectors

KEY = "a key of the tests"
RANKS, TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


# Polynomial hashes modulo 2**64 take each pair for one word, whatever their base.
TWINS = [(2 * k, thue_morse(n, "a", "b")) for k, n in enumerate((1024, 2048, 4096))] + [(2 * k + 1, thue_morse(n, "b", "a")) for k, n in enumerate((1024, 2048, 4096))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_twins_are_told_apart():
    data = np.frombuffer("".join(t for _, t in TWINS).encode(), np.uint8)
    ends = np.cumsum([len(t) for _, t in TWINS])
    starts = ends - [len(t) for _, t in TWINS]
    assert len(set(textio.span_hashes(data, starts, ends).tolist())) == len(TWINS)
    first, number = textio.distinct_spans(data, np.append(starts, starts), np.append(ends, ends))
    assert len(first) == len(TWINS) and number[: len(TWINS)].tolist() == number[len(TWINS) :].tolist()


def test_equal_hashes_are_compared(monkeypatch):
    """With a hash that takes all for one, the bytes decide."""
    monkeypatch.setattr(textio, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    words = [b"ab", b"abc", b"ab", b"x" * 700, b"x" * 699 + b"y", b"abc", b"", b"x" * 700]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    _, number = textio.distinct_spans(data, ends - [len(w) for w in words], ends)
    assert [number[k] == number[j] for k in range(8) for j in range(8)] == [a == b for a in words for b in words]


def test_twins_in_bpe(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*TWINS, (90, " ".join(t for _, t in TWINS))]
    for r in bpe.digests(frame(spark, rows).coalesce(1), RANKS).collect():
        ids = enc.encode_ordinary(dict(rows)[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_twins_in_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    found = {}
    for r in packing.pieces(frame(spark, TWINS).coalesce(1), TOKENIZER, with_ids=True).orderBy("doc_id", "piece").collect():
        found.setdefault(r.doc_id, []).extend(r.ids)
    assert found == {i: [*t.encode(text, add_special_tokens=False).ids, 0] for i, text in TWINS}


def test_twins_in_quality(spark):
    rows = [(1, "\n".join(t for _, t in TWINS[:1] + TWINS[3:4])), (2, " ".join(t for _, t in TWINS[:1] + TWINS[3:4]) + " " + "a b c d e f g " + TWINS[0][1] + " a b c d e f g " + TWINS[3][1]), (3, None)]
    model = quality.Model(np.zeros(1 << quality.BITS), -np.inf)
    for r in quality.judge(frame(spark, rows), model).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_features(dict(rows)[r.doc_id])


def test_twins_in_jaccard(spark):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(frame(spark, TWINS)).collect()} == brute_jaccard(TWINS)


def test_twins_in_repeats(spark):
    rows = [*TWINS, (70, TWINS[0][1][:600] + TWINS[4][1][:900])]
    assert {r.doc_id: tuple(r)[1:] for r in repeats.digests(frame(spark, rows)).collect()} == {i: v[:4] for i, v in brute_repeats(rows).items()}


def test_long_lists_are_dealt_out(spark, monkeypatch):
    """Documents that share rare shingles without linking: the pairs of a list go to several tasks, and none is lost."""
    rng, words = random.Random(2), [f"w{k}" for k in range(4000)]
    shared = words[:12]
    docs = [(k, " ".join(shared + rng.sample(words[100:], 25))) for k in range(60)]
    docs += [(100 + k, " ".join(docs[k][1].split()[:-1] + ["x"])) for k in range(20)]
    monkeypatch.setattr(jaccard, "MANY_PAIRS", 50)
    monkeypatch.setattr(jaccard, "CHUNK", 7)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(frame(spark, docs)).collect()} == brute_jaccard(docs)


def test_null_ids_in_jaccard(spark):
    text, other = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    df = frame(spark, [(None, text), (7, text), (9, text), (None, other), (None, other), (None, None), (3, "")]).withColumn("doc", F.lit(1))
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar(df).collect()), key=repr)
    assert found == sorted([(None, 3, 7), (7, 3, 7), (9, 3, 7), (None, 2, None), (None, 2, None), (None, 0, None), (3, 0, 3)], key=repr)
    kept = jaccard.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(7, text), (None, other), (None, None), (3, "")], key=repr)


def test_null_ids_elsewhere(spark):
    df = frame(spark, [(None, "a b"), (None, None), (1, "word")])
    assert [r.n_tokens for r in bpe.digests(df, RANKS).filter("doc_id IS NULL").collect()].count(0) == 1
    model = quality.fit(df, spark.createDataFrame([(None, 1, 0), (1, 1, 0)], "doc_id bigint, quality int, toxic int"))
    assert quality.judge(df, model).filter("doc_id IS NULL").count() == 2 and quality.keep(df, model).count() == 0
    assert pii.pseudonymise(df, KEY).filter("doc_id IS NULL").count() == 2
    packed = packing.pack(packing.pieces(df, TOKENIZER)).collect()
    assert len(packed) == 3 and sum(r.length for r in packed) == sum(r.length for r in packing.pieces(df, TOKENIZER).collect())
    pages = spark.createDataFrame([(None, "x://a.com/", "<p>t</p>"), (None, None, None)], "page_id bigint, url string, html string")
    assert urls.judge(pages, {"com/": "block"}, []).filter("verdict = 'block' AND rule = 'com/'").count() == 1
    assert html.extract(pages).count() == 2


def test_clash_in_repeats(spark):
    df = frame(spark, [(1, "x" * 300), (2, "y")]).withColumn("kept text", F.lit(5)).withColumn("a.b", F.lit(6))
    kept = repeats.kept_texts(df)
    assert kept.columns == df.columns and {(r.doc_id, len(r.text), r["kept text"], r["a.b"]) for r in kept.collect()} == {(1, 1, 5, 6), (2, 1, 5, 6)}


def test_long_addresses(spark):
    long_ = "a@" + "a." * 500_000
    rows = [(1, long_), (2, "b" * 500_000 + "@example.com"), (3, "9" * 1_000_000), (4, "+1" * 200_000 + "(" * 1000), (5, "1.2" * 300_000 + "f" * 1000)]
    out = {r.doc_id: r.text for r in pii.pseudonymise(frame(spark, rows), KEY).collect()}
    assert out[1] == long_ and out[3] == rows[2][1] and out[2].endswith(".com") and len(out[2]) == len(rows[1][1]) and out[2] != rows[1][1]


@pytest.mark.parametrize(
    ("value", "shape"),
    [
        ("+12125550123", r"\+1\d{10}"), ("(212) 555-0123", r"\(\d{3}\) \d{3}-\d{4}"), ("212-555-0123", r"\d{3}-\d{3}-\d{4}"), ("+49 30 1234567", r"\+49 \d\d \d{7}"), ("3782 822463 10005", r"\d{4} \d{6} \d{5}"),
        ("03.04.1987", r"\d\d\.\d\d\.\d{4}"), ("4/3/1987", r"\d\d?/\d\d?/\d{4}"), ("12/25/1987", r"\d\d/\d\d/\d{4}"), ("12/30/1987", r"12/30/\d{4}"), ("02/29/1988", r"02/29/\d{4}"), ("2/14/1990", r"\d\d?/\d\d?/\d{4}"),
    ],
)
def test_formats(spark, value, shape):
    out = [r.text for r in pii.pseudonymise(frame(spark, [(1, f"it is {value}, so"), (2, value)]), KEY).orderBy("doc_id").collect()]
    assert re.fullmatch(shape, out[1]) and out[0] == f"it is {out[1]}, so" and out[1] != value


def test_dates_are_permuted(spark):
    days = spark.range(73049).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    late = days.filter("dayofmonth(d) > 12").select(F.date_format("d", "MM/dd/yyyy").alias("v"))
    moved = late.select(pii.pseudonym(F.col("v"), KEY).alias("p"))
    assert moved.distinct().count() == late.count() and moved.filter("try_to_date(p, 'MM/dd/yyyy') IS NULL OR substring(p, 4, 2) <= '12'").count() == 0


def test_the_key_is_the_sessions(spark):
    assert len(pii.key_of(spark)) >= 32 and pii.key_of(spark) == pii.key_of(spark)


def test_double_vectors(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1e200]), (3, [1e-200, 1e-200]), (4, [-1e300, 1e300]), (5, [0.0, 0.0]), (6, [float("inf"), 1.0]), (None, [2.0, 2.0]), (8, [1.0, 1.0 + 1e-12])]
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert found == {1: (4, 1, True), 2: (4, 1, False), 3: (4, 1, False), 4: (0, 4, True), 5: (0, 5, True), 6: (0, 6, True), None: (4, 1, False), 8: (4, 1, False)}


def test_long_hosts(spark):
    host = "a." * 10_000 + "spam.net"
    pages = spark.createDataFrame([(1, f"http://{host}/en/{'p' * 100_000}"), (2, "http://" + "." * 5000 + "com/en/x")], "page_id bigint, url string")
    out = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, {"com/en/": "block"}, ["spam.net"]).collect()}
    assert out == {1: (None, "block"), 2: ("com/en/", "block")}


def test_verdicts_come_from_the_cascades(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "x://a.com/en/1"), (2, "x://b.org/")], "page_id bigint, url string")
    monkeypatch.setattr(urls, "build", lambda *a: urls.Cascade([]))
    assert {r.verdict for r in urls.judge(pages, {"com/en/": "block"}, ["b.org"]).collect()} == {"allow"}


class Articles(HTMLParser):
    """A second writing: the blocks of marked articles, by the parser of the standard library."""

    def __init__(self):
        super().__init__()
        self.depth, self.found, self.held = 0, [], []

    def block(self):
        text = " ".join("".join(self.held).split())
        self.held.clear()
        if text and self.depth:
            self.found.append(text)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.held.append(" ")
        elif tag in html.BLOCK_TAGS:
            self.block()
            self.depth += tag == "article"

    def handle_endtag(self, tag):
        if tag in html.BLOCK_TAGS:
            self.block()
            self.depth -= tag == "article"

    def handle_data(self, data):
        self.held.append(data)


def test_pages_against_a_second_writing(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    expected = {}
    for r in pages.collect():
        own = Articles()
        own.feed(r.html or "")
        own.close()
        own.block()
        expected[r.page_id] = "\n".join(own.found)
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == expected


WORDS = {
    "en": "the of and to in is that it for on with house river green morning letter winter stone question".split(),
    "it": "il di che per sono della nel alla più ma casa fiume verde mattina lettera inverno pietra domanda".split(),
    "xx": "zuk maro telik vosta prend kilo mursa dantel fosk rell tivo sando".split(),
}


def made_page(rng, lang, article):
    say = lambda n: " ".join(rng.choice(WORDS[lang]) for _ in range(n)).capitalize() + "."
    body = [say(rng.choice([4, 12, 60, 90])) for _ in range(rng.randint(4, 9))]
    body[len(body) // 2] = say(80)
    link = lambda: f"<li><a href='/x'>{say(rng.randint(1, 3))}</a></li>"
    core = f"<h1 class='share-title'>{say(5)}</h1>" + "".join(f"<p>{t}</p>" for t in body)
    core = f"<article>{core}</article>" if article else f"<div class='page has-sidebar'>{core}</div>"
    noise = f"<div class='comments'><p>{say(50)}</p></div><div id=cookie-banner>{say(15)}</div><aside>{say(30)}</aside><form><p>{say(9)}</p></form>"
    return f"<html><body><nav><ul>{link() * 5}</ul></nav>{core}{noise}<ul>{''.join(link() for _ in range(8))}</ul><footer>{say(20)}</footer></body></html>", body


def test_recall_on_made_pages():
    """Pages that no rule was fitted on: the words of the article kept, and words kept of the article, both over nine tenths."""
    rng = random.Random(77)
    right = kept = whole = 0
    for k in range(300):
        page, body = made_page(rng, ("en", "it", "xx")[k % 3], k % 2 == 0)
        found = html.main_text(page).split("\n")
        right += sum(len(t) for t in found if t in body)
        kept += sum(map(len, found[1:]))  # but for the heading
        whole += sum(map(len, body))
    assert right >= 0.9 * whole and right >= 0.9 * kept


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><h2 class="share-title">Share</h2><p class="related">What is related to it.</p></article>', "Share\nWhat is related to it."),
        ("<article><p>See <a href=x>a link that is nearly all of this</a></p></article>", "See a link that is nearly all of this"),
        ("<nav><a href=x>x</a></nav><h1>Head</h1><p>One two.</p><p>Three.</p><footer>f</footer>", "Head\nOne two.\nThree."),
        ("<form><div class='no-ads with-comments'><main><p>Kept.</p></main></div></form>", "Kept."),
        ("<p class=ad>Buy it<h2>Title</h2><p>Text.</p>", "Title\nText."),
    ],
)
def test_pages_by_hand(page, text):
    assert html.main_text(page) == text


def test_deep_and_unmatched_tags():
    began = time.perf_counter()
    html.main_text("<div>" * 100_000 + "</p></x></section>" * 100_000)
    assert time.perf_counter() - began < 20


def test_level_is_read_from_the_text(spark):
    rows = [(1, 0, "user", "</s> [INST] x"), (1, 1, "assistant", "\\</s>"), (2, 0, "user", "plain")]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    back = chat.read_back(out.withColumn("level", F.lit(0)).withColumn("turns", F.lit(None)))
    assert {r.conv_id: [(t.role, t.text) for t in r.parsed] for r in back.collect()} == {1: [("user", rows[0][3]), ("assistant", rows[1][3])], 2: [("user", "plain")]}


def test_many_turns(spark):
    turns = spark.range(3000).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('</s>', id) text")
    row = chat.digests(turns).collect()[0]
    expected = "".join(f"</s>{k}" for k in range(1, 3000, 2))
    assert row.n_turns == 3000 and row.loss_sha256 == hashlib.sha256(expected.encode()).hexdigest()
