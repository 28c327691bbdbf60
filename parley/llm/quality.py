"""Quality rules: base rules, then a log-likelihood ratio of hashed n-grams.

The target multinomial is that of words and word pairs, hashed into ``2**BITS`` buckets, in trusted documents; the raw
one is that of the whole corpus. A document's score is the mean over its n-grams of ``log(target / raw)``, both with
additive smoothing, so it is normalised for length. It is kept if it passes the base rules and its score reaches the
threshold.

Trusted documents are a bounded sample of the labelled ones: ``SAMPLE`` rows of smallest hash. Half of it (by another
hash) makes the target counts, the other half, unseen there, sets the threshold: the score that tells its good rows
from its bad ones with the fewest errors, the smallest such where several do. The raw counts cover every document and
all of its text. Without labels of both kinds there is no threshold, and the base rules decide alone.

Defined cases: a null or empty text has no words, so it fails the base rules; texts of any length are used whole;
repeated rows are judged each; of several labels of a document the lowest counts; null labels count nothing; an empty
table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.textio import distinct_spans, equal_spans, mix64, released, span_hashes, texts_of, window_hashes, words

BITS = 16
SAMPLE = 20_000
SMOOTHING = 0.5
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def per_text(before: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Differences of running totals at the texts' bounds."""
    return np.diff(before[offsets])


def running(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def base_features(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray, hashes: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    n_words = np.diff(before)
    owner = np.repeat(np.arange(n), n_words)
    lead = running((data & 0xC0) != 0x80)
    word_chars = np.bincount(owner, lead[ends] - lead[starts], n).astype(np.int64)
    n_symbols = per_text(running(_SYMBOL[data]), offsets)

    breaks = np.flatnonzero(data == 0x0A)
    # A line ends at the next line's start, less its newline; a text's last line ends where the text does.
    line_owner = np.repeat(np.arange(n), np.diff(np.searchsorted(breaks, offsets)) + 1)
    order = np.argsort(np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1]), kind="stable")
    line_starts = np.concatenate([offsets[:-1], breaks + 1])[order]
    last = np.append(line_owner[1:] != line_owner[:-1], True)
    line_ends = np.where(last, offsets[line_owner + 1], np.append(line_starts[1:] - 1, 0))
    with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_owner = line_starts[with_word], line_ends[with_word], line_owner[with_word]
    _, line = distinct_spans(data, line_starts, line_ends)
    by = np.lexsort((line, line_owner))
    same = (line[by][1:] == line[by][:-1]) & (line_owner[by][1:] == line_owner[by][:-1])
    n_dup_lines = np.bincount(line_owner[by][1:][same], minlength=n)

    repeated = np.zeros(len(starts) + 1, np.int64)
    w = window_hashes(hashes, REPEAT_WINDOW)
    if len(w):
        inside = np.flatnonzero(owner[: len(w)] == owner[REPEAT_WINDOW - 1 :])
        key = w[inside]
        by = np.lexsort((key, owner[inside]))
        same = (key[by][1:] == key[by][:-1]) & (owner[inside][by][1:] == owner[inside][by][:-1])
        if not _windows_equal(data, starts, ends, inside[by][1:][same], inside[by][:-1][same]):
            # Two windows have one hash: number the words, then the windows, by what they hold.
            _, number = distinct_spans(data, starts, ends)
            _, key = np.unique(np.stack([number[inside + k] for k in range(REPEAT_WINDOW)], axis=1), axis=0, return_inverse=True)
            by = np.lexsort((key, owner[inside]))
            same = (key[by][1:] == key[by][:-1]) & (owner[inside][by][1:] == owner[inside][by][:-1])
        again = np.zeros(len(by), bool)
        again[1:] |= same
        again[:-1] |= same
        at = inside[by[again]]
        np.add.at(repeated, at, 1)
        np.add.at(repeated, at + REPEAT_WINDOW, -1)
    covered = running(np.cumsum(repeated)[:-1] > 0)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": np.diff(covered[before])}


def _windows_equal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the windows of words that begin at ``a`` and at ``b`` hold the same words, for all pairs."""
    steps = np.arange(REPEAT_WINDOW)
    a, b = (a[:, None] + steps).ravel(), (b[:, None] + steps).ravel()
    return bool(equal_spans(data, starts[a], ends[a] - starts[a], starts[b], ends[b] - starts[b]).all())


def grams(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of pairs of neighbouring words, and the text that each is from."""
    pairs = window_hashes(hashes, 2)
    inside = owner[1:] == owner[:-1] if len(owner) else np.zeros(0, bool)
    h = np.concatenate([hashes, pairs[inside]])
    return (h >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([owner, owner[1:][inside]] if len(owner) else [owner])


@dataclass
class Model:
    ratio: np.ndarray  # log(target / raw) by bucket
    threshold: float

    def scores(self, hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        bucket, of = grams(hashes, owner)
        return np.bincount(of, self.ratio[bucket], n) / np.maximum(1, np.bincount(of, minlength=n))


def _hashed(data: np.ndarray, offsets: np.ndarray):
    starts, ends, before = words(data, offsets)
    return starts, ends, before, span_hashes(data, starts, ends), np.repeat(np.arange(len(offsets) - 1), np.diff(before))


def labelled(labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id") -> tuple[np.ndarray, np.ndarray]:
    """Ids and labels of the bounded sample."""
    one = labels.filter(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("quality").alias("quality"))
    rows = one.orderBy(F.xxhash64(id_col), id_col).limit(sample).select(F.col(id_col).cast("bigint").alias("i"), "quality").collect()
    return np.array([r.i for r in rows], np.int64), np.array([r.quality for r in rows], np.int64)


def counts(df: DataFrame, target_ids: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """N-gram counts by bucket, in the target documents and in all; each task sends at most one row a bucket."""
    wanted = np.sort(target_ids)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, raw = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in batches:
            ids = batch.column(0).fill_null(-(1 << 62)).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in texts_of(batch.column(1)):
                _, _, _, hashes, owner = _hashed(data, offsets)
                bucket, of = grams(hashes, owner)
                raw += np.bincount(bucket, minlength=1 << BITS)
                own = np.isin(ids[lo:hi], wanted)
                if own.any():
                    target += np.bincount(bucket[own[of]], minlength=1 << BITS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(target[at]), pa.array(raw[at])], names=["bucket", "target", "raw"])

    parts = df.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col)).mapInArrow(run, "bucket int, target bigint, raw bigint")
    table = parts.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toArrow()
    target, raw = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    at = table.column("bucket").to_numpy()
    target[at], raw[at] = table.column("target").to_numpy(), table.column("raw").to_numpy()
    return target, raw


def best_threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The smallest score with the fewest errors of "good reaches it, bad does not"."""
    if not len(good) or not len(bad):
        return -np.inf
    cuts = np.unique(np.concatenate([good, bad]))
    right = len(good) - np.searchsorted(np.sort(good), cuts) + np.searchsorted(np.sort(bad), cuts)
    return float(cuts[int(right.argmax())])


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    ids, quality = labelled(labels, sample, id_col)
    first = mix64(ids.view(np.uint64)) % np.uint64(2) == 0
    target, raw = counts(df, ids[first & (quality == 1)], id_col, text_col)
    smooth = lambda c: np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * len(c)))
    model = Model(smooth(target) - smooth(raw), -np.inf)
    if not target.sum():
        return model
    rest = {int(i): int(q) for i, q in zip(ids[~first], quality[~first], strict=True)}
    spark = df.sparkSession
    if rest:
        held = spark.createDataFrame([(i,) for i in rest], "held bigint")
        # The sample is bounded, so its ids may go to every executor.
        own = df.select(id_col, text_col).join(F.broadcast(held), F.col(id_col).cast("bigint") == F.col("held"), "left_semi")
        scored = judge(own, model, id_col, text_col).filter(~F.col("base_failed")).select(F.col(id_col).cast("bigint").alias("i"), "score").collect()
        by = lambda kind: np.array([r.score for r in scored if rest[r.i] == kind])
        model.threshold = best_threshold(by(1), by(0))
    return model


def verdict(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """``(base features, base_failed, kept, score)`` of the texts in ``data``."""
    starts, ends, before, hashes, owner = _hashed(data, offsets)
    f = base_features(data, offsets, starts, ends, before, hashes)
    failed = (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"])
    score = model.scores(hashes, owner, len(offsets) - 1)
    return f, failed, ~failed & (score >= model.threshold), score


def judge(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score)`` for each row."""
    kind = df.schema[id_col].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shared = df.sparkSession.sparkContext.broadcast((model.ratio.astype(np.float64), model.threshold))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            for lo, hi, data, offsets in texts_of(batch.column(1)):
                f, failed, kept, score = verdict(model, data, offsets)
                columns = [batch.column(0).slice(lo, hi - lo), *(pa.array(f[k].astype(np.int64)) for k in names)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(failed), pa.array(kept), pa.array(score)], names=[id_col, *names, "base_failed", "kept", "score"])

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{k} bigint" for k in names) + ", base_failed boolean, kept boolean, score double"
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def keep(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns."""
    shared = df.sparkSession.sparkContext.broadcast((model.ratio.astype(np.float64), model.threshold))
    place = df.columns.index(text_col)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            kept = [verdict(model, data, offsets)[2] for _, _, data, offsets in texts_of(batch.column(place))]
            yield batch.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, bool)))

    return df.mapInArrow(run, df.schema)
