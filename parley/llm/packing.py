"""Best-fit packing by sums of squares.

Documents are tokenised and cut into pieces of at most ``capacity`` ids; the pieces are packed into sequences. A piece
of length ``s`` goes to the open sequence of gap ``g`` (to a new one if none can hold it) for which the sum
over all gaps of the squared number of open sequences of that gap becomes smallest: moving one from ``g`` to ``g - s``
changes it by ``2 * (N[g - s] - N[g] + 1)``, closed sequences counting nothing. Ties take the smallest gap.

Packing is dealt out to shards of about ``per_shard`` pieces by a hash of the document, so a shard is bounded whatever
the table's size. Within a shard pieces go in descending length; the remaining tail of open sequences is at most one
sequence's worth of waste a shard, if there are short pieces.

Defined cases: a null or empty text is one piece holding the end id; longer texts are cut from the end, so that only
their first piece can be short; repeated rows are packed each; an empty table gives no rows; other columns are left
alone. ``sequence_id`` is ``shard * 2**40 + number``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.pretokens import Memo
from parley.llm.textio import released, texts_of

CAPACITY = 2048
END_ID = 0
PER_SHARD = 200_000
SLICE = 4096


class Tokens:
    """Ids by the tokenizers library; texts that hold the special token's string are given to it whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo = Memo(self.encode)

    def encode(self, texts: list[str]) -> list[list[int]]:
        # The library's encodings are large next to their ids: a slice at a time.
        return [e.ids for lo in range(0, len(texts), SLICE) for e in self.tokenizer.encode_batch_fast(texts[lo : lo + SLICE], add_special_tokens=False)]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        raw = data.tobytes()
        ids, before = self.memo(data, offsets)
        out = [ids[before[k] : before[k + 1]] for k in range(len(offsets) - 1)]
        if any(s in raw for s in self.special):
            for k in range(len(out)):
                own = raw[offsets[k] : offsets[k + 1]]
                if any(s in own for s in self.special):
                    out[k] = np.array(self.encode([own.decode("utf-8", "replace")])[0], np.uint32)
        return out


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Tokens(path)


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``(id, piece, start, length, ids_crc32[, ids])``: every document's ids, then ``end_id``, cut into pieces."""
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens(path)
        for batch in batches:
            for lo, _, data, offsets in texts_of(batch.column(1), 2 << 20):
                rows, numbers, starts, lengths, sums, held = [], [], [], [], [], []
                for k, ids in enumerate(encode(data, offsets)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append(lo + k)
                        numbers.append(p)
                        starts.append(a)
                        lengths.append(b - a)
                        sums.append(zlib.crc32(ids[a:b].tobytes()))
                        if with_ids:
                            held.append(ids[a:b].astype("int32"))
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(held, pa.list_(pa.int32()))] * with_ids, names=names)

    schema = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """``(sequence, offset)`` of each piece, in the order given, by the sum-of-squares rule."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap; 0 and the capacity stay 0
    holders: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened = 0
    for k, s in enumerate(lengths.tolist()):
        if s >= capacity:
            sequence[k], opened = opened, opened + 1
            continue
        gaps = count[s:capacity]
        change = np.where(gaps > 0, 2 * (count[: capacity - s] - gaps), np.iinfo(np.int64).max)
        change[0] -= 1 if gaps[0] > 0 else 0  # a closed sequence leaves the sum: 2 N - 1 less, not 2 N - 2
        g = int(change.argmin()) + s
        # A new sequence is opened only where no open one fits: it would cost a sequence, not just a larger sum.
        if gaps[g - s] == 0:
            g, own = capacity, opened
            opened += 1
        else:
            own = holders[g].pop()
            count[g] -= 1
        sequence[k], offset[k] = own, capacity - g
        if g > s:
            holders[g - s].append(own)
            count[g - s] += 1
    return sequence, offset


def pack(pieces_df: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", per_shard: int = PER_SHARD) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length``; the pieces must be a table that can be read twice."""
    shards = max(1, -(-pieces_df.count() // per_shard))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces_df.schema.fields)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("length", "descending"), (id_col, "ascending"), ("piece", "ascending")])
        sequence, offset = place(table.column("length").to_numpy(), capacity)
        sequence += table.column("shard")[0].as_py() << 40
        table = table.drop_columns(["shard"])
        return table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    shard = F.pmod(F.xxhash64(F.col(id_col), F.col("piece")), F.lit(shards))
    return pieces_df.withColumn("shard", shard).groupBy("shard").applyInArrow(run, f"{fields}, sequence_id bigint, offset bigint")
