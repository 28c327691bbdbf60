"""Byte-level BPE encoding and decoding by a sentencepiece model that is serialised from the rank file.

Every vocabulary entry becomes a piece: its bytes are mapped one to one to printable characters, its score is the
negative rank, and the normaliser is the identity, so the merges of a pre-token are those of the ranks. Decoding maps
ids back to the bytes of their entries.

Defined cases: a null or empty text has no ids and decodes to nothing; texts of any length are encoded whole, repeated
rows each give a row, an empty table gives an empty result; other columns are left alone (only the two named ones are
read).
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.pretokens import Memo
from parley.llm.textio import released, texts_of

UNKNOWN = "⁇"


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where printable Latin-1, else the next one from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    out = {b: chr(b) for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return [out[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Entries by rank."""
    with open(path, "rb") as f:
        ranked = sorted((int(rank), base64.b64decode(entry)) for entry, rank in map(bytes.split, f))
    return [entry for _, entry in ranked]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise(entries: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: pieces (1), trainer spec (2: BPE) and normaliser spec (3: identity)."""
    shown = byte_alphabet()
    pieces = [("".join(shown[b] for b in entry), -float(rank), 1) for rank, entry in enumerate(entries)]
    pieces.append((UNKNOWN, 0.0, 2))
    out = [_field(1, _field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind)) for text, score, kind in pieces]
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, len(entries)) + b"".join(_varint(k << 3) + b"\xff" * 9 + b"\x01" for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        self.entries = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.entries))
        self.shown = {b: c for b, c in enumerate(byte_alphabet())}
        self.memo = Memo(self.encode_pretokens)
        self.decimal = [b"%d" % k for k in range(len(self.entries))]

    def encode_pretokens(self, pretokens: list[str]) -> list[list[int]]:
        return self.model.encode([p.encode("utf-8").decode("latin-1").translate(self.shown) for p in pretokens], num_threads=1)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` for each row; ``path`` is the rank file, present on every executor."""
    kind = df.schema[id_col].dataType.simpleString()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for lo, hi, data, offsets in texts_of(batch.column(1)):
                ids, before = c.memo(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(ids.astype("int32")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=[id_col, "ids"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, bytes binary)`` of each row of ids; null ids decode to nothing."""
    kind = df.schema[id_col].dataType.simpleString()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            out = [c.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "bytes"])

    return df.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and digest in one pass, so neither the ids nor the bytes leave the task that made them."""
    kind = df.schema[id_col].dataType.simpleString()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for lo, hi, data, offsets in texts_of(batch.column(1)):
                ids, before = c.memo(data, offsets)
                counts, shas, backs = [], [], []
                for k in range(hi - lo):
                    own = ids[before[k] : before[k + 1]].tolist()
                    counts.append(len(own))
                    shas.append(hashlib.sha256(b" ".join(map(c.decimal.__getitem__, own))).hexdigest())
                    backs.append(hashlib.sha256(c.decode(own)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(counts, pa.int64()), pa.array(shas), pa.array(backs)],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
