"""Byte-level BPE encoding and decoding through a sentencepiece model.

The model is serialised here from the ranks alone: one NORMAL piece for each
token, its bytes mapped to printable characters, scored by the negative rank, and
an identity normaliser. Sentencepiece then merges what the ranks would merge
first. Texts are cut by the pre-token pattern and each pre-token is encoded by
itself; decoding maps pieces back to bytes.

Defined results: a null text counts as empty, an empty text has no tokens, any
byte sequence that is valid UTF-8 returns exactly, however long the text; special tokens
are never made; repeated rows are each encoded; an empty table gives no rows; extra columns
of the input are ignored by the digest.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .chunks import ChunkCache
from .common import pick, table

#: Text in a batch of results.
SLICE_BYTES = 4 << 20


def byte_chars() -> dict[int, str]:
    """A printable character for each byte: itself where printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes, varint or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the unknown piece comes last."""
    chars, normal, unknown, bpe = byte_chars(), 1, 2, 2
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[x] for x in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    out = [_field(1, _field(1, "".join(map(chars.__getitem__, t)).encode()) + _field(2, -float(r)) + _field(3, normal)) for r, t in enumerate(by_rank)]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    out.append(_field(2, _field(3, bpe) + _field(4, len(by_rank) + 1) + _field(40, len(by_rank))))
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class PieceBPE:
    """Encoder and decoder over a serialised model and a pre-token pattern."""

    def __init__(self, proto: bytes, pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.find = regex.compile(pattern).findall
        chars = byte_chars()
        self.to_char = {b: c for b, c in chars.items()}
        back = {c: b for b, c in chars.items()}
        self.bytes_of = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(self.model.get_piece_size() - 1)]
        self.ids_of = {t: i for i, t in enumerate(self.bytes_of)}
        self.chunks = ChunkCache(self._encode_many, lambda x: self._encode_many([x])[0])

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Packed little-endian ids of each text."""
        return list(self.chunks(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())))

    def _encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the length of each; a pre-token that is a token needs no merging."""
        cut = [[x.encode() for x in self.find(t)] for t in texts]
        ids, new = {}, []
        for x in {x for xs in cut for x in xs}:
            if x in self.ids_of:
                ids[x] = [self.ids_of[x]]
            else:
                new.append(x)
        found = self.model.encode(["".join(map(self.to_char.__getitem__, x)) for x in new], out_type=int, num_threads=1) if new else []
        ids.update(zip(new, found))
        lengths = np.array([sum([len(ids[x]) for x in xs]) for xs in cut], np.int64)
        return np.array([i for xs in cut for x in xs for i in ids[x]], np.uint32), lengths

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, keep: tuple[str, ...] = ("doc_id",), real: bool = True) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256 and decoded_sha256; with ``real`` also ids and decoded.

    The broadcast holds the vocabulary alone, whose size doesn't depend on the documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model_proto(ranks), pattern))
    fields = [docs.schema[c] for c in keep]
    from pyspark.sql import types as T

    schema = T.StructType([*fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if real:
        schema = schema.add("ids", T.BinaryType()).add("decoded", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PieceBPE(*shared.value)
        for batch in batches:
            size = np.cumsum(pc.binary_length(pc.fill_null(batch.column("text"), "")).to_numpy(zero_copy_only=False), dtype=np.int64)
            a = 0
            while a < batch.num_rows:  # some megabytes at a time
                b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + SLICE_BYTES)))
                yield rows(bpe, batch.slice(a, b - a))
                a = b

    def rows(bpe: PieceBPE, batch: pa.RecordBatch) -> pa.RecordBatch:
        n, ids, decoded, packed, plain = [], [], [], [], []
        for p in bpe.chunks(batch.column("text")):
            d = bpe.decode(p)
            n.append(len(p) // 4)
            ids.append(hashlib.sha256(p).hexdigest())
            decoded.append(hashlib.sha256(d).hexdigest())
            if real:
                packed.append(p)
                plain.append(d)
        columns = [*[batch.column(c) for c in keep], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
        if real:
            columns += [pa.array(packed, pa.binary()), pa.array(plain, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(*keep, "text").mapInArrow(run, schema)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    return encode_decode(docs, read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN, real=False)
