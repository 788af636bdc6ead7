"""Token ids in one compressed file a shard: a wavelet matrix with rank and select.

File of a shard, little endian: ``WMX2``, the size of the head (u32) and the head, a zstd
frame of bits (u8), n (u64), n_docs (u64), n_symbols (u64); n_docs doc ids (i64), a packed
bit for each that says if the id is null, n_docs + 1 starts (u64), the symbols that occur
in ascending order (u32), whose places are what the planes hold; for each bit from the
highest down the count of zeros (u64) and the directory, the ones before each block of 512
bits (u64); and the size of each following frame (u32). Then the planes (packed bits, padded
to 64 bytes), each in zstd frames of ``STRETCH`` bytes. Reading a token, counting or looking
one up unpacks the head once and of the planes only the stretches that it touches.

Documents go to shards in ascending doc_id (nulls first, equal ids by the text's
hash). Shards travel as rows of a Parquet table in the shared folder, since
executors may have no other path to it; ``save_files``-like copies need nothing
but the binary column.

Defined results: a null or empty text has only the end id; an empty table gives
no shard and no row; a text longer than a shard gets one of its own; repeated rows are
each written; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import byte_chars
from .chunks import ChunkCache, gathered
from .common import pick, stored, table

BLOCK = 512
#: Ids in a shard before the next is begun; bounds what a task holds.
SHARD_IDS = 1 << 21
#: Bytes of a plane in a frame.
STRETCH = 1 << 16


class Plane:
    """A plane as read from a file: bytes of it are unpacked where they are asked for."""

    def __init__(self, frames: list[memoryview], size: int):
        self.frames, self.size = frames, size
        self.open: dict[int, np.ndarray] = {}
        self.whole: np.ndarray | None = None

    def __len__(self) -> int:
        return self.size

    def stretch(self, k: int) -> np.ndarray:
        if k not in self.open:
            self.open[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.frames[k]), np.uint8)
        return self.open[k]

    def __getitem__(self, at: int | slice) -> np.ndarray:
        if not isinstance(at, slice):
            return self.stretch(at // STRETCH)[at % STRETCH]
        a, b, _ = at.indices(self.size)
        parts = [self.stretch(k)[max(0, a - k * STRETCH) : b - k * STRETCH] for k in range(a // STRETCH, -(-b // STRETCH))]
        return np.concatenate([np.zeros(0, np.uint8), *parts]) if len(parts) != 1 else parts[0]

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        if self.whole is None:
            self.whole = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(f) for f in self.frames), np.uint8)
        return self.whole


class WaveletMatrix:
    """Succinct sequence of ``bits``-bit symbols."""

    def __init__(self, n: int, bits: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.bits, self.zeros, self.planes, self.ranks = n, bits, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        zeros, planes, ranks = [], [], []
        rest = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        for b in range(bits - 1, -1, -1):
            one = rest & rest.dtype.type(1 << b) != 0
            packed = np.packbits(one, bitorder="little")
            plane = np.zeros(-(-max(len(ids), 1) // BLOCK) * BLOCK // 8, np.uint8)
            plane[: len(packed)] = packed
            counts = np.bitwise_count(plane.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint64)
            planes.append(plane)
            ranks.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(counts, dtype=np.uint64)]))
            zeros.append(len(ids) - int(ranks[-1][-1]))
            rest = np.concatenate([np.compress(~one, rest), np.compress(one, rest)])
        return cls(len(ids), bits, zeros, planes, ranks)

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before position i."""
        block, rest = divmod(i, BLOCK)
        part = self.planes[level][block * BLOCK // 8 : block * BLOCK // 8 + (rest + 7) // 8]
        ones = int(np.bitwise_count(part).sum())
        if rest % 8:
            ones -= int(part[-1] >> (rest % 8)).bit_count()
        return int(self.ranks[level][block]) + ones

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (i & 7)) & 1

    def access(self, i: int) -> int:
        """The symbol at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        """Where the occurrences of the symbol before position i lie after the last level."""
        lo, hi = 0, i
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            one = symbol >> (self.bits - 1 - level) & 1
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if one else (lo - a, hi - b)
        return lo, hi

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of the symbol before position i."""
        if symbol >> self.bits:
            return 0
        lo, hi = self._range(symbol, min(i, self.n))
        return hi - lo

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th occurrence, from 0."""
        if symbol >> self.bits:
            raise IndexError(k)
        lo, hi = self._range(symbol, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in range(self.bits - 1, -1, -1):
            one = symbol >> (self.bits - 1 - level) & 1
            at = self._place(level, one, at - self.zeros[level] if one else at)
        return at

    def _place(self, level: int, bit: int, k: int) -> int:
        """Position in a plane of its k-th one or zero."""
        before = self.ranks[level] if bit else np.arange(len(self.ranks[level]), dtype=np.uint64) * np.uint64(BLOCK) - self.ranks[level]
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def ranks_at(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """Occurrences of the symbol before each of many positions."""
        lo, hi = np.zeros(1, np.int64), at.astype(np.int64)
        for level in range(self.bits):
            words = np.append(np.asarray(self.planes[level]).view(np.uint64), np.uint64(0))
            upto = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            ones = [upto[x >> 6] + np.bitwise_count(words[x >> 6] & ((np.uint64(1) << (x & 63).astype(np.uint64)) - np.uint64(1))) for x in (lo, hi)]
            one = symbol >> (self.bits - 1 - level) & 1
            lo, hi = (self.zeros[level] + y if one else x - y for x, y in zip((lo, hi), ones))
        return hi - lo

    def find(self, symbol: int) -> list[int]:
        """All positions of the symbol."""
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def decode(self) -> np.ndarray:
        """All symbols: the stable partitions undone from the lowest bit up."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(np.asarray(self.planes[level]), count=self.n, bitorder="little").view(bool)
            above = np.empty_like(out)
            above[np.flatnonzero(~one)] = out[: self.zeros[level]]
            above[np.flatnonzero(one)] = out[self.zeros[level] :] | out.dtype.type(1 << (self.bits - 1 - level))
            out = above
        return out


@dataclass
class Shard:
    """A shard's documents and ids, as read from its file."""

    matrix: WaveletMatrix
    symbols: np.ndarray
    starts: np.ndarray
    doc_ids: list[int | None]

    def _place(self, token: int) -> int | None:
        i = int(np.searchsorted(self.symbols, token))
        return i if i < len(self.symbols) and self.symbols[i] == token else None

    def access(self, i: int) -> int:
        return int(self.symbols[self.matrix.access(i)])

    def count(self, token: int) -> int:
        place = self._place(token)
        return 0 if place is None else self.matrix.count(place)

    def counts_in(self, token: int, starts: np.ndarray) -> np.ndarray:
        """Occurrences of a token between each position and the next."""
        place = self._place(token)
        return np.zeros(max(0, len(starts) - 1), np.int64) if place is None else np.diff(self.matrix.ranks_at(place, starts))

    def find(self, token: int) -> list[int]:
        """All positions of a token."""
        place = self._place(token)
        return [] if place is None else self.matrix.find(place)

    def decode(self) -> np.ndarray:
        return self.symbols[self.matrix.decode()] if self.matrix.n else self.symbols[:0]


def write_shard(ids: np.ndarray, starts: np.ndarray, doc_ids: list[int | None]) -> bytes:
    seen = np.bincount(ids) > 0 if len(ids) else np.zeros(0, bool)
    symbols = np.flatnonzero(seen).astype("<u4")
    bits = max(1, (len(symbols) - 1).bit_length())
    place = np.cumsum(seen) - 1
    m = WaveletMatrix.build(place.astype(np.uint16 if bits <= 16 else np.uint32)[ids], bits)
    null = np.packbits([x is None for x in doc_ids], bitorder="little") if doc_ids else np.zeros(0, np.uint8)
    pack = zstandard.ZstdCompressor(level=1).compress
    head = [struct.pack("<BQQQ", bits, len(ids), len(doc_ids), len(symbols)), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), null.tobytes(), starts.astype("<u8").tobytes(), symbols.tobytes()]
    frames = []
    for z, plane, ranks in zip(m.zeros, m.planes, m.ranks):
        head += [struct.pack("<Q", z), ranks.tobytes()]
        frames += [pack(plane[i : i + STRETCH].tobytes()) for i in range(0, len(plane), STRETCH)]
    first = pack(b"".join([*head, np.array([len(x) for x in frames], "<u4").tobytes()]))
    return b"".join([b"WMX2", struct.pack("<I", len(first)), first, *frames])


def read_shard(data: bytes) -> Shard:
    if data[:4] != b"WMX2":
        raise ValueError("not a wavelet shard")
    size = struct.unpack_from("<I", data, 4)[0]
    raw = zstandard.ZstdDecompressor().decompress(memoryview(data)[8 : 8 + size])
    bits, n, n_docs, n_symbols = struct.unpack_from("<BQQQ", raw, 0)
    at = struct.calcsize("<BQQQ")

    def take(dtype: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, dtype, count, at)
        at += out.nbytes
        return out

    ids, nulls, starts, symbols = take("<i8", n_docs), take("u1", -(-n_docs // 8)), take("<u8", n_docs + 1), take("<u4", n_symbols)
    null = np.unpackbits(nulls, count=n_docs, bitorder="little")
    zeros, ranks = [], []
    blocks = -(-max(n, 1) // BLOCK)
    for _ in range(bits):
        zeros.append(int(take("<u8", 1)[0]))
        ranks.append(take("<u8", blocks + 1))
    each = -(-(blocks * BLOCK // 8) // STRETCH)
    ends = 8 + size + np.concatenate([[0], np.cumsum(take("<u4", bits * each), dtype=np.int64)])
    frames = [memoryview(data)[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    planes = [Plane(frames[k * each : (k + 1) * each], blocks * BLOCK // 8) for k in range(bits)]
    return Shard(WaveletMatrix(n, bits, zeros, planes, ranks), symbols, starts.astype(np.int64), [None if k else int(x) for x, k in zip(ids, null)])


class Encoder:
    """The tokenizers library behind a word cache, on one core: Spark keeps the others busy.

    Words of letters are pre-tokens already. Where the file's pre-tokens are byte-level, they
    go to its BPE model mapped to its characters, many in one call, parted by carriage returns.
    """

    def __init__(self, tokenizer: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.model = Tokenizer.from_str(tokenizer)
        spec = json.loads(tokenizer)
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        level = spec.get("pre_tokenizer") or {}
        self.words = None
        if level.get("type") == "ByteLevel" and level.get("use_regex", True) and not level.get("add_prefix_space") and not spec.get("normalizer") and byte_chars()[13] in spec["model"]["vocab"]:
            self.chars = byte_chars()
            self.mark = spec["model"]["vocab"][self.chars[13]]
            kept = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
            merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in spec["model"]["merges"]]
            options = {k: spec["model"][k] for k in kept if spec["model"].get(k) is not None}
            # words come once, so the library's own cache would only cost
            self.words = Tokenizer(models.BPE(vocab=spec["model"]["vocab"], merges=merges, cache_capacity=0, **options))
            self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.cache = ChunkCache(self.encode_words, self.encode_text, limit=300_000, batch_bytes=12 << 20)

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Packed ids of each text; those with an added token's text, which the library cuts first, are encoded whole."""
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), bool)
        for x in self.added:
            whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        plain = self.cache(pc.if_else(pa.array(whole), "", texts) if whole.any() else texts)
        for i, packed in enumerate(plain):
            yield self.encode_text(texts[i].as_py()).astype("<u4").tobytes() if whole[i] else packed

    def encode_text(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and the length of each."""
        lead = {" ": self.chars[32], "\n": self.chars[10] + "\n"} if self.words else {}  # a line end is a pre-token of its own
        letters, mapped, other = [], [], []
        for i, w in enumerate(words):
            x = w[1:]
            if self.words and x.isalpha():
                letters.append(i)
                mapped.append(lead[w[0]] + (x if x.isascii() else x.encode().decode("latin-1").translate(self.chars)))
            else:
                other.append(i)
        fast, rest, parts, lengths = np.array(letters, np.int64), np.array(other, np.int64), [], np.zeros(len(words), np.int64)
        for a in range(0, len(fast), 16_384):
            found = self.words.encode_batch_fast([f"\n{self.chars[13]}\n".join(mapped[a : a + 16_384])], add_special_tokens=False)[0].ids
            ids = np.fromiter(found, np.uint32, len(found))
            ends = ids == self.mark
            lengths[fast[a : a + 16_384]] = np.diff(np.flatnonzero(ends), prepend=-1, append=len(ids)) - 1
            parts.append(ids[~ends])
        for x, i in zip(self.model.encode_batch_fast([words[i] for i in rest.tolist()], add_special_tokens=False), rest.tolist()):
            parts.append(np.array(x.ids, np.uint32))
            lengths[i] = len(parts[-1])
        flat, order = np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.concatenate([fast, rest])
        if not len(fast) or not len(rest):
            return flat, lengths
        first = np.empty(len(words), np.int64)
        first[order] = np.cumsum(lengths[order]) - lengths[order]
        return gathered(flat, first, lengths), lengths


#: The encoder of this Python worker; its cache serves one task after the other.
_encoders: dict[int, Encoder] = {}


def write_shards(docs: DataFrame, tokenizer: str, end: int = 0, *, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Shards of (doc_id, text), in order of (part, shard): part, shard, n_docs, n_ids, file.

    ``tokenizer`` is the JSON of a byte-level BPE, broadcast once; its size doesn't depend on the documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if hash(shared.value) not in _encoders:
            _encoders.clear()
            _encoders[hash(shared.value)] = Encoder(shared.value)
        encode, last = _encoders[hash(shared.value)].encode, struct.pack("<I", end)
        part, shard = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        packed: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, size
            starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])])
            data = write_shard(np.frombuffer(b"".join(packed), "<u4"), starts, doc_ids)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([int(starts[-1])], pa.int64()), pa.array([data], pa.binary())], ["part", "shard", "n_docs", "n_ids", "file"])
            doc_ids.clear()
            packed.clear()
            shard, size = shard + 1, 0
            return out

        for batch in batches:
            for doc_id, p in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text"))):
                if packed and size + len(p) // 4 >= shard_ids:
                    yield flush()
                doc_ids.append(doc_id)
                packed.append(p + last)
                size += len(p) // 4 + 1
        if packed:
            yield flush()

    in_order = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return in_order.select("doc_id", "text").mapInArrow(run, "part int, shard int, n_docs long, n_ids long, file binary")


def read_documents(shards: DataFrame, end: int = 0) -> DataFrame:
    """Each document as the files have it: doc_id, start, n_tokens, ids_crc32, and n_end, how often the end id is in it, by rank."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("in_part"))
    before = parts.select("part", (F.sum("in_part").over(W.orderBy("part")) - F.col("in_part")).alias("before_part"))
    inside = shards.select("part", "shard", (F.sum("n_ids").over(W.partitionBy("part").orderBy("shard")) - F.col("n_ids")).alias("in_part_before"))
    first = inside.join(before, "part").select("part", "shard", (F.col("before_part") + F.col("in_part_before")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, at in zip(batch.column("file"), batch.column("first").to_pylist()):
                x = read_shard(data.as_py())
                ids, starts, doc_ids = x.decode(), x.starts, x.doc_ids
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts[:-1] + at, pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.array(crc, pa.int64()), pa.array(x.counts_in(end, starts), pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32", "n_end"])

    return shards.select("part", "shard", "file").join(first, ["part", "shard"]).select("file", "first").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, n_end long")


def op6_wavelet_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return read_documents(stored(write_shards(docs, tokenizer), "wavelet", compression="none"))
