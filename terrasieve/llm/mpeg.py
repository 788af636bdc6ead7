"""Media columns: MPEG audio, layer III.

A payload is carried in the main data of CRC-protected frames, after an ID3v2 tag
that says its length and a Xing frame with frame count, byte count and seek table.
Reading finds the frames again: tags are parsed, the header is searched for where
the stream doesn't hold one (and believed only if the next frame's header follows
or the stream ends there), checksums are verified, and the exact duration and the
byte offset of every frame are stored.

Defined results: a null text is an empty one, which is stored as 64 zero bytes;
very long texts take as many frames as they need; equal texts (ties, repeated rows) give
equal streams, each in its own row; damaged frames are counted and their bytes left out; a
stream without frames has duration 0; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, stored, table, texts_of

# Fixed values of the MPEG audio header, layer III: kbit/s by index, Hz by index.
KBITS = {1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

UNIT = 64


@dataclass(frozen=True)
class Header:
    """What four bytes say of a frame."""

    rate: int
    kbits: int
    samples: int
    size: int
    crc: bool
    side: int
    channels: int


@lru_cache(4096)
def parse_header(head: bytes) -> Header | None:
    """None where four bytes are no layer III header with a known size."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer, crc = head[1] >> 3 & 3, head[1] >> 1 & 3, not head[1] & 1
    bits, rate, pad, mode = head[2] >> 4, head[2] >> 2 & 3, head[2] >> 1 & 1, head[3] >> 6
    if version == 1 or layer != 1 or rate == 3 or bits in (0, 15):
        return None
    first = version == 3
    hz, kbits, samples = RATES[version][rate], KBITS[1 if first else 2][bits], 1152 if first else 576
    mono = mode == 3
    side = (17 if mono else 32) if first else (9 if mono else 17)
    return Header(hz, kbits, samples, samples // 8 * kbits * 1000 // hz + pad, crc, side, 1 if mono else 2)


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        x = b << 8
        for _ in range(8):
            x = (x << 1 ^ 0x8005 if x & 0x8000 else x << 1) & 0xFFFF
        out.append(x)
    return out


_CRC = _crc_table()


@lru_cache(65536)
def crc16(data: bytes) -> int:
    """The checksum of MPEG audio: polynomial 0x8005 from 0xFFFF, high bit first."""
    x = 0xFFFF
    for b in data:
        x = (x << 8 & 0xFFFF) ^ _CRC[x >> 8 ^ b]
    return x


#: MPEG-1 layer III, protected, 32 kHz, mono: frames of 144 to 1,440 bytes.
_SIDE = bytes(17)


@lru_cache(16)
def _frame_head(kbits: int) -> bytes:
    head = bytes([0xFF, 0xFA, KBITS[1].index(kbits) << 4 | 2 << 2, 0xC0])
    return head + struct.pack(">H", crc16(head[2:] + _SIDE)) + _SIDE


_OVER = len(_frame_head(32))
_SIZES = [(k, parse_header(_frame_head(k)[:4]).size - _OVER) for k in KBITS[1][1:]]


def _syncsafe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def write_mpeg(payload: bytes) -> bytes:
    """A variable-bitrate stream whose frames carry the payload."""
    room = _SIZES[-1][1]
    frames = [payload[i : i + room] for i in range(0, len(payload), room)]
    audio, offsets, at = [], [], 0
    for x in frames:
        kbits, size = next(s for s in _SIZES if s[1] >= len(x))
        offsets.append(at)
        audio += [_frame_head(kbits), x, bytes(size - len(x))]
        at += _OVER + size
    info = _frame_head(64)
    info_size = parse_header(info[:4]).size
    total = info_size + at
    toc = bytes(min(255, 256 * (info_size + offsets[len(offsets) * i // 100]) // total) for i in range(100)) if offsets else bytes(100)
    xing = info + b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    text = b"\x00payload_bytes\x00" + str(len(payload)).encode()
    tag = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    return b"ID3\x03\x00\x00" + _syncsafe(len(tag)) + tag + xing + bytes(info_size - len(xing)) + b"".join(audio)


@dataclass
class Stream:
    """What reading a stream found."""

    tags: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    bad_crc: int = 0
    resyncs: int = 0
    skipped: int = 0
    xing_frames: int | None = None
    xing_bytes: int | None = None
    xing_at: int = 0
    toc: bytes = b""
    end: int = 0
    kbits: list[int] = field(default_factory=list)

    @property
    def table_ok(self) -> bool:
        """If the Xing frame's count of frames, count of bytes and seek table are those of the frames found."""
        if self.xing_frames != len(self.offsets) or self.xing_bytes != self.end - self.xing_at:
            return False
        n, total = len(self.offsets), self.xing_bytes or 1
        return self.toc == (bytes(min(255, 256 * (self.offsets[n * i // 100] - self.xing_at) // total) for i in range(100)) if n else bytes(100))

    @property
    def seconds(self) -> tuple[int, int]:
        """Exact duration, as a fraction."""
        return self.samples, self.rate or 1


def _id3v2(data: bytes, at: int, out: Stream) -> int:
    """Reads the tag at a position; returns the position after it."""
    version, flags, size = data[at + 3], data[at + 5], 0
    for b in data[at + 6 : at + 10]:
        size = size << 7 | b & 127
    end, p = min(len(data), at + 10 + size), at + 10
    if flags & 0x40 and p + 4 <= end:  # an extended header
        n = struct.unpack_from(">I", data, p)[0]
        p += n if version == 4 else n + 4
    while p + 10 <= end and data[p : p + 4].strip(b"\0"):
        name, n = data[p : p + 4].decode("latin-1"), struct.unpack_from(">I", data, p + 4)[0]
        if version == 4:
            n = (n >> 24 & 127) << 21 | (n >> 16 & 127) << 14 | (n >> 8 & 127) << 7 | n & 127
        body = data[p + 10 : min(end, p + 10 + n)]
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            out.tags[key] = value.strip("\0")
        p += 10 + n
    return end + 10 * bool(version == 4 and flags & 0x10)


def read_mpeg(data: bytes) -> Stream:
    """Parses tags, Xing table and frames; finds the next frame again after bytes that are none."""
    out, at, synced = Stream(), 0, True
    end = len(data)
    tag = end - 128 if end >= 128 and data[-128:-125] == b"TAG" else end  # ID3v1, unless a frame goes over its start
    parts = []
    while at < end:
        if at == tag:
            for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
                out.tags.setdefault(name, data[at + a : at + b].split(b"\0")[0].decode("latin-1").strip())
            break
        if data[at : at + 3] == b"ID3" and at + 10 <= end:
            at = _id3v2(data, at, out)
            continue
        head = parse_header(data[at : at + 4])
        nxt = at + head.size if head else 0
        over = at < tag < nxt < end and not parse_header(data[nxt : nxt + 4])  # cut short by the tag
        if not head or nxt > end or over or not synced and nxt < end and nxt != tag and not parse_header(data[nxt : nxt + 4]):
            out.resyncs += synced
            synced = False
            stop = tag if at < tag else end
            found = data.find(b"\xff", at + 1, stop)
            out.skipped += (found if found >= 0 else stop) - at
            at = found if found >= 0 else stop
            continue
        synced = True
        start = at + 4 + 2 * head.crc
        if head.crc and crc16(data[at + 2 : at + 4] + data[start : start + head.side]) != struct.unpack_from(">H", data, at + 4)[0]:
            out.bad_crc += 1
            at = nxt
            continue
        body = start + head.side
        if data[body : body + 4] in (b"Xing", b"Info") and not out.offsets and out.xing_frames is None:
            flags, p, out.xing_at = struct.unpack_from(">I", data, body + 4)[0], body + 8, at
            if flags & 1:
                out.xing_frames, p = struct.unpack_from(">I", data, p)[0], p + 4
            if flags & 2:
                out.xing_bytes, p = struct.unpack_from(">I", data, p)[0], p + 4
            if flags & 4:
                out.toc = data[p : p + 100]
        else:
            out.offsets.append(at)
            out.samples += head.samples
            out.rate = out.rate or head.rate
            out.kbits.append(head.kbits)
            parts.append((body, nxt))
        at = nxt
    out.end = at
    left = int(out.tags.get("payload_bytes", 0)) if out.tags.get("payload_bytes", "0").isdigit() else 0
    pieces = []
    for i, (a, b) in enumerate(parts):  # every frame but the last is full
        pieces.append(data[a : b if i + 1 < len(parts) else min(b, a + left)])
        left -= len(pieces[-1])
    out.payload = b"".join(pieces)
    return out


def feature(s: Stream) -> str:
    """Frames, exact seconds, kbit/s range, table checks and a digest of the seek offsets."""
    n, d = s.seconds
    seek = hashlib.sha256(np.array(s.offsets, "<u8").tobytes()).hexdigest()[:16]
    kbits = f"{min(s.kbits)}-{max(s.kbits)}" if s.kbits else "0"
    return f"frames={len(s.offsets)};seconds={n}/{d};kbits={kbits};vbr_ok={int(s.table_ok)};bad_crc={s.bad_crc};resyncs={s.resyncs};seek={seek}"


def padded(text: bytes | None) -> bytes:
    x = text or b""
    return x + bytes(max(UNIT, -(-len(x) // UNIT) * UNIT) - len(x))


def add_media(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to doc_id, n_bytes and media, the MPEG stream of the padded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, media = [], []
            for x in texts_of(batch):
                n.append(len(x or b""))
                media.append(write_mpeg(padded(x)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def probe_media(media: DataFrame, *, keep: tuple[str, ...] = ("doc_id", "n_bytes"), offsets: bool = True) -> DataFrame:
    """Digest and features of a ``media`` column; with ``offsets`` also duration and frame offsets."""
    kinds = ", ".join(f"{c} {media.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kinds}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    if offsets:
        schema += ", duration double, frame_offsets array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column("media"):
                data = x.as_py() or b""
                s = read_mpeg(data)
                row = (len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(s))
                rows.append((*row, s.samples / (s.rate or 1), s.offsets) if offsets else row)
            kind = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64())]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kind)] if rows else [pa.array([], k) for k in kind[: 8 if offsets else 6]]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration", "frame_offsets"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *columns], [*keep, *names[: len(columns)]])

    return media.select(*keep, "media").mapInArrow(run, schema)


def op2_mpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams are stored as a table in the shared folder and read back from it."""
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return probe_media(stored(add_media(docs), "media"))
