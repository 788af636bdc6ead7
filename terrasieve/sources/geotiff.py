"""GeoTIFF rasters as rows of (path, band, row, col, value), and back.

Bytes come through Spark's own reader, so any store will do. Strips and tiles, plain or
deflated, of whole or floating numbers are read; rows leave strip by strip.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the format: bytes of a field type, and numpy kinds by sample format.
SIZES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
KINDS = {1: "u", 2: "i", 3: "f"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, SCALE, TIEPOINT, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42113


@dataclass
class Header:
    order: str
    tags: dict[int, tuple]

    def get(self, tag: int, default=None):
        return self.tags.get(tag, default)

    @property
    def transform(self) -> tuple[float, ...] | None:
        """(x0, dx, 0, y0, 0, dy) where scale and tie point are known."""
        if SCALE not in self.tags or TIEPOINT not in self.tags:
            return None
        (dx, dy, *_), (i, j, _, x, y, *_) = self.tags[SCALE], self.tags[TIEPOINT]
        return (x - i * dx, dx, 0.0, y + j * dy, 0.0, -dy)


def header(data: bytes) -> Header:
    """The first directory of a file."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    magic, at = struct.unpack_from(order + "HI", data, 2)
    if magic != 42:
        raise ValueError("not a classic TIFF")
    tags = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in SIZES:
            continue
        code, size = SIZES[kind]
        place = at + 10 + 12 * k
        if n * size > 4:
            place = struct.unpack_from(order + "I", data, place)[0]
        tags[tag] = (data[place : place + n],) if kind == 2 else struct.unpack_from(f"{order}{n * len(code)}{code[0]}", data, place)
    return Header(order, tags)


def blocks(data: bytes) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(band, first row, first column, values) of each strip or tile; bands count from 1."""
    h = header(data)
    width, height, samples = h.get(WIDTH)[0], h.get(HEIGHT)[0], h.get(SAMPLES, (1,))[0]
    bits, kind = h.get(BITS, (8,))[0], KINDS[h.get(FORMAT, (1,))[0]]
    if bits % 8 or h.get(PREDICTOR, (1,))[0] not in (1, 2) or h.get(COMPRESSION, (1,))[0] not in (1, 8, 32946):
        raise ValueError("an encoding that isn't read")
    dtype = np.dtype(f"{h.order}{kind}{bits // 8}")
    tiled = TILES in h.tags
    bw, bh = (h.get(TILE_WIDTH)[0], h.get(TILE_HEIGHT)[0]) if tiled else (width, h.get(STRIP_ROWS, (height,))[0])
    starts, sizes = (h.get(TILES), h.get(TILE_BYTES)) if tiled else (h.get(STRIPS), h.get(STRIP_BYTES))
    apart = h.get(PLANAR, (1,))[0] == 2
    across, down = -(-width // bw), -(-height // bh)
    for k, (at, size) in enumerate(zip(starts, sizes)):
        plane, k = divmod(k, across * down)
        r, c = k // across * bh, k % across * bw
        raw = data[at : at + size]
        if h.get(COMPRESSION, (1,))[0] != 1:
            raw = zlib.decompress(raw)
        n = 1 if apart else samples
        rows = bh if tiled else min(bh, height - r)
        x = np.frombuffer(raw, dtype, rows * bw * n).reshape(rows, bw, n)
        if h.get(PREDICTOR, (1,))[0] == 2:
            x = np.cumsum(x, axis=1, dtype=dtype)
        x = x[: height - r, : width - c]
        for s in range(n):
            yield (plane if apart else s) + 1, r, c, x[:, :, s]


def read(spark: SparkSession, path: str, *, bands: list[int] | None = None) -> DataFrame:
    """path, band, row, col and value of all rasters below a path; null where the file's nodata stands."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tif").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                content = data.as_py()
                text = (header(content).get(NODATA) or (b"",))[0].strip(b"\0 ")
                hole = float(text) if text else None
                for band, r, c, x in blocks(content):
                    if bands and band not in bands:
                        continue
                    v = x.astype(np.float64).reshape(-1)
                    rows, cols = (np.repeat(np.arange(r, r + x.shape[0]), x.shape[1]), np.tile(np.arange(c, c + x.shape[1]), x.shape[0]))
                    known = pa.array(v, mask=np.isnan(v) | (v == hole if hole is not None else False))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(v)), pa.array(np.full(len(v), band, np.int32)), pa.array(rows.astype(np.int32)), pa.array(cols.astype(np.int32)), known], ["path", "band", "row", "col", "value"])

    return files.mapInArrow(run, "path string, band int, row int, col int, value double")


def encode(x: np.ndarray, transform: tuple[float, ...] | None = None, nodata: float | None = None, rows: int = 64) -> bytes:
    """A deflated little-endian file of one band, in strips."""
    x = np.ascontiguousarray(x)
    strips = [zlib.compress(x[r : r + rows].astype(x.dtype.newbyteorder("<")).tobytes()) for r in range(0, len(x), rows)]
    kind = {"u": 1, "i": 2, "f": 3}[x.dtype.kind]
    tags: list[tuple[int, int, bytes, int]] = []
    put = lambda tag, code, *v: tags.append((tag, {"H": 3, "I": 4, "d": 12}[code], struct.pack(f"<{len(v)}{code}", *v), len(v)))
    put(WIDTH, "I", x.shape[1])
    put(HEIGHT, "I", x.shape[0])
    put(BITS, "H", 8 * x.dtype.itemsize)
    put(COMPRESSION, "H", 8)
    put(262, "H", 1)
    put(STRIPS, "I", *np.cumsum([8, *map(len, strips)])[:-1].tolist())
    put(SAMPLES, "H", 1)
    put(STRIP_ROWS, "I", rows)
    put(STRIP_BYTES, "I", *map(len, strips))
    put(FORMAT, "H", kind)
    if transform:
        put(SCALE, "d", transform[1], -transform[5], 0.0)
        put(TIEPOINT, "d", 0.0, 0.0, 0.0, transform[0], transform[3], 0.0)
    if nodata is not None:
        text = f"{nodata:g}\0".encode()
        tags.append((NODATA, 2, text, len(text)))
    body = b"".join(strips)
    body += b"\0" * (len(body) % 2)
    at, more = 8 + len(body) + 2 + 12 * len(tags) + 4, b""
    entries = b""
    for tag, code, value, n in tags:
        if len(value) > 4:
            entries += struct.pack("<HHII", tag, code, n, at + len(more))
            more += value + b"\0" * (len(value) % 2)
        else:
            entries += struct.pack("<HHI", tag, code, n) + value.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", 8 + len(body)) + body + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + more


def tiles(df: DataFrame, by: str, value: str, size: int, transform: tuple[float, ...], nodata: float = -9999.0) -> DataFrame:
    """Rows (by, row, col, value) as one GeoTIFF of size x size for each tile: by, tile_row, tile_col, content. A tile bounds what a task holds."""
    x0, dx, _, y0, _, dy = transform
    kind = df.schema[by].dataType.simpleString()

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        name, r, c = (k.as_py() for k in key)
        x = np.full((size, size), nodata, np.float32)
        at = rows.column("row").to_numpy() - r * size, rows.column("col").to_numpy() - c * size
        v = rows.column(value).to_numpy().astype(np.float32)
        x[at] = np.where(np.isnan(v), nodata, v)
        content = encode(x, (x0 + c * size * dx, dx, 0.0, y0 + r * size * dy, 0.0, dy), nodata)
        return pa.table({by: pa.array([name], rows.schema.field(by).type), "tile_row": pa.array([r], pa.int32()), "tile_col": pa.array([c], pa.int32()), "content": pa.array([content], pa.binary())})

    dealt = df.selectExpr(by, "row", "col", value, f"cast(floor(row / {size}) as int) as tile_row", f"cast(floor(col / {size}) as int) as tile_col")
    return dealt.groupBy(by, "tile_row", "tile_col").applyInArrow(one, f"{by} {kind}, tile_row int, tile_col int, content binary")
