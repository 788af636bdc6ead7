"""Polygons of shapefiles as rows of text: file bytes come through Spark's own reader, so any store will do."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def polygons(data: bytes) -> Iterator[tuple[int, str | None]]:
    """Record number and well-known text of each polygon of a .shp file."""
    at = 100
    while at + 8 <= len(data):
        number, words = struct.unpack_from(">ii", data, at)
        body, at = at + 8, at + 8 + 2 * words
        kind = struct.unpack_from("<i", data, body)[0]
        if kind not in (5, 15, 25):
            yield number, None
            continue
        n_parts, n_points = struct.unpack_from("<ii", data, body + 36)
        parts = [*struct.unpack_from(f"<{n_parts}i", data, body + 44), n_points]
        xy = struct.unpack_from(f"<{2 * n_points}d", data, body + 44 + 4 * n_parts)
        rings = [[(xy[2 * i], xy[2 * i + 1]) for i in range(a, b)] for a, b in zip(parts, parts[1:])]
        text = ["(" + ", ".join(f"{x!r} {y!r}" for x, y in r) + ")" for r in rings]
        area = [sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:])) for r in rings]
        shells = [i for i, a in enumerate(area) if a <= 0] or [0]  # shells run clockwise
        groups = [[text[i] for i in range(s, e)] for s, e in zip(shells, [*shells[1:], len(rings)])]
        body_text = ", ".join("(" + ", ".join(g) + ")" for g in groups)
        yield number, f"POLYGON {body_text}" if len(groups) == 1 else f"MULTIPOLYGON ({body_text})"


def attributes(data: bytes, encoding: str = "utf-8") -> list[dict[str, str]]:
    """Fields of each record of a .dbf file, as text."""
    n, header, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at : at + 1] not in (b"\r", b""):
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding), data[at + 16]))
        at += 32
    out = []
    for k in range(n):
        p, row = header + k * size + 1, {}
        for name, width in fields:
            row[name] = data[p : p + width].decode(encoding, "replace").strip()
            p += width
        out.append(row)
    return out


def read(spark: SparkSession, path: str, *, encoding: str = "utf-8") -> DataFrame:
    """path, number, wkt and attributes of every .shp below a path, with the .dbf beside it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.lower("path").rlike(r"\.(shp|dbf)$"))
    named = files.select(F.regexp_replace("path", r"\.[^.]+$", "").alias("name"), F.lower(F.right("path", F.lit(3))).alias("kind"), "content")
    pairs = named.groupBy("name").agg(F.max(F.when(F.col("kind") == "shp", F.col("content"))).alias("shp"), F.max(F.when(F.col("kind") == "dbf", F.col("content"))).alias("dbf")).where("shp is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, shp, dbf in zip(*[batch.column(c).to_pylist() for c in ("name", "shp", "dbf")]):
                rows = attributes(dbf, encoding) if dbf else []
                for number, wkt in polygons(shp):
                    row = rows[number - 1] if number <= len(rows) else {}
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([number], pa.int32()), pa.array([wkt], pa.string()), pa.array([list(row.items())], pa.map_(pa.string(), pa.string()))], ["path", "number", "wkt", "attributes"])

    return pairs.mapInArrow(run, "path string, number int, wkt string, attributes map<string,string>")
