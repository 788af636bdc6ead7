"""Polygons as well-known text. Parsing and point-in-polygon tests are Arrow functions; what follows is joins on grid cells."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from math import radians

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBERS = re.compile(r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?")


def rings(wkt: str | None) -> list[list[np.ndarray]]:
    """Polygons of a POLYGON or MULTIPOLYGON, each a shell and its holes."""
    if not wkt or "POLYGON" not in wkt.upper() or "EMPTY" in wkt.upper():
        return []
    body = wkt[wkt.index("(") :]
    polygons = body.strip()[1:-1].split(")),") if wkt.upper().lstrip().startswith("MULTI") else [body]
    out = []
    for p in polygons:
        out.append([np.array(_NUMBERS.findall(r), float).reshape(-1, 2) for r in re.findall(r"\(([^()]+)\)", p if p.rstrip().endswith(")") else p + "))")])
    return [x for x in out if x and len(x[0]) >= 3]


def ring_area(r: np.ndarray) -> float:
    x, y = (r - r[0]).T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def shape(polygons: list[list[np.ndarray]]) -> tuple[float, float, float]:
    """Area, and x and y of the centroid, holes left out."""
    total = sx = sy = 0.0
    for p in polygons:
        for k, r in enumerate(p):
            o = r[0]
            x, y = (r - o).T
            cross = x * np.roll(y, -1) - np.roll(x, -1) * y
            a = cross.sum() / 2
            if a == 0:
                continue
            sign = (1 if k == 0 else -1) * np.sign(a)
            total += sign * a
            sx += sign * (((x + np.roll(x, -1)) * cross).sum() / 6 + o[0] * a)
            sy += sign * (((y + np.roll(y, -1)) * cross).sum() / 6 + o[1] * a)
    return (total, sx / total, sy / total) if total else (0.0, float("nan"), float("nan"))


def contains(polygons: list[list[np.ndarray]], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """If points lie inside, by counting the edges to the right of each."""
    inside = np.zeros(len(x), bool)
    for p in polygons:
        odd = np.zeros(len(x), bool)
        for r in p:
            a, b = r, np.roll(r, -1, axis=0)
            for (x1, y1), (x2, y2) in zip(a, b):
                if y1 != y2:
                    odd ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        inside |= odd
    return inside


def crosses_box(polygons: list[list[np.ndarray]], x0: float, y0: float, x1: float, y1: float) -> bool:
    """If any edge of a polygon meets a box."""
    for p in polygons:
        for r in p:
            for (ax, ay), (bx, by) in zip(r, np.roll(r, -1, axis=0)):
                lo, hi, dx, dy = 0.0, 1.0, bx - ax, by - ay
                for d, q0, q1 in ((dx, x0 - ax, x1 - ax), (dy, y0 - ay, y1 - ay)):
                    if d == 0:
                        if q0 > 0 or q1 < 0:
                            lo = 2.0
                    else:
                        s, t = sorted((q0 / d, q1 / d))
                        lo, hi = max(lo, s), min(hi, t)
                if lo <= hi:
                    return True
    return False


def simplify(r: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on an open or closed line."""
    keep = np.zeros(len(r), bool)
    keep[[0, -1]] = True
    todo = [(0, len(r) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, v = r[b] - r[a], r[a + 1 : b] - r[a]
        n = np.hypot(*d)
        far = np.abs(d[0] * v[:, 1] - d[1] * v[:, 0]) / n if n else np.hypot(v[:, 0], v[:, 1])
        i = int(far.argmax())
        if far[i] > tolerance:
            keep[a + 1 + i] = True
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return r[keep]


def to_wkt(polygons: list[list[np.ndarray]]) -> str:
    text = lambda r: "(" + ", ".join(f"{x:.10g} {y:.10g}" for x, y in r) + ")"
    parts = ["(" + ", ".join(map(text, p)) + ")" for p in polygons]
    return "POLYGON " + parts[0] if len(parts) == 1 else "MULTIPOLYGON (" + ", ".join(parts) + ")"


def measures(wkt: Column | str) -> Column:
    """Area, centroid (x, y), bounds, and if there is a polygon with an area (valid)."""
    names = ["area", "x", "y", "xmin", "ymin", "xmax", "ymax", "valid"]

    @F.pandas_udf(", ".join(f"{n} {'boolean' if n == 'valid' else 'double'}" for n in names))
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for w in texts:
            p = rings(w)
            if not p:
                rows.append((None,) * 7 + (False,))
                continue
            every = np.concatenate([q[0] for q in p])
            a, x, y = shape(p)
            rows.append((a, x, y, *every.min(0), *every.max(0), a > 0))
        return pd.DataFrame(rows, columns=names)

    return of(wkt)


def within(x: Column | str, y: Column | str, wkt: Column | str) -> Column:
    """If a point lies in the polygon of its row; each polygon of a batch is parsed once."""

    @F.pandas_udf("boolean")
    def of(xs: pd.Series, ys: pd.Series, texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), dtype=object)
        for w, at in texts.groupby(texts).groups.items():
            out[at] = contains(rings(w), xs[at].to_numpy(), ys[at].to_numpy())
        return out

    return of(x, y, wkt)


def simplified(wkt: Column | str, tolerance: float = 0.01) -> Column:
    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([to_wkt([[simplify(r, tolerance) for r in p] for p in rings(w)]) if rings(w) else None for w in texts])

    return of(wkt)


def pixels_of(plots: DataFrame, key: str, wkt: str, transform: Sequence[float], *, all_touched: bool = False, size: tuple[int, int] | None = None) -> DataFrame:
    """The pixels of each polygon: those whose centre lies inside, or (all_touched) that it touches; the centroid's pixel where there is none.

    With the ``size`` (rows, columns) of a raster, pixels outside it are left out.

    A polygon is handled row by row of its box, so none is held as a whole raster.
    """
    x0, dx, _, y0, _, dy = transform
    kind = plots.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, w in zip(batch.column(0), batch.column(1).to_pylist()):
                p, any_pixel = rings(w), False
                if not p:
                    continue
                every = np.concatenate([q[0] for q in p])
                (ax, ay), (bx, by) = every.min(0), every.max(0)
                c0, c1 = sorted((int(np.floor((ax - x0) / dx)), int(np.floor((bx - x0) / dx))))
                r0, r1 = sorted((int(np.floor((ay - y0) / dy)), int(np.floor((by - y0) / dy))))
                cols = np.arange(c0, c1 + 1)
                for r in range(r0, r1 + 1):
                    hit = contains(p, x0 + (cols + 0.5) * dx, np.full(len(cols), y0 + (r + 0.5) * dy))
                    if all_touched:
                        for i in np.flatnonzero(~hit):
                            xs, ys = sorted((x0 + cols[i] * dx, x0 + (cols[i] + 1) * dx)), sorted((y0 + r * dy, y0 + (r + 1) * dy))
                            hit[i] = crosses_box(p, xs[0], ys[0], xs[1], ys[1])
                    if hit.any():
                        any_pixel = True
                        n = int(hit.sum())
                        yield out(k, np.full(n, r), cols[hit], True)
                if not any_pixel:
                    _, x, y = shape(p)
                    if np.isfinite(x):
                        yield out(k, np.array([int(np.floor((y - y0) / dy))]), np.array([int(np.floor((x - x0) / dx))]), False)

    def out(k: pa.Scalar, rows: np.ndarray, cols: np.ndarray, inside: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(rows), k.type), pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array([inside] * len(rows))], [key, "row", "col", "is_within"])

    found = plots.select(key, wkt).mapInArrow(run, f"{key} {kind}, row int, col int, is_within boolean")
    return found.where(F.col("row").between(0, size[0] - 1) & F.col("col").between(0, size[1] - 1)) if size else found


def points_in(points: DataFrame, areas: DataFrame, x: str, y: str, wkt: str, cell: float) -> DataFrame:
    """Points with the areas they lie in: both meet on the cells of an area's box, then the polygon is tested."""
    at = lambda c: F.floor(c / cell).cast("int")
    boxed = areas.withColumn("_m", measures(wkt)).where("_m.valid")
    cells = boxed.withColumn("_cx", F.explode(F.sequence(at(F.col("_m.xmin")), at(F.col("_m.xmax"))))).withColumn("_cy", F.explode(F.sequence(at(F.col("_m.ymin")), at(F.col("_m.ymax"))))).drop("_m")
    met = points.withColumn("_cx", at(F.col(x))).withColumn("_cy", at(F.col(y))).join(cells, ["_cx", "_cy"])
    return met.where(within(x, y, wkt)).drop("_cx", "_cy")


def utm_zone(lon: Column | str) -> Column:
    return F.floor(((F.col(lon) if isinstance(lon, str) else lon) + 180) / 6).cast("int") + 1


def to_utm(lon: Column | str, lat: Column | str, zone: Column | int) -> tuple[Column, Column]:
    """Easting and northing on WGS84, northern zones: the transverse Mercator series to the sixth order, as plain expressions."""
    lon, lat = (F.radians(F.col(c) if isinstance(c, str) else c) for c in (lon, lat))
    zone = F.lit(zone) if isinstance(zone, int) else zone
    f = 1 / 298.257223563  # fixed values of the ellipsoid and the projection
    a, k0, east = 6378137.0, 0.9996, 500000.0
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    s = F.sin(lat)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    d = lon - F.radians(zone * 6 - 183)
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return east + k0 * big * x, k0 * big * y


def degrees_north(m: float) -> float:
    """Metres as degrees of latitude, roughly."""
    return m / (6371008.8 * radians(1))


def _ring_points(p: list[list[np.ndarray]]) -> np.ndarray:
    return np.concatenate([r for q in p for r in q])


def polygons_related(a: Column | str, b: Column | str, *, within: bool) -> Column:
    """If polygon a lies within b (``within``), or if both meet at all."""

    @F.pandas_udf("boolean")
    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        parsed: dict[str, list] = {}
        out = []
        for u, v in zip(left, right):
            p, q = (parsed.setdefault(w, rings(w)) if w is not None else [] for w in (u, v))
            if not p or not q:
                out.append(None)
                continue
            cross = any(_crosses(r, s) for x in p for r in x for y in q for s in y)
            inside = contains(q, *_ring_points(p).T)
            if within:
                out.append(bool(not cross and inside.all()))
            else:
                out.append(bool(cross or inside.any() or contains(p, *_ring_points(q).T).any()))
        return pd.Series(out, dtype=object)

    return of(a, b)


def _crosses(r: np.ndarray, s: np.ndarray) -> bool:
    """If edges of two closed rings cross inside both."""
    a, b, c, d = r, np.roll(r, -1, axis=0), s, np.roll(s, -1, axis=0)
    side = lambda p, q, x: np.sign((q[:, None, 0] - p[:, None, 0]) * (x[None, :, 1] - p[:, None, 1]) - (q[:, None, 1] - p[:, None, 1]) * (x[None, :, 0] - p[:, None, 0]))
    return bool(((side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0).T).any())


def related(left: DataFrame, right: DataFrame, a: str, b: str, cell: float, *, within: bool) -> DataFrame:
    """Pairs of polygons, the left within the right or both meeting: boxes meet on grid cells, each pair is tested in the first cell it shares."""
    at = lambda c: F.floor(c / cell).cast("int")

    def celled(df: DataFrame, wkt: str, m: str) -> DataFrame:
        boxed = df.withColumn(m, measures(wkt)).where(f"{m}.valid")
        return boxed.withColumn("_cx", F.explode(F.sequence(at(F.col(f"{m}.xmin")), at(F.col(f"{m}.xmax"))))).withColumn("_cy", F.explode(F.sequence(at(F.col(f"{m}.ymin")), at(F.col(f"{m}.ymax")))))

    met = celled(left, a, "_ma").join(celled(right, b, "_mb"), ["_cx", "_cy"])
    first = (F.col("_cx") == F.greatest(at(F.col("_ma.xmin")), at(F.col("_mb.xmin")))) & (F.col("_cy") == F.greatest(at(F.col("_ma.ymin")), at(F.col("_mb.ymin"))))
    boxes = (F.col("_ma.xmin") <= F.col("_mb.xmax")) & (F.col("_mb.xmin") <= F.col("_ma.xmax")) & (F.col("_ma.ymin") <= F.col("_mb.ymax")) & (F.col("_mb.ymin") <= F.col("_ma.ymax"))
    kept = met.where(first & boxes).drop("_cx", "_cy", "_ma", "_mb")
    return kept.where(polygons_related(a, b, within=within))


def is_kind(wkt: Column | str, *kinds: str) -> Column:
    """If a geometry is of one of the kinds, by the word its text begins with."""
    return F.upper(F.regexp_extract(wkt, r"^\s*([A-Za-z]+)", 1)).isin(*[k.upper() for k in kinds])
