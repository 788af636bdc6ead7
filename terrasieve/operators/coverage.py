"""Shares of polygons that others cover: union then within, overlaps of pairs, the best container.

Polygons meet in grid cells; a cell that holds too many is cut in four, again and again,
so a large district or a crowded place is many small tasks. In a cell the edges of all
polygons are arranged in vertical strips between their corners and crossings; in each strip the
trapezoids between neighbouring edges are inside or outside each polygon as a whole, so their
areas add up to what is covered, holes and overlapping parts included. Areas of cells add up by polygon.

Polygons are well-known text. A null text, a text that is no polygon and one without an
area cover nothing and are in nothing; touching the border counts as inside.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .geometry import measures, rings
from .lineage import cut

#: Polygons of both sides that a cell holds before it is cut, and how often it may be cut: below that they lie in one place.
MOST, DEEPEST = 256, 12

#: Share of an area that rounding may leave uncovered.
ROUNDING = 1e-9


def edges_of(polygons: list[list[np.ndarray]]) -> np.ndarray:
    """Edges (x1, y1, x2, y2) with x1 < x2, upright ones left out: strips never cross them."""
    every = [np.concatenate([r, np.roll(r, -1, axis=0)], axis=1) for p in polygons for r in p]
    e = np.concatenate(every) if every else np.zeros((0, 4))
    e = np.where((e[:, 0] > e[:, 2])[:, None], e[:, [2, 3, 0, 1]], e)
    return e[e[:, 0] < e[:, 2]]


def crossings(e: np.ndarray) -> np.ndarray:
    """x of the points where two edges cross."""
    out = []
    for i in range(len(e) - 1):
        f = e[i + 1 :]
        f = f[(f[:, 0] < e[i, 2]) & (f[:, 2] > e[i, 0])]
        slope = (e[i, 3] - e[i, 1]) / (e[i, 2] - e[i, 0])
        slopes = (f[:, 3] - f[:, 1]) / (f[:, 2] - f[:, 0])
        unlike = slopes != slope
        f, slopes = f[unlike], slopes[unlike]
        x = (f[:, 1] - slopes * f[:, 0] - e[i, 1] + slope * e[i, 0]) / (slope - slopes)
        out.append(x[(x > np.maximum(f[:, 0], e[i, 0])) & (x < np.minimum(f[:, 2], e[i, 2]))])
    return np.concatenate(out) if out else np.zeros(0)


def covered_area(inner: np.ndarray, others: list[np.ndarray], box: tuple[float, float, float, float]) -> tuple[float, float]:
    """The area of a polygon inside a box, and how much of it any of the others cover; all as edges."""
    x0, y0, x1, y1 = box
    e = np.concatenate([inner, *others, [[x0, y0, x1, y0], [x0, y1, x1, y1]]])
    owner = np.repeat(np.arange(len(others) + 2), [len(inner), *map(len, others), 2])
    near = (e[:, 0] < x1) & (e[:, 2] > x0)
    e, owner = e[near], owner[near]
    xs = np.unique(np.clip(np.concatenate([e[:, 0], e[:, 2], crossings(e), [x0, x1]]), x0, x1))
    real = owner < len(others) + 1  # the box's own edges only make strips
    e, owner = e[real], owner[real]
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    total = covered = 0.0
    for a, b in zip(xs, xs[1:]):
        m = (a + b) / 2
        on = (e[:, 0] < m) & (e[:, 2] > m)
        mid = e[on, 1] + slope[on] * (m - e[on, 0])
        order = np.argsort(mid, kind="stable")
        of, y = owner[on][order], np.clip(mid[order], y0, y1)
        if not len(of):
            continue
        # the first, third, ... edge of a polygon goes into it, the others leave it
        by = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[by], of[by])
        enters = np.empty(len(of), int)
        enters[by] = 1 - 2 * ((np.arange(len(of)) - starts) % 2)
        gap = np.append(np.diff(y), 0.0) * (b - a)
        inside = np.cumsum(np.where(of == 0, enters, 0)) > 0
        any_other = np.cumsum(np.where(of > 0, enters, 0)) > 0
        total += float(gap[inside].sum())
        covered += float(gap[inside & any_other].sum())
    return total, covered


def _boxed(df: DataFrame, wkt: str) -> DataFrame:
    return df.withColumn("_m", measures(wkt)).where("_m.valid").withColumns({c: F.col(f"_m.{c}") for c in ("xmin", "ymin", "xmax", "ymax", "area")}).drop("_m")


def _celled(df: DataFrame, cell: float) -> DataFrame:
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    across = df.withColumn("_cx", F.explode(F.sequence(at("xmin"), at("xmax"))))
    return across.withColumn("_cy", F.explode(F.sequence(at("ymin"), at("ymax")))).withColumn("_level", F.lit(0))


def _quartered(df: DataFrame, cell: float) -> DataFrame:
    """Rows of cells to rows of those quarters that the polygon's box meets."""
    width = F.lit(cell) / F.pow(F.lit(2.0), F.col("_level"))
    for c, low, high in (("_cx", "xmin", "xmax"), ("_cy", "ymin", "ymax")):
        df = df.withColumn(c, F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1)))
        half = width / 2
        df = df.where((F.col(c) * half <= F.col(high)) & ((F.col(c) + 1) * half >= F.col(low)))
    return df.withColumn("_level", F.col("_level") + 1)


def shared_cells(left: DataFrame, right: DataFrame, cell: float, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Both sides with the cells (_level, _cx, _cy) of their boxes.

    Cells with more than ``most`` polygons are cut in four, where that makes them smaller; polygons that lie
    over one another everywhere stay together.
    """
    at, done = ["_level", "_cx", "_cy"], ([], [])
    sides = [cut(_celled(left, cell)), cut(_celled(right, cell))]
    counted = lambda dfs, by: reduce(DataFrame.union, [d.groupBy(*by).agg(F.count("*").alias("n")) for d in dfs]).groupBy(*at).agg(F.sum("n").alias("n"))
    parent = [(F.col("_level") - 1).alias("_level"), *[F.floor(F.col(c) / 2).alias(c) for c in at[1:]]]
    for _ in range(DEEPEST):
        heavy = cut(counted(sides, at).where(F.col("n") > most))
        if heavy.isEmpty():
            break
        finer = [cut(_quartered(s.join(heavy.select(*at), at, "left_semi"), cell)) for s in sides]
        pays = counted(finer, parent).withColumnRenamed("n", "after").join(heavy, at).where(F.col("after") < 3 * F.col("n"))
        pays = cut(pays.select(*at))
        for i, (s, f) in enumerate(zip(sides, finer)):
            done[i].append(s.join(pays, at, "left_anti"))
            sides[i] = cut(f.withColumns({"_up": F.col("_level") - 1, "_ux": F.floor(F.col("_cx") / 2), "_uy": F.floor(F.col("_cy") / 2)}).join(pays.toDF("_up", "_ux", "_uy"), ["_up", "_ux", "_uy"], "left_semi").drop("_up", "_ux", "_uy"))
    return tuple(reduce(DataFrame.unionByName, [*d, s]) for d, s in zip(done, sides))


def _cell_box(level: int, cx: int, cy: int, cell: float) -> tuple[float, float, float, float]:
    w = cell / 2**level
    return cx * w, cy * w, (cx + 1) * w, (cy + 1) * w


def covered_by_union(areas: DataFrame, parts: DataFrame, key: str, wkt: str, by: str, part_wkt: str, cell: float, *, most: int = MOST) -> DataFrame:
    """(key, by, area, covered, is_within) for each polygon and each group ``by`` of parts that covers any of it.

    ``areas`` has one polygon a key. A polygon is within a group if no part of it lies outside the group's union.
    """
    a = _boxed(areas.select(F.col(key).alias("_key"), F.col(wkt).alias("_wkt")), "_wkt")
    p = _boxed(parts.select(F.col(by).alias("_by"), F.col(part_wkt).alias("_wkt")), "_wkt")
    left, right = shared_cells(a, p, cell, most)
    kind, group = areas.schema[key].dataType.simpleString(), parts.schema[by].dataType.simpleString()
    columns = ["_level", "_cx", "_cy"]

    def in_cell(at: tuple, lefts: pd.DataFrame, rights: pd.DataFrame) -> pd.DataFrame:
        box, out = _cell_box(*at, cell), []
        others = [(b, edges_of(rings(w)), *m) for b, w, *m in zip(rights["_by"], rights["_wkt"], rights["xmin"], rights["ymin"], rights["xmax"], rights["ymax"])]
        for k, w, ax, ay, bx, by_ in zip(lefts["_key"], lefts["_wkt"], lefts["xmin"], lefts["ymin"], lefts["xmax"], lefts["ymax"]):
            met: dict = {}
            for b, e, px, py, qx, qy in others:
                if px < bx and qx > ax and py < by_ and qy > ay:
                    met.setdefault(b, []).append(e)
            inner = edges_of(rings(w)) if met else None
            out += [(k, b, covered_area(inner, es, box)[1]) for b, es in met.items()]
        return pd.DataFrame(out, columns=["_key", "_by", "covered"])

    cells = left.select(*columns, "_key", "_wkt", "xmin", "ymin", "xmax", "ymax").groupBy(*columns).cogroup(right.select(*columns, "_by", "_wkt", "xmin", "ymin", "xmax", "ymax").groupBy(*columns))
    found = cells.applyInPandas(in_cell, f"_key {kind}, _by {group}, covered double").groupBy("_key", "_by").agg(F.sum("covered").alias("covered"))
    whole = found.join(a.select("_key", "area"), "_key").where("covered > 0")
    return whole.select(F.col("_key").alias(key), F.col("_by").alias(by), "area", "covered", (F.col("covered") >= F.col("area") * (1 - ROUNDING)).alias("is_within"))


def overlaps(left: DataFrame, right: DataFrame, a: str, b: str, wkt_a: str, wkt_b: str, cell: float, *, most: int = MOST) -> DataFrame:
    """(a, b, share): what share of each left polygon each right one covers, where it covers any. ``b`` has one polygon a key."""
    return covered_by_union(left, right, a, wkt_a, b, wkt_b, cell, most=most).select(a, b, F.least(F.col("covered") / F.col("area"), F.lit(1.0)).alias("share"), "is_within")


def best_container(left: DataFrame, right: DataFrame, a: str, b: str, wkt_a: str, wkt_b: str, cell: float, *, whole: bool = True, most: int = MOST) -> DataFrame:
    """Each left polygon with the right one that contains it (``whole``) or that covers most of it; the smaller key of equals, null for none."""
    met = overlaps(left, right, a, b, wkt_a, wkt_b, cell, most=most)
    if whole:
        met = met.where("is_within").withColumn("share", F.lit(1.0))
    best = met.groupBy(a).agg(F.max(F.struct(F.round("share", 9).alias("share"), (-F.col(b)).alias("minus"))).alias("w"))
    return left.select(a).join(best.select(a, (-F.col("w.minus")).alias(b), F.col("w.share").alias("share")), a, "left")


def at_centroid(areas: DataFrame, key: str, wkt: str, values: DataFrame, transform: tuple[float, ...], value: str = "value") -> DataFrame:
    """(key, value): what a coarse raster (row, col, value) has at the pixel of each polygon's centroid; null beyond it."""
    x0, dx, _, y0, _, dy = transform
    m = areas.select(F.col(key).alias("_key"), measures(wkt).alias("m"))
    place = m.select("_key", F.floor((F.col("m.y") - y0) / dy).cast("int").alias("row"), F.floor((F.col("m.x") - x0) / dx).cast("int").alias("col"))
    return place.join(values.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), value), ["row", "col"], "left").select(F.col("_key").alias(key), value)
