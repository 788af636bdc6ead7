"""Nearest rows by features, exactly, on data that clusters and has outliers.

Equal feature vectors are one point. A bounded sample decides medians that cut space in cells of
some ``LEAF`` points; the sample only spreads the work. The cells' true boxes are measured
over all points. A point looks in its own cell first, then in every cell whose box is
nearer than the k-th neighbour found there, so results don't depend on the cut.

Rows with a null or NaN feature have no distance: they are neither answered nor found. Ties go to the smaller key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut

#: Points to a cell, about, cells at most (their boxes go to every task), sampled points to a cell.
LEAF, MOST_CELLS, SAMPLED = 128, 1 << 15, 8


class Cells:
    """A tree of median cuts; the leaves are numbered from the left."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.depth = max(0, int(np.ceil(np.log2(max(1, cells)))))
        self.axis, self.at = np.zeros(1 << self.depth, int), np.zeros(1 << self.depth)
        self._split(1, sample, 0)

    def _split(self, node: int, x: np.ndarray, level: int) -> None:
        if level == self.depth:
            return
        if len(x):
            self.axis[node] = int((x.max(axis=0) - x.min(axis=0)).argmax())
            self.at[node] = float(np.median(x[:, self.axis[node]]))
        right = x[:, self.axis[node]] > self.at[node]
        self._split(2 * node, x[~right], level + 1)
        self._split(2 * node + 1, x[right], level + 1)

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), int)
        for _ in range(self.depth):
            node = 2 * node + (x[np.arange(len(x)), self.axis[node]] > self.at[node])
        return node - (1 << self.depth)


class Boxes:
    """What each node of the tree spans, from the boxes of its leaves; empty leaves span nothing."""

    def __init__(self, depth: int, leaves: dict[int, tuple[np.ndarray, np.ndarray, int]], width: int):
        n = 1 << depth
        self.n, self.size = n, np.zeros(n, np.int64)
        self.low, self.high = np.full((2 * n, width), np.inf), np.full((2 * n, width), -np.inf)
        for leaf, (low, high, size) in leaves.items():
            self.low[n + leaf], self.high[n + leaf], self.size[leaf] = low, high, size
        for node in range(n - 1, 0, -1):
            self.low[node] = np.minimum(self.low[2 * node], self.low[2 * node + 1])
            self.high[node] = np.maximum(self.high[2 * node], self.high[2 * node + 1])

    def nearer(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of x, leaf) for all leaves whose box is no farther than the row's reach (squared)."""
        row, node = np.arange(len(x)), np.ones(len(x), int)
        while len(node) and node[0] < self.n:
            row, node = np.repeat(row, 2), np.stack([2 * node, 2 * node + 1], axis=1).reshape(-1)
            gap = np.maximum(0, np.maximum(self.low[node] - x[row], x[row] - self.high[node]))
            keep = (gap**2).sum(axis=1) <= reach[row]
            row, node = row[keep], node[keep]
        return row, node - self.n

    def surely(self, x: np.ndarray, k: int) -> float:
        """A squared distance within which k other points lie, by the far corners of boxes."""
        leaf = np.flatnonzero(self.size)
        far = (np.maximum(np.abs(x - self.low[self.n + leaf]), np.abs(x - self.high[self.n + leaf])) ** 2).sum(axis=1)
        order = np.argsort(far)
        enough = np.cumsum(self.size[leaf][order]) > k
        return float(far[order][enough.argmax()]) if enough.any() else float("inf")


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2)


def nearest_rows(df: DataFrame, features: Sequence[str], key: str, k: int, *, leaf: int = LEAF) -> DataFrame:
    """(key, other, rank): the k nearest other rows of each row whose features are all known."""
    kind, width = df.schema[key].dataType.simpleString(), len(features)
    known = df.select(F.col(key).alias("_key"), F.array(*[F.col(f).cast("double") for f in features]).alias("_x")).where(F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v)))
    known = cut(known.where("_key is not null"))
    # of equal points the k + 1 smallest keys suffice, as no row has itself for neighbour
    points = cut(least_keys(known, k + 1))
    n = points.count()
    empty = df.sparkSession.createDataFrame([], f"{key} {kind}, other {kind}, rank int")
    if not n:
        return empty
    cells = min(MOST_CELLS, n // leaf + 1)
    share = min(1.0, cells * SAMPLED / n)
    sample = np.array([r[0] for r in points.where(F.pmod(F.xxhash64("_x"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("_x").limit(2 * cells * SAMPLED).collect()], float).reshape(-1, width)
    tree = Cells(sample, cells)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("_x").to_pylist(), float).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([pa.array(tree.of(x), pa.int32()), *b.columns], ["_cell", *b.schema.names])

    held = cut(points.mapInArrow(placed, f"_cell int, _x array<double>, _keys array<{kind}>, _m long"))
    ends = held.groupBy("_cell").agg(*[f(F.col("_x")[i]) for i in range(width) for f in (F.min, F.max)], F.sum("_m")).collect()  # a row a cell, some thousands
    boxes = Boxes(tree.depth, {r[0]: (np.array(r[1:-1:2]), np.array(r[2:-1:2]), int(r[-1])) for r in ends}, width)

    def reached(cell: pd.DataFrame) -> pd.DataFrame:
        """How far the k-th other row is, as far as the cell knows."""
        x, m = np.stack(cell["_x"].to_numpy()), cell["_m"].to_numpy()
        reach = np.zeros(len(x))
        for i in range(0, len(x), 256):
            far = _far(x[i : i + 256], x)
            order = np.argsort(far, axis=1, kind="stable")
            enough = np.cumsum(m[order], axis=1) > k
            at = np.take_along_axis(far, order, axis=1)
            reach[i : i + 256] = np.where(enough.any(axis=1), at[np.arange(len(at)), enough.argmax(axis=1)], np.nan)
        for i in np.flatnonzero(np.isnan(reach)):
            reach[i] = boxes.surely(x[i], k)
        return pd.DataFrame({"_x": list(x), "_reach": reach})

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                x, reach = np.array(part.column("_x").to_pylist(), float).reshape(-1, width), part.column("_reach").to_numpy()
                row, to = boxes.nearer(x, reach * (1 + 1e-12))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), part.column("_x").take(pa.array(row)), pa.array(reach[row])], ["_cell", "_x", "_reach"])

    def found(asked: pd.DataFrame, cell: pd.DataFrame) -> pd.DataFrame:
        """Of each asking point, the rows of a cell that may be among its k nearest others."""
        out: list[tuple] = []
        if len(asked) and len(cell):
            x, y = np.stack(asked["_x"].to_numpy()), np.stack(cell["_x"].to_numpy())
            keys, reach = cell["_keys"].tolist(), asked["_reach"].to_numpy() * (1 + 1e-12)
            for i in range(0, len(x), 256):
                far = _far(x[i : i + 256], y)
                for r, d in enumerate(far):
                    near = np.flatnonzero(d <= reach[i + r])
                    met = sorted((d[j], o) for j in near for o in keys[j])[: k + 1]
                    out += [(x[i + r], float(v), o) for v, o in met]
        return pd.DataFrame(out, columns=["_x", "_d", "other"])

    asked = held.select("_cell", "_x", "_m").groupBy("_cell").applyInPandas(reached, "_x array<double>, _reach double").mapInArrow(sent, "_cell int, _x array<double>, _reach double")
    met = asked.groupBy("_cell").cogroup(held.select("_cell", "_x", "_keys").groupBy("_cell")).applyInPandas(found, f"_x array<double>, _d double, other {kind}")
    # k + 1 rows a cell that a point looked in; distances are made from the same numbers everywhere
    best = met.groupBy("_x").agg(F.slice(F.sort_array(F.collect_list(F.struct("_d", "other"))), 1, k + 1).alias("_best"))
    own = known.join(best, "_x").select(F.col("_key").alias(key), F.slice(F.filter("_best", lambda b: b["other"] != F.col("_key")), 1, k).alias("_best"))
    return own.select(key, F.posexplode("_best").alias("_p", "_b")).select(key, F.col("_b.other").alias("other"), (F.col("_p") + 1).cast("int").alias("rank"))


def least_keys(known: DataFrame, most: int) -> DataFrame:
    """(_x, _keys, _m): each point with its ``most`` smallest keys and how many rows it stands for; keys are thinned in pieces before they meet."""
    piece = F.pmod(F.xxhash64("_key"), F.lit(64))
    once = known.groupBy("_x", "_key").agg(F.count("*").alias("_n"))
    ranked = once.withColumn("_r", F.row_number().over(W.partitionBy("_x", piece).orderBy("_key")))
    few = ranked.groupBy("_x", piece.alias("_piece")).agg(F.collect_list(F.when(F.col("_r") <= most, F.col("_key"))).alias("_keys"), F.sum("_n").alias("_m"))
    return few.groupBy("_x").agg(F.slice(F.sort_array(F.flatten(F.collect_list("_keys"))), 1, most).alias("_keys"), F.sum("_m").alias("_m"))
