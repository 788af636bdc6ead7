"""Clusters down a kept tree against plain numpy, and series gathered from blocks against the long table."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasieve.operators import blocks as B
from terrasieve.operators import ml


def brute_paths(x: np.ndarray, levels: int, steps: int) -> np.ndarray:
    path = np.zeros(len(x), int)
    for _ in range(levels):
        side = np.zeros(len(x), int)
        for p in np.unique(path):
            y = x[path == p]
            wide = int((y.max(axis=0) - y.min(axis=0)).argmax())
            a, b = y.mean(axis=0), y.mean(axis=0)
            a[wide], b[wide] = y[:, wide].min(), y[:, wide].max()
            for _ in range(steps):
                near = ((y - b) ** 2).sum(axis=1) < ((y - a) ** 2).sum(axis=1)
                new = y[~near].mean(axis=0) if (~near).any() else a, y[near].mean(axis=0) if near.any() else b
                if np.array_equal(new[0], a) and np.array_equal(new[1], b):
                    break
                a, b = new
            if tuple(a) > tuple(b):
                a, b = b, a
            side[path == p] = ((y - b) ** 2).sum(axis=1) < ((y - a) ** 2).sum(axis=1)
        path = 2 * path + side
    return path


@pytest.mark.parametrize("steps", [1, 10])
def test_paths_equal_numpy(spark, steps):
    r = np.random.default_rng(10)
    x = np.concatenate([r.normal(m, s, (60, 2)) for m, s in ((0, 1), (8, 0.5), ([3, -9], 2), ([20, 20], 0.1))]).round(3)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, a double, b double").repartition(4)
    got = {q.id: q.path for q in ml.path_clusters(df, ["a", "b"], 4, steps).collect()}
    assert [got[i] for i in range(len(x))] == brute_paths(x, 4, steps).tolist()


def test_paths_of_unknown_places_and_of_nothing(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0), (3, None, 1.0), (4, float("nan"), 1.0)], "id int, a double, b double")
    assert {r.id: r.path for r in ml.path_clusters(df, ["a", "b"], 2).collect()} == {1: 0, 2: 2, 3: None, 4: None}
    assert ml.path_clusters(df.limit(0), ["a", "b"], 2).count() == 0


def test_series_from_blocks_equal_the_long_table(spark):
    r = np.random.default_rng(11)
    cube = {(t, int(y), int(x)): float(r.normal()) for t in (3, 7, 8, 20) for y, x in r.integers(-6, 30, (120, 2))}
    long = spark.createDataFrame([(*k, v) for k, v in cube.items()] + [(3, 0, 0, None), (None, 1, 1, 1.0), (3, None, 1, 1.0)], "t int, y int, x int, v double")
    cube.pop((3, 0, 0), None) if (3, 0, 0) not in cube else None
    asked = [(i, int(y), int(x)) for i, (y, x) in enumerate(r.integers(-8, 34, (300, 2)))] + [(900, None, 1), (901, 5, None), (902, 10_000, 1)] + [(1000 + i, 2, 3) for i in range(200)]
    df = spark.createDataFrame(asked, "id int, y int, x int")
    for side in (4, 64):
        blocks = B.as_blocks(long, "t", "y", "x", "v", side)
        got = {q.id: {s.layer: s.value for s in q.series or [] if s.value is not None} for q in B.gathered(df, blocks, "y", "x", side).collect()}
        assert set(got) == {i for i, _, _ in asked}
        for i, y, x in asked:
            assert got[i] == {t: v for (t, b, a), v in cube.items() if (b, a) == (y, x)}, (side, i)


def test_a_block_is_a_row_and_layers_keep_their_order(spark):
    long = spark.range(2000).select((F.floor(F.col("id") / 400) * 3).alias("t"), (F.col("id") % 20).alias("y"), (F.col("id") % 31).alias("x"), F.col("id").cast("double").alias("v"))
    blocks = B.as_blocks(long, "t", "y", "x", "v", 16)
    assert blocks.count() == 4 and {tuple(b.layers) for b in blocks.collect()} == {(0, 3, 6, 9, 12)}
    one = B.gathered(spark.createDataFrame([(0, 0)], "y int, x int"), blocks, "y", "x", 16).first()
    assert [s.layer for s in one.series] == [0, 3, 6, 9, 12]
    assert B.gathered(spark.createDataFrame([(0, 0)], "y int, x int"), blocks.limit(0), "y", "x", 16).first().series is None


def test_whole_subtrees_are_held_out(spark):
    df = spark.range(4096).select(F.col("id").cast("int").alias("path"))
    got = {r.path: r.held for r in df.select("path", ml.cluster_split(depth=3, share=30).alias("held")).collect()}
    assert all(len({got[p] for p in ml.descendants(top, 9, 12)}) == 1 for top in range(512))
    assert 0.2 < sum(got.values()) / len(got) < 0.4
    deeper = {r.path: r.held for r in df.select("path", ml.cluster_split(depth=3, share=60).alias("held")).collect()}
    assert all(deeper[p] for p, held in got.items() if held)
