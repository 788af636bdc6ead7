"""Nearest rows against brute force: clusters and far outliers, repeated points, ties, nulls, few rows; and linear time on a cluster with an outlier."""

from __future__ import annotations

import numpy as np
import pytest

from terrasieve.operators import ml, neighbours


def brute(rows, k):
    known = [(key, np.array(x, float)) for key, *x in rows if all(v is not None and v == v for v in x)]
    out = set()
    for key, x in known:
        near = sorted((float(((x - y) ** 2).sum()), other) for other, y in known if other != key)[:k]
        out |= {(key, other, i + 1) for i, (_, other) in enumerate(near)}
    return out


def found(spark, rows, k, **options):
    df = spark.createDataFrame(rows, "id long, a double, b double")
    return {tuple(r) for r in ml.nearest_rows(df, ["a", "b"], "id", k, **options).collect()}


def test_equals_brute_force_on_clusters_outliers_and_ties(spark):
    r = np.random.default_rng(6)
    rows = [(i, float(r.normal(0, 1e-3)), float(r.normal(0, 1e-3))) for i in range(250)]
    rows += [(300 + i, float(r.normal(5, 0.1)), float(r.normal(-5, 3))) for i in range(100)]
    rows += [(500, 1e9, -1e9), (501, 1e9, 1e9)] + [(600 + i, float(i % 5), float(i % 3)) for i in range(60)]  # grid: ties, four rows a place
    rows += [(700, None, 1.0), (701, 1.0, None), (702, float("nan"), 0.0), (703, None, None)]
    for leaf in (8, 1000):
        assert found(spark, rows, 4, leaf=leaf) == brute(rows, 4)


def test_nulls_are_nobodys_neighbours(spark):
    rows = [(0, None, 0.0), *[(i, float(i), 0.0) for i in range(1, 12)]]
    got = found(spark, rows, 2)
    assert got == brute(rows, 2) and {o for key, o, _ in got if key == 11} == {10, 9}


@pytest.mark.parametrize("rows", [[], [(1, 0.0, 0.0)], [(1, 0.0, 0.0), (2, 0.0, 0.0)], [(i, 1.0, 1.0) for i in range(40)], [(1, None, None)]])
def test_few_rows_and_copies(spark, rows):
    assert found(spark, rows, 3) == brute(rows, 3)


def test_compared_pairs_grow_with_the_rows(spark):
    """One outlier doesn't put all others in one cell."""
    r = np.random.default_rng(7)
    for n in (2000, 4000):
        x = np.concatenate([r.normal(0, 1, (n, 2)), [[1e12, 1e12]]])
        tree = neighbours.Cells(x, n // 64 + 1)
        assert np.bincount(tree.of(x)).max() <= 128


def test_synthetic_rows_lie_between_neighbours(spark):
    r = np.random.default_rng(8)
    rows = [(i, int(i % 3 == 0), float(r.normal()), float(r.normal())) for i in range(60)] + [(99, 1, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")
    made = {x.id: (x.a, x.b) for x in ml.oversampled(df, "y", 1, ["a", "b"], "id", 3).collect()}
    minority = {i: np.array([a, b]) for i, y, a, b in rows if y == 1 and a is not None}
    assert set(made) == set(minority)
    near = brute([(i, *x) for i, x in minority.items()], 3)
    for i, x in made.items():
        ends = [minority[o] - minority[i] for key, o, _ in near if key == i]
        assert any(abs(d[0] * (x[1] - minority[i][1]) - d[1] * (x[0] - minority[i][0])) < 1e-9 and 0 <= (np.array(x) - minority[i]) @ d <= d @ d for d in ends)
