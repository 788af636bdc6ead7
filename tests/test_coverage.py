"""Covered areas against sampled points, and unions, containers and rasters on polygons with holes, many parts, ties and nulls."""

from __future__ import annotations

import numpy as np
import pytest

from terrasieve.operators import coverage as C
from terrasieve.operators.geometry import contains, rings, shape, to_wkt


def star(r, x, y, corners, radius):
    turn, far = np.sort(r.uniform(0, 2 * np.pi, corners)), r.uniform(0.3, 1, corners) * radius
    return np.stack([x + far * np.cos(turn), y + far * np.sin(turn)], axis=1)


def box(x0, y0, x1, y1):
    return f"POLYGON (({x0} {y0}, {x1} {y0}, {x1} {y1}, {x0} {y1}, {x0} {y0}))"


@pytest.mark.parametrize("seed", range(8))
def test_covered_area_equals_sampled_share(seed):
    r = np.random.default_rng(seed)
    inner = [[star(r, 0, 0, 9, 1.0), star(r, 0, 0, 5, 0.2)]]
    others = [[[star(r, *r.uniform(-0.8, 0.8, 2), 7, 1.2)]] for _ in range(3)]
    window = (-0.5, -0.4, 0.6, 0.7) if seed % 2 else (-3.0, -3.0, 3.0, 3.0)
    total, covered = C.covered_area(C.edges_of(inner), [C.edges_of(o) for o in others], window)
    points = r.uniform(window[:2], window[2:], (200_000, 2))
    inside, any_other = contains(inner, *points.T), np.any([contains(o, *points.T) for o in others], axis=0)
    area = (window[2] - window[0]) * (window[3] - window[1])
    assert total == pytest.approx(inside.mean() * area, abs=0.005 * area) and covered == pytest.approx((inside & any_other).mean() * area, abs=0.005 * area)


def test_union_of_random_polygons_whole_or_cut_in_small_cells(spark):
    r = np.random.default_rng(3)
    areas = [(i, to_wkt([[star(r, *r.uniform(0, 10, 2), 8, 1.5)]])) for i in range(30)] + [(90, None), (91, "POINT (1 1)"), (92, "POLYGON EMPTY")]
    parts = [(i % 3, to_wkt([[star(r, *r.uniform(0, 10, 2), 7, 4.0)]])) for i in range(40)] + [(0, None)]
    a, p = spark.createDataFrame(areas, "k int, w string"), spark.createDataFrame(parts, "g int, w string")
    found = {(x.k, x.g): x for x in C.covered_by_union(a, p, "k", "w", "g", "w", 3.0).collect()}
    cut = {(x.k, x.g): x for x in C.covered_by_union(a, p, "k", "w", "g", "w", 3.0, most=24).collect()}
    assert set(found) == set(cut) and all(cut[x].covered == pytest.approx(found[x].covered, rel=1e-9) and cut[x].is_within == found[x].is_within for x in found)
    assert any(x.is_within for x in found.values()) and not all(x.is_within for x in found.values())
    for (k, g), x in found.items():
        one = rings(dict(areas)[k])
        low, high = one[0][0].min(axis=0), one[0][0].max(axis=0)
        points = r.uniform(low, high, (20_000, 2))
        points = points[contains(one, *points.T)]
        inside = np.any([contains(rings(w), *points.T) for of, w in parts if of == g and w], axis=0)
        assert x.covered / shape(one)[0] == pytest.approx(inside.mean(), abs=0.02) and (not x.is_within or inside.all())


def test_union_has_no_seams_and_keeps_holes(spark):
    a = spark.createDataFrame([(1, box(1, 1, 3, 2)), (2, box(0, 0, 4, 4)), (3, box(5, 5, 6, 6)), (4, box(0.5, 0.5, 1, 1))], "k int, w string")
    holed = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1.5 2.5, 2.5 2.5, 2.5 3.5, 1.5 3.5, 1.5 2.5))"
    p = spark.createDataFrame([("halves", box(0, 0, 2, 4)), ("halves", box(2, 0, 4, 4)), ("halves", box(1, 0, 3, 4)), ("holed", holed)], "g string, w string")
    found = {(x.k, x.g): (round(x.covered, 9), x.is_within) for x in C.covered_by_union(a, p, "k", "w", "g", "w", 1.5).collect()}
    assert found == {(1, "halves"): (2.0, True), (1, "holed"): (2.0, True), (2, "halves"): (16.0, True), (2, "holed"): (15.0, False), (4, "halves"): (0.25, True), (4, "holed"): (0.25, True)}


def test_best_container_ties_and_none(spark):
    a = spark.createDataFrame([(1, box(0, 0, 1, 1)), (2, box(0, 0, 3, 1)), (3, box(9, 9, 10, 10)), (4, None)], "k int, w string")
    b = spark.createDataFrame([(7, box(0, 0, 2, 2)), (5, box(-1, -1, 2, 2)), (6, box(2, 0, 3, 1)), (8, None)], "p int, u string")
    one = {r.k: r.p for r in C.best_container(a, b, "k", "p", "w", "u", 1.0).collect()}
    assert one == {1: 5, 2: None, 3: None, 4: None}
    most = {r.k: (r.p, r.share) for r in C.best_container(a, b, "k", "p", "w", "u", 1.0, whole=False).collect()}
    assert most[1] == (5, 1.0) and most[2][0] == 5 and most[2][1] == pytest.approx(2 / 3) and most[3] == (None, None)
    nothing = spark.createDataFrame([], "p int, u string")
    assert {r.p for r in C.best_container(a, nothing, "k", "p", "w", "u", 1.0).collect()} == {None}


def test_value_at_centroid(spark):
    a = spark.createDataFrame([(1, box(0, 0, 10, 10)), (2, box(30, 0, 50, 10)), (3, None)], "k int, w string")
    v = spark.createDataFrame([(0, 0, 1.5), (0, 1, 2.5)], "row int, col int, value double")
    assert {r.k: r.value for r in C.at_centroid(a, "k", "w", v, (0.0, 20.0, 0.0, 20.0, 0.0, -20.0)).collect()} == {1: 1.5, 2: None, 3: None}
