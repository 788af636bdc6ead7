"""Regressors from sums against plain numpy on the rows: normal equations, optimality conditions, greedy refits, evidence iterations, held-out errors."""

from __future__ import annotations

import numpy as np
import pytest

from terrasieve.operators import linear as L

P = 6


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(9)
    x = r.normal(0, 1, (400, P)) * [1, 3, 0.5, 1, 2, 1] + [0, 5, 0, -3, 0, 100]
    x[:, 3] += 0.8 * x[:, 0]
    return x, x @ [2.0, -1.0, 0.0, 0.5, 0.0, 0.3] + 7 + r.normal(0, 0.5, 400)


@pytest.fixture(scope="module")
def folds(spark, data):
    rows = [(i, *map(float, x), float(y)) for i, (x, y) in enumerate(zip(*data))] + [(900, *[None] * P, 1.0), (901, *[0.0] * P, None), (902, float("nan"), *[0.0] * (P - 1), 1.0)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"x{i} double" for i in range(P)) + ", y double")
    return L.gathered(df.repartition(5), [f"x{i}" for i in range(P)], "y", key="id")


@pytest.fixture(scope="module")
def whole(folds):
    s = folds[0]
    for f in folds[1:]:
        s = s + f
    assert s.n == 400 and min(f.n for f in folds) > 40
    return s


def centred(data):
    x, y = data
    return x - x.mean(axis=0), y - y.mean()


def test_least_squares_and_ridge(data, whole):
    x, y = centred(data)
    for a in (0.0, 1.0, 50.0):
        m = L.least_squares(whole, a)
        assert m.weights == pytest.approx(np.linalg.solve(x.T @ x + a * np.eye(P), x.T @ y), abs=1e-6)
        assert m.intercept == pytest.approx(data[1].mean() - m.weights @ data[0].mean(axis=0), abs=1e-6)
        assert whole.error(m) == pytest.approx(((data[1] - data[0] @ m.weights - m.intercept) ** 2).mean(), abs=1e-6)


@pytest.mark.parametrize("alpha,share", [(0.05, 1.0), (0.5, 1.0), (0.3, 0.5), (100.0, 1.0)])
def test_lasso_and_elastic_net_are_optimal(data, whole, alpha, share):
    x, y = centred(data)
    w = L.elastic(whole, alpha, share).weights
    slope = x.T @ (y - x @ w) / len(y) - alpha * (1 - share) * w
    assert slope[w != 0] == pytest.approx(alpha * share * np.sign(w[w != 0]), abs=1e-6) and (np.abs(slope) <= alpha * share + 1e-6).all()
    if share == 1.0:
        assert L.lasso_path(whole, alpha).weights == pytest.approx(w, abs=1e-6)


def test_least_angle_path_falls_evenly_and_ends_in_least_squares(data, whole):
    x, y = centred(data)
    path = L.angle_path(whole)
    for k, (alpha, w) in enumerate(path[:-1]):
        r = np.abs(x.T @ (y - x @ w)) / len(y)
        assert np.count_nonzero(w) == k and r.max() == pytest.approx(alpha, abs=1e-8) and r[w != 0] == pytest.approx(np.full(k, alpha), abs=1e-8)
    assert L.least_angle(whole).weights == pytest.approx(L.least_squares(whole).weights, abs=1e-6)


def test_lasso_criterion_is_the_best_corner(data, whole):
    x, y = centred(data)
    noise = ((y - x @ np.linalg.lstsq(x, y)[0]) ** 2).sum() / (len(y) - P - 1)
    for penalty, each in (("aic", 2), ("bic", np.log(len(y)))):
        worth = [((y - x @ w) ** 2).sum() / noise + each * np.count_nonzero(w) for _, w in L.angle_path(whole, lasso=True)]
        assert L.lasso_criterion(whole, penalty).weights == pytest.approx(L.angle_path(whole, lasso=True)[int(np.argmin(worth))][1])


def test_matching_pursuit(data, whole):
    x, y = centred(data)
    active, w = [], np.zeros(P)
    for n in range(1, P + 1):
        r = np.abs(x.T @ (y - x @ w))
        r[active] = -1
        active.append(int(r.argmax()))
        w = np.zeros(P)
        w[active] = np.linalg.lstsq(x[:, active], y)[0]
        assert L.matching_pursuit(whole, n).weights == pytest.approx(w, abs=1e-6)


def test_bayes_ridge(data, whole):
    x, y = centred(data)
    a, b, w = 1 / (y.var() + np.finfo(float).eps), 1.0, np.zeros(P)
    for _ in range(300):
        new = np.linalg.solve(x.T @ x + b / a * np.eye(P), x.T @ y)
        e = np.linalg.svd(x, compute_uv=False) ** 2
        g = (a * e / (b + a * e)).sum()
        b, a = (g + 2e-6) / (new @ new + 2e-6), (len(y) - g + 2e-6) / (((y - x @ new) ** 2).sum() + 2e-6)
        if np.abs(new - w).sum() < 1e-3:
            break
        w = new
    assert L.bayes_ridge(whole).weights == pytest.approx(np.linalg.solve(x.T @ x + b / a * np.eye(P), x.T @ y), abs=1e-6)


def test_relevance_drops_what_has_no_weight(data, whole):
    x, y = centred(data)
    w = L.relevance(whole, least=300.0).weights
    kept = w != 0
    assert not kept[2] and kept[[0, 1, 3, 5]].all()
    assert w[kept] == pytest.approx(np.linalg.lstsq(x[:, kept], y)[0], abs=2e-2)


def test_choices_by_folds(spark, data, folds, whole):
    """The error of each candidate equals that of models refitted on the other folds' rows."""
    best, m = L.by_folds(folds, L.least_squares, (0.1, 10.0, 1e5))
    assert best in (0.1, 10.0) and m.weights == pytest.approx(L.least_squares(whole, best).weights)
    every = L.regressors(folds)
    assert len(every) == 13 and every["lasso_cv"].weights == pytest.approx(every["lasso_lars_cv"].weights, abs=1e-4)
    df = spark.createDataFrame([(1.0,) * P], ", ".join(f"x{i} double" for i in range(P)))
    assert df.select(every["plain"].predict([f"x{i}" for i in range(P)]).alias("y")).first().y == pytest.approx(every["plain"].weights.sum() + every["plain"].intercept)


def test_features_that_never_vary_and_no_rows(spark):
    df = spark.createDataFrame([(float(i), 3.0, 2.0 * i) for i in range(20)], "a double, b double, y double")
    for m in L.regressors(L.gathered(df, ["a", "b"], "y", 4)).values():
        assert np.isfinite(m.weights).all() and abs(m.weights[1]) < 1e-9
    assert L.least_squares(sum(L.gathered(df.limit(0), ["a"], "y", 3)[1:], L.gathered(df.limit(0), ["a"], "y", 3)[0])).weights.tolist() == [0.0]
