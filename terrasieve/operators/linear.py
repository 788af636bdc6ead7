"""Linear regressors from one pass over the rows.

A pass adds up, by fold, what all of them need: counts, means and the products of all features with
each other and with the label. Everything after that works on matrices as wide as there are
features, on the driver: least squares, ridge, lasso and elastic net by coordinate descent,
least-angle paths with information criteria, orthogonal matching pursuit, Bayesian and
relevance-determining ridge, and choices by cross-validation, whose errors follow from the folds' sums.

Rows with a null or NaN in a feature or the label are left out. Features that never vary get no weight.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Sums:
    """n rows, the sum of each column, and all products of columns less ``shift``; the label is the last column."""

    n: int
    total: np.ndarray
    products: np.ndarray
    shift: np.ndarray

    def __add__(self, o: Sums) -> Sums:
        return Sums(self.n + o.n, self.total + o.total, self.products + o.products, self.shift)

    def __sub__(self, o: Sums) -> Sums:
        return Sums(self.n - o.n, self.total - o.total, self.products - o.products, self.shift)

    @property
    def mean(self) -> np.ndarray:
        return self.total / max(self.n, 1)

    def centred(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Products of features with each other, with the label, and the label's own, about the means."""
        m = self.mean
        c = self.products - self.n * np.outer(m, m)
        return c[:-1, :-1], c[:-1, -1], float(c[-1, -1])

    def error(self, model: Model) -> float:
        """The mean square error of a model on these rows."""
        w = np.append(-model.weights, 1.0)
        off = model.intercept - (self.shift[-1] - model.weights @ self.shift[:-1])
        return float((w @ self.products @ w - 2 * off * (w @ self.total) + self.n * off * off) / max(self.n, 1))


@dataclass
class Model:
    weights: np.ndarray
    intercept: float

    def predict(self, features: Sequence[str]) -> Column:
        return sum((F.col(c) * float(w) for c, w in zip(features, self.weights)), F.lit(float(self.intercept)))


def gathered(df: DataFrame, features: Sequence[str], label: str, folds: int = 5, key: str | None = None) -> list[Sums]:
    """Sums of each fold, by hash of ``key`` (of all columns if there is none)."""
    names, width = [*features, label], len(features) + 1
    x = df.select(F.array(*[F.col(c).cast("double") for c in names]).alias("x"), F.pmod(F.xxhash64(key) if key else F.xxhash64(*names), F.lit(folds)).cast("int").alias("fold"))
    x = x.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    near = x.agg(*[F.avg(F.col("x")[i]) for i in range(width)]).first()
    shift = np.array([v or 0.0 for v in near])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            rows, fold = b.column("x").flatten().to_numpy().reshape(-1, width) - shift, b.column("fold").to_numpy()
            for f in np.unique(fold).tolist():
                y = np.column_stack([np.ones((fold == f).sum()), rows[fold == f]])
                held[f] = held.get(f, 0) + y.T @ y
        for f, m in held.items():
            at = np.arange(m.size)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, f, np.int32)), pa.array(at.astype(np.int32)), pa.array(m.reshape(-1))], ["fold", "at", "v"])

    sums = x.mapInArrow(run, "fold int, at int, v double").groupBy("fold", "at").agg(F.sum("v").alias("v")).collect()  # a number a fold and pair of columns
    whole = np.zeros((folds, (width + 1) ** 2))
    for r in sums:
        whole[r.fold, r.at] = r.v
    return [Sums(round(m[0, 0]), m[0, 1:], m[1:, 1:], shift) for m in whole.reshape(folds, width + 1, width + 1)]


def _model(s: Sums, w: np.ndarray) -> Model:
    m = s.mean + s.shift
    return Model(w, float(m[-1] - w @ m[:-1]))


def least_squares(s: Sums, ridge: float = 0.0) -> Model:
    g, c, _ = s.centred()
    return _model(s, np.linalg.solve(g + ridge * np.eye(len(g)), c) if ridge else np.linalg.lstsq(g, c, rcond=1e-12)[0])


def elastic(s: Sums, alpha: float, share: float = 1.0, rounds: int = 20_000, tolerance: float = 1e-12) -> Model:
    """Half the mean square error, plus alpha times ``share`` of the weights' sizes and the rest of half their squares; by coordinates."""
    g, c, _ = s.centred()
    w, l1, l2 = np.zeros(len(c)), alpha * share * s.n, alpha * (1 - share) * s.n
    for _ in range(rounds):
        most = 0.0
        for j in range(len(w)):
            if g[j, j] <= 0:
                continue
            r = c[j] - g[j] @ w + g[j, j] * w[j]
            new = np.sign(r) * max(abs(r) - l1, 0.0) / (g[j, j] + l2)
            most, w[j] = max(most, abs(new - w[j])), new
        if most <= tolerance * max(1.0, np.abs(w).max(initial=0)):
            break
    return _model(s, w)


def angle_path(s: Sums, *, lasso: bool = False) -> list[tuple[float, np.ndarray]]:
    """(alpha, weights) at each corner of the least-angle path; with ``lasso`` features whose weight turns leave again."""
    g, c, _ = s.centred()
    p, w, active, dropped = len(c), np.zeros(len(c)), [], False
    usable = np.diag(g) > 1e-12 * max(np.diag(g).max(initial=0), 1e-300)
    path = [(np.abs(c[usable]).max(initial=0) / max(s.n, 1), w.copy())]
    while True:
        r = c - g @ w
        rest = [j for j in range(p) if usable[j] and j not in active]
        if not dropped and rest:
            j = max(rest, key=lambda i: abs(r[i]))
            trial = [*active, j]
            if np.linalg.cond(g[np.ix_(trial, trial)]) < 1e12:
                active.append(j)
            else:
                usable[j] = False
                continue
        if not active or (most := np.abs(r[active]).max()) <= 1e-12 * max(np.abs(c).max(), 1e-300):
            break
        sign = np.sign(r[active])
        d = np.linalg.solve(g[np.ix_(active, active)], sign)  # along it the active correlations fall at one rate
        a = g[:, active] @ d
        step, leaves = most, None
        for j in rest:
            if usable[j] and j not in active:
                step = min([step, *[t for t in ((most - r[j]) / (1 - a[j]) if a[j] != 1 else -1, (most + r[j]) / (1 + a[j]) if a[j] != -1 else -1) if t > 1e-14 * most]])
        if lasso:
            for i, j in enumerate(active):
                t = -w[j] / d[i] if d[i] else -1
                if 1e-14 * most < t < step:
                    step, leaves = t, j
        w[active] += step * d
        if dropped := leaves is not None:
            w[leaves] = 0.0
            active.remove(leaves)
        path.append((max(most - step, 0.0) / s.n, w.copy()))
        if most - step <= 1e-12 * most or len(path) > 8 * p + 8:
            break
    return path


def at_alpha(path: list[tuple[float, np.ndarray]], alpha: float) -> np.ndarray:
    """The path's weights at alpha, straight between its corners."""
    for (a0, w0), (a1, w1) in zip(path, path[1:]):
        if a1 <= alpha <= a0:
            return w0 if a0 == a1 else w0 + (w1 - w0) * (a0 - alpha) / (a0 - a1)
    return path[0][1] if alpha > path[0][0] else path[-1][1]


def least_angle(s: Sums) -> Model:
    return _model(s, angle_path(s)[-1][1])


def lasso_path(s: Sums, alpha: float) -> Model:
    return _model(s, at_alpha(angle_path(s, lasso=True), alpha))


def lasso_criterion(s: Sums, penalty: str = "aic") -> Model:
    """The corner of the lasso path of least Akaike or Bayes criterion, the noise taken from least squares."""
    g, c, y = s.centred()
    rest = lambda w: max(y - 2 * w @ c + w @ g @ w, 0.0)
    noise = max(rest(least_squares(s).weights) / max(s.n - len(c) - 1, 1), 1e-300)
    each = 2.0 if penalty == "aic" else float(np.log(max(s.n, 1)))
    best = min(angle_path(s, lasso=True), key=lambda aw: rest(aw[1]) / noise + each * np.count_nonzero(aw[1]))
    return _model(s, best[1])


def matching_pursuit(s: Sums, most: int | None = None) -> Model:
    """Features taken one by one, each the most alike to what is left; a tenth of them unless told."""
    g, c, _ = s.centred()
    most, active, w = most or max(len(c) // 10, 1), [], np.zeros(len(c))
    while len(active) < most:
        r = np.abs(c - g @ w)
        r[active] = -1
        j = int(r.argmax())
        if r[j] <= 1e-12 * max(np.abs(c).max(), 1e-300):
            break
        active.append(j)
        w = np.zeros(len(c))
        w[active] = np.linalg.lstsq(g[np.ix_(active, active)], c[active], rcond=1e-12)[0]
    return _model(s, w)


#: Shape and rate of both prior gammas, and when iterations stop.
_PRIOR, _ROUNDS, _STILL = 1e-6, 300, 1e-3


def bayes_ridge(s: Sums) -> Model:
    """Noise and one width of all weights, both by evidence."""
    g, c, y = s.centred()
    e, v = np.linalg.eigh(g)
    e, w, noise, width = np.maximum(e, 0), np.zeros(len(c)), 1 / (y / max(s.n, 1) + np.finfo(float).eps), 1.0
    for _ in range(_ROUNDS):
        new = v @ ((v.T @ c) / (e + width / noise))
        bound = float((noise * e / (width + noise * e)).sum())
        width = (bound + 2 * _PRIOR) / (new @ new + 2 * _PRIOR)
        noise = (s.n - bound + 2 * _PRIOR) / (max(y - 2 * new @ c + new @ g @ new, 0.0) + 2 * _PRIOR)
        still, w = np.abs(new - w).sum() < _STILL, new
        if still:
            break
    return _model(s, v @ ((v.T @ c) / (e + width / noise)))


def relevance(s: Sums, least: float = 1e4) -> Model:
    """A width for each weight by evidence; features whose inverse width passes ``least`` are left out."""
    g, c, y = s.centred()
    w, width, noise = np.zeros(len(c)), np.ones(len(c)), 1 / (y / max(s.n, 1) + np.finfo(float).eps)
    kept = np.ones(len(c), bool)
    for _ in range(_ROUNDS):
        cov = np.linalg.inv(np.diag(width[kept]) + noise * g[np.ix_(kept, kept)])
        new = np.zeros(len(c))
        new[kept] = noise * cov @ c[kept]
        bound = 1 - width[kept] * np.diag(cov)
        width[kept] = (bound + 2 * _PRIOR) / (new[kept] ** 2 + 2 * _PRIOR)
        noise = (s.n - bound.sum() + 2 * _PRIOR) / (max(y - 2 * new @ c + new @ g @ new, 0.0) + 2 * _PRIOR)
        kept = width < least
        new[~kept] = 0
        still, w = np.abs(new - w).sum() < _STILL, new
        if still or not kept.any():
            break
    return _model(s, w)


def by_folds(folds: Sequence[Sums], fit, candidates: Sequence[float]) -> tuple[float, Model]:
    """The candidate with the least error over all folds, each held out in turn, fitted to all rows; the first of equals."""
    whole = folds[0]
    for f in folds[1:]:
        whole = whole + f
    used = [f for f in folds if f.n and whole.n > f.n]
    error = lambda a: sum(f.n * f.error(fit(whole - f, a)) for f in used)
    best = min(candidates, key=error)
    return best, fit(whole, best)


def regressors(folds: Sequence[Sums]) -> dict[str, Model]:
    """All linear regressors over the same sums."""
    whole = folds[0]
    for f in folds[1:]:
        whole = whole + f
    top = np.abs(whole.centred()[1]).max(initial=0) / max(whole.n, 1)
    alphas = [top * 10 ** (-3 * i / 49) for i in range(50)]
    return {
        "plain": least_squares(whole), "ridge": least_squares(whole, 1.0), "ridge_cv": by_folds(folds, least_squares, (0.1, 1.0, 10.0))[1],
        "lasso": elastic(whole, 1.0), "lasso_cv": by_folds(folds, lambda s, a: elastic(s, a, tolerance=1e-8), alphas)[1], "elastic": elastic(whole, 1.0, 0.5),
        "lars": least_angle(whole), "lasso_lars": lasso_path(whole, 1.0), "lasso_lars_ic": lasso_criterion(whole), "lasso_lars_cv": by_folds(folds, lasso_path, alphas)[1],
        "omp": matching_pursuit(whole), "bayes_ridge": bayes_ridge(whole), "relevance": relevance(whole),
    }
