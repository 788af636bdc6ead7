"""Models on features: forests, searches, elimination, two stages, clusters. ``pyspark.ml`` does the fitting."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import interpolate, windows
from .lineage import cut
from .metrics import precision_recall, roc_curve
from .neighbours import nearest_rows


def pipeline(features: Sequence[str], model, *, scale: bool = False) -> Pipeline:
    steps = [VectorAssembler(inputCols=list(features), outputCol="raw" if scale else "features", handleInvalid="skip")]
    if scale:
        steps.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True))
    return Pipeline(stages=[*steps, model])


def forest(features: Sequence[str], label: str, *, trees: int = 200, depth: int = 5, seed: int = 0, scale: bool = False) -> Pipeline:
    return pipeline(features, RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed), scale=scale)


def baselines(features: Sequence[str], label: str) -> dict[str, Pipeline]:
    return {
        "svm": pipeline(features, LinearSVC(labelCol=label, maxIter=20), scale=True),
        "tree": pipeline(features, DecisionTreeClassifier(labelCol=label, maxDepth=5, seed=0)),
        "logistic": pipeline(features, LogisticRegression(labelCol=label), scale=True),
        "mlp": pipeline(features, MultilayerPerceptronClassifier(labelCol=label, layers=[len(features), 8, 2], seed=0, maxIter=50), scale=True),
    }


def regressors(features: Sequence[str], label: str) -> dict[str, Pipeline]:
    kinds = {"ridge": (0.1, 0.0), "lasso": (0.1, 1.0), "elastic": (0.1, 0.5), "plain": (0.0, 0.0)}
    out = {k: pipeline(features, LinearRegression(labelCol=label, regParam=a, elasticNetParam=b)) for k, (a, b) in kinds.items()}
    for degree in (2, 3):
        grown = [VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="skip"), PolynomialExpansion(inputCol="raw", outputCol="features", degree=degree)]
        out[f"poly{degree}"] = Pipeline(stages=[*grown, LinearRegression(labelCol=label, regParam=0.1)])
    return out


def scored(model: PipelineModel, df: DataFrame, name: str = "score") -> DataFrame:
    """The probability of class 1, without the vectors."""
    done = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return done.select(*df.columns, name)


def log_likelihood(p: str = "score"):
    """ln p(1) - ln p(0)."""
    x = F.least(F.greatest(F.col(p), F.lit(1e-12)), F.lit(1 - 1e-12))
    return F.log(x) - F.log(1 - x)


def searched(df: DataFrame, features: Sequence[str], label: str, grid: dict[str, Sequence], *, folds: int = 3, draws: int | None = None, seed: int = 0, metric: str = "areaUnderROC") -> PipelineModel:
    """Cross-validated search over a grid, or over ``draws`` of its points in a fixed order."""
    p = forest(features, label, trees=20)
    model = p.getStages()[-1]
    b = ParamGridBuilder()
    for k, v in grid.items():
        b = b.addGrid(getattr(model, k), list(v))
    points = b.build()
    if draws is not None:
        import random

        points = random.Random(seed).sample(points, min(draws, len(points)))
    return CrossValidator(estimator=p, estimatorParamMaps=points, evaluator=BinaryClassificationEvaluator(labelCol=label, metricName=metric), numFolds=folds, seed=seed).fit(df).bestModel


def importances(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))


def eliminated(df: DataFrame, features: Sequence[str], label: str, keep: int, *, drop: int = 1, **forest_options) -> list[str]:
    """Recursive elimination: the least important features go, until ``keep`` are left. The driver loops over models, not rows."""
    left = list(features)
    while len(left) > keep:
        ranked = [f for f, _ in importances(forest(left, label, **forest_options).fit(df), left)]
        left = ranked[: max(keep, len(left) - drop)]
    return left


def peak_f1(df: DataFrame, score: str, label: str) -> float:
    return precision_recall(roc_curve(df, score, F.col(label) == 1)).agg(F.max("f1")).first()[0] or 0.0


def mean_f1(df: DataFrame, features: Sequence[str], label: str, key: str, *, trials: int = 3, **forest_options) -> float:
    """Mean peak F1 over seeded 80/20 splits."""
    out = []
    for seed in range(trials):
        held = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(10)) >= 8
        model = forest(features, label, seed=seed, **forest_options).fit(df.where(~held))
        out.append(peak_f1(scored(model, df.where(held)), "score", label))
    return sum(out) / len(out)


def staged_selection(df: DataFrame, blocks: Sequence[Sequence[str]], label: str, key: str, **options) -> list[str]:
    """Blocks of features taken in turn; one stays if it lifts the mean F1."""
    kept: list[str] = []
    best = -1.0
    for block in blocks:
        f1 = mean_f1(df, [*kept, *block], label, key, **options)
        if f1 > best:
            kept, best = [*kept, *block], f1
    return kept


def feature_sets(features: Sequence[str]) -> list[tuple[str, ...]]:
    """All that aren't empty, small ones first."""
    return [c for n in range(1, len(features) + 1) for c in combinations(features, n)]


def two_stage(pixels: DataFrame, features: Sequence[str], label: str, plot: str, attributes: Sequence[str], loss: str, **options) -> tuple[PipelineModel, PipelineModel]:
    """Pixel forest, then a forest on each plot's mean and spread of its probability."""
    first = forest(features, label, **options).fit(pixels)
    second = forest(["score_mean", "score_std", *attributes], loss, **options).fit(rolled_up(scored(first, pixels), plot, [*attributes, loss]))
    return first, second


def rolled_up(df: DataFrame, plot: str, keep: Sequence[str]) -> DataFrame:
    return df.groupBy(plot).agg(F.avg("score").alias("score_mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("score_std"), *[F.any_value(c).alias(c) for c in keep])


def scored_windows(model: PipelineModel, df: DataFrame, key: Sequence[str], ts: str, features: Sequence[str]) -> DataFrame:
    """The score of every stretch of as many periods as the model has features; pixels with a value not above zero are left out, gaps are filled."""
    usable = df.where(F.forall(F.filter(ts, lambda x: x.isNotNull()), lambda x: x > 0) & F.exists(ts, lambda x: x.isNotNull()))
    each = usable.withColumn(ts, interpolate(ts)).select(*key, F.posexplode(windows(ts, len(features))).alias("first", "_w"))
    named = each.select(*key, "first", *[F.col("_w")[i].alias(c) for i, c in enumerate(features)])
    return scored(model, named).select(*key, "first", "score")


def tree_paths(x: np.ndarray, tree: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The path of each point down the centres of a tree's levels, a bit a level: 1 for the second centre, if it is nearer."""
    path = np.zeros(len(x), np.int64)
    for a, b in tree:
        path = 2 * path + (((x - b[path]) ** 2).sum(axis=1) < ((x - a[path]) ** 2).sum(axis=1))
    return path


def path_clusters(df: DataFrame, coordinates: Sequence[str], levels: int, steps: int = 10) -> DataFrame:
    """Two means inside each cluster, level by level; ``path`` has a bit for each level, null where a coordinate is unknown.

    All clusters of a level are fitted together. The tree of centres so far is kept, two for each cluster, and gives
    every row its path in the pass that needs it, so that no level reads what the one before has made of the
    rows. A step is one pass, whose tasks return a row for each cluster and side; a level ends when no centre moves.
    """
    n, out = len(coordinates), cut(df.withColumn("_x", F.array(*[F.col(c).cast("double") for c in coordinates])))
    whole = F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v))
    points, tree = out.where(whole).select("_x"), []
    names = [f"{k}{i}" for k in ("sum", "low", "high") for i in range(n)]

    def summed(now: tuple[np.ndarray, np.ndarray] | None) -> dict[int, tuple]:
        """Of each cluster, or of each side where there are centres: rows, mean, least and largest coordinates."""
        down = [*tree, now] if now else list(tree)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, tuple] = {}
            for b in batches:
                x = b.column("_x").flatten().to_numpy().reshape(-1, n)
                path = tree_paths(x, down)
                for p in np.unique(path).tolist():
                    y = x[path == p]
                    m, s, low, high = held.get(p, (0, 0.0, np.inf, -np.inf))
                    held[p] = m + len(y), s + y.sum(axis=0), np.minimum(low, y.min(axis=0)), np.maximum(high, y.max(axis=0))
            for p, (m, *v) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([m]), *[pa.array([float(c)]) for u in v for c in u]], ["path", "m", *names])

        parts = points.mapInArrow(run, "path long, m long, " + ", ".join(f"{c} double" for c in names)).groupBy("path")
        rows = parts.agg(F.sum("m"), *[{"sum": F.sum, "low": F.min, "high": F.max}[c.rstrip("0123456789")](c) for c in names]).collect()  # a row a cluster
        return {r[0]: (np.array(r[2 : 2 + n]) / r[1], np.array(r[2 + n : 2 + 2 * n]), np.array(r[2 + 2 * n :])) for r in rows}

    for level in range(levels):
        a, b = np.full((2, 1 << level, n), np.nan)
        for path, (mean, low, high) in summed(None).items():  # a cluster begins at both ends of its widest coordinate
            wide = int((high - low).argmax())
            a[path], b[path] = mean, mean
            a[path, wide], b[path, wide] = low[wide], high[wide]
        for _ in range(steps):
            before = a.copy(), b.copy()
            for path, (mean, _low, _high) in summed((a, b)).items():
                (b if path % 2 else a)[path // 2] = mean
            if np.array_equal(before[0], a, equal_nan=True) and np.array_equal(before[1], b, equal_nan=True):
                break
        swap = np.array([tuple(u) > tuple(v) for u, v in zip(a, b)])[:, None]
        tree.append((np.where(swap, b, a), np.where(swap, a, b)))

    @F.pandas_udf("int")
    def path(x: pd.Series) -> pd.Series:
        return pd.Series(tree_paths(np.stack(x.to_numpy()) if len(x) else np.zeros((0, n)), tree).astype(np.int32))

    return out.withColumn("path", F.when(whole, path(F.when(whole, F.col("_x")).otherwise(F.array(*[F.lit(0.0)] * n))))).drop("_x")


def cluster_split(path: str = "path", depth: int = 2, share: int = 20):
    """If a whole subtree is held out."""
    return F.pmod(F.xxhash64(F.shiftright(F.col(path), depth)), F.lit(100)) < share


def descendants(path: int, level: int, deepest: int) -> list[int]:
    """Paths at the deepest level below a node."""
    n = deepest - level
    return list(range(path << n, (path + 1) << n))


def oversampled(df: DataFrame, label: str, minority: int, features: Sequence[str], key: str, k: int = 5) -> DataFrame:
    """Synthetic minority rows, each between a row and one of its k nearest; rows with an unknown feature have no neighbours and give none."""
    rows = df.where(F.col(label) == minority).select(key, *features)
    near = nearest_rows(rows, features, key, k)
    of = near.groupBy(key).agg(F.max("rank").alias("_n"))
    picked = near.join(of, key).where(F.col("rank") == F.pmod(F.xxhash64(key), F.col("_n")) + 1).select(key, "other")
    others = rows.select(F.col(key).alias("other"), *[F.col(f).alias(f"_{f}") for f in features])
    u = F.pmod(F.xxhash64(F.lit("u"), key), F.lit(1000)) / 1000
    return rows.join(picked, key).join(others, "other").select(F.col(key), *[(F.col(f) + u * (F.col(f"_{f}") - F.col(f))).alias(f) for f in features], F.lit(minority).alias(label))


def saved(model: PipelineModel, path: str) -> PipelineModel:
    """A model written to a folder and read from it."""
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def scored_at_fpr(model: PipelineModel, df: DataFrame, label: str, fpr: float) -> DataFrame:
    """Rows with their score and if it reaches the threshold whose false positive rate is nearest to ``fpr``."""
    from .metrics import threshold_at_fpr

    done = scored(model, df)
    at = threshold_at_fpr(roc_curve(done, "score", F.col(label) == 1), fpr).first()["threshold"]
    return done.withColumn("positive", F.col("score") >= at)
