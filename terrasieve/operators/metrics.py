"""Agreement of predictions with what happened. Scores are counted before they are ordered, and ordered in ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import null_safe
from .windows import ranged


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts of each pair, and their share of the actual class."""
    n = df.groupBy(actual, predicted).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(actual)))


def fuzzy_confusion(df: DataFrame, predicted: str, actual: str, by: Sequence[str] = ()) -> DataFrame:
    """Sums of the lesser membership for flood (1) and none (0); oa, dt and fa from them."""
    p, a = F.col(predicted), F.col(actual)
    cell = lambda x, y: F.sum(F.least(x, y))
    m = df.groupBy(*by).agg(cell(1 - p, 1 - a).alias("tn"), cell(p, 1 - a).alias("fp"), cell(1 - p, a).alias("fn"), cell(p, a).alias("tp"))
    return m.withColumns({"oa": F.try_divide(F.expr("tp + tn"), F.expr("tp + tn + fp + fn")), "dt": F.try_divide(F.col("tp"), F.expr("tp + fn")), "fa": F.try_divide(F.col("fp"), F.expr("fp + tn"))})


def roc_curve(df: DataFrame, score: str, label: Column, by: Sequence[str] = (), buckets: int = 32) -> DataFrame:
    """A point for each distinct score, from the highest down: threshold, fpr, tpr; tp and fp so far, p and q at it.

    Scores are cut in ranges, added up inside each and moved by the sums of the ranges above, so a
    curve with many scores needs no task of its own.
    """
    n = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("threshold")).agg(F.count_if(label).alias("p"), F.count_if(~label).alias("q"))
    cut = ranged(n, by, "threshold", buckets)
    w = W.partitionBy(*by)
    down = w.orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, 0)
    sums = cut.groupBy(*by, "_b").agg(F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    above = sums.select(*by, "_b", *[(F.sum(c).over(down) - F.col(c)).alias(f"{c}a") for c in ("_p", "_q")], *[F.sum(c).over(w).alias(f"{c}n") for c in ("_p", "_q")])
    run = W.partitionBy(*by, "_b").orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, 0)
    inside = cut.withColumn("_pi", F.sum("p").over(run)).withColumn("_qi", F.sum("q").over(run))
    whole = null_safe(inside, above, [*by, "_b"]).withColumn("tp", F.col("_pi") + F.col("_pa")).withColumn("fp", F.col("_qi") + F.col("_qa"))
    return whole.select(*by, "threshold", F.try_divide(F.col("fp"), F.col("_qn")).alias("fpr"), F.try_divide(F.col("tp"), F.col("_pn")).alias("tpr"), "tp", "fp", "p", "q")


def auc(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under a curve from roc_curve, by trapezoids from (0, 0): each point knows its own step, so nothing is ordered again."""
    area = F.sum(F.col("q") * (2 * F.col("tp") - F.col("p")).cast("double"))
    return curve.groupBy(*by).agg(F.try_divide(area, 2.0 * F.sum("p") * F.sum("q")).alias("auc"))


def precision_recall(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """precision, recall and f1 at each threshold of a roc_curve."""
    precision = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    return curve.withColumn("precision", precision).withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("tpr"), F.col("precision") + F.col("tpr"))).select(*by, "threshold", "precision", F.col("tpr").alias("recall"), "f1")


def threshold_at_fpr(curve: DataFrame, target: float, by: Sequence[str] = ()) -> DataFrame:
    """The threshold whose fpr is nearest; the highest of ties."""
    best = F.min(F.struct(F.abs(F.col("fpr") - target).alias("d"), (-F.col("threshold")).alias("t")))
    return curve.groupBy(*by).agg(best.alias("b")).select(*by, (-F.col("b.t")).alias("threshold"))


def sweep(df: DataFrame, score: str, label: Column, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """tpr, fpr, ppv, npv, f1 and kappa at each threshold, all counted in one pass."""
    at = [F.struct(F.lit(float(t)).alias("threshold"), F.count_if((F.col(score) >= t) & label).alias("tp"), F.count_if((F.col(score) >= t) & ~label).alias("fp"), F.count_if((F.col(score) < t) & label).alias("fn"), F.count_if((F.col(score) < t) & ~label).alias("tn")) for t in thresholds]
    m = df.groupBy(*by).agg(F.array(*at).alias("m")).select(*by, F.inline("m"))
    n = F.expr("tp + fp + fn + tn")
    po = F.expr("tp + tn") / n
    pe = (F.expr("(tp + fp)") * F.expr("(tp + fn)") + F.expr("(fn + tn)") * F.expr("(fp + tn)")) / (n * n)
    ratio = lambda a, b: F.try_divide(F.expr(a).cast("double"), F.expr(b))
    return m.select(*by, "threshold", ratio("tp", "tp + fn").alias("tpr"), ratio("fp", "fp + tn").alias("fpr"), ratio("tp", "tp + fp").alias("ppv"), ratio("tn", "tn + fn").alias("npv"), ratio("2 * tp", "2 * tp + fp + fn").alias("f1"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def regression_errors(df: DataFrame, predicted: str, actual: str, by: Sequence[str] = ()) -> DataFrame:
    e = F.col(actual) - F.col(predicted)
    n = df.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(actual).alias("_v"))
    return n.withColumn("r2", 1 - F.try_divide(F.col("mse"), F.col("_v"))).drop("_v")


def two_thresholds(df: DataFrame, score: str, actual: str, grid: Sequence[float]) -> DataFrame:
    """Share of rows put right by each pair lo < hi that parts three classes 0, 1, 2."""
    pairs = [(a, b) for a in grid for b in grid if a < b]
    right = lambda a, b: F.avg((F.when(F.col(score) < a, 0).when(F.col(score) < b, 1).otherwise(2) == F.col(actual)).cast("double"))
    at = [F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi"), right(a, b).alias("share")) for a, b in pairs]
    return df.agg(F.array(*at).alias("m")).select(F.inline("m"))


def detection(df: DataFrame, activity: str, flag: Column, reported: Column) -> DataFrame:
    """If any pixel of an activity was flagged, against whether a loss was reported: detection and false-alarm rate."""
    one = df.groupBy(activity).agg(F.max(flag.cast("int")).alias("f"), F.max(reported.cast("int")).alias("r"))
    cells = (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1), ("tn", 0, 0))
    n = one.agg(*[F.count_if((F.col("f") == a) & (F.col("r") == b)).alias(c) for c, a, b in cells])
    return n.withColumn("detection", F.try_divide(F.col("tp"), F.expr("tp + fn"))).withColumn("false_alarm", F.try_divide(F.col("fp"), F.expr("fp + tn")))


def map_agreement(df: DataFrame, a: Column, b: Column, by: Sequence[str] = ()) -> DataFrame:
    """Two maps by region: pixels in both, in either, their ratio, and the share of b that a finds."""
    n = df.groupBy(*by).agg(F.count_if(a & b).alias("both"), F.count_if(a | b).alias("either"), F.count_if(b).alias("_b"))
    return n.select(*by, "both", "either", F.try_divide(F.col("both"), F.col("either")).alias("iou"), F.try_divide(F.col("both"), F.col("_b")).alias("found"))
