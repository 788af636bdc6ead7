"""Ranks, running numbers and sliding flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import null_safe


def ranged(df: DataFrame, by: Sequence[str], value: str, buckets: int, name: str = "_b") -> DataFrame:
    """Number of the value range of each row, from approximate quantiles of its group; null for null. Any bounds do: they only spread the work."""
    bounds = df.groupBy(*by).agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 1000).alias("_q"))
    cut = null_safe(df, bounds, by)  # without groups one row
    return cut.withColumn(name, F.when(F.col(value).isNotNull(), F.size(F.filter(F.array_distinct("_q"), lambda q: q < F.col(value))))).drop("_q")


def percent_rank_avg(df: DataFrame, by: Sequence[str], value: str, name: str = "pct", buckets: int = 32) -> DataFrame:
    """Rank with averaged ties over the count of known values; null for null.

    Rows are counted by value before anything is ordered, so a value that a third of the rows
    have is one row. The counted values of a group are cut in ranges, summed inside each and moved
    by the count of the ranges below: the ranks are exact and no group needs a task of its own.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    cut = ranged(counted, by, value, buckets)
    sums = cut.groupBy(*by, "_b").agg(F.sum("_n").alias("_s"))
    w = W.partitionBy(*by)
    below = sums.select(*by, "_b", (F.sum("_s").over(w.orderBy("_b")) - F.col("_s")).alias("_below"), F.sum("_s").over(w).alias("_all"))
    inside = W.partitionBy(*by, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    ranked = null_safe(cut.withColumn("_upto", F.sum("_n").over(inside)), below, [*by, "_b"])
    pct = (F.col("_below") + F.col("_upto") - (F.col("_n") - 1) / 2) / F.col("_all")
    return null_safe(df, ranked.select(*by, value, pct.alias(name)), [*by, value], "left")


def decile_counts(df: DataFrame, key: Sequence[str], pct: str) -> DataFrame:
    """Counts and percentages of known ranks by tenth: [0, .1], (.1, .2], ... (.9, 1]."""
    x = F.col(pct)
    inside = [x.between(0, 0.1), *[(x > k / 10) & (x <= (k + 1) / 10) for k in range(1, 10)]]
    n = df.groupBy(*key).agg(F.count(pct).alias("n"), *[F.count_if(c).alias(f"n_{k}") for k, c in enumerate(inside)])
    return n.select(*key, "n", *[f"n_{k}" for k in range(10)], *[F.try_divide(100 * F.col(f"n_{k}"), F.col("n")).alias(f"pct_{k}") for k in range(10)])


def running_number(by: Sequence[str], order: Sequence[str], when: Column) -> Column:
    """How many rows so far fulfil a condition."""
    return F.sum(when.cast("int")).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def any_within(df: DataFrame, by: Sequence[str], day: str, flag: str, days: int, name: str = "near_flag") -> DataFrame:
    """If the flag is set within some days before or after."""
    at = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    return df.withColumn("_d", at).withColumn(name, F.max(F.col(flag).cast("int")).over(W.partitionBy(*by).orderBy("_d").rangeBetween(-days, days))).drop("_d")


def gaps(df: DataFrame, by: Sequence[str], day: str, name: str = "gap") -> DataFrame:
    """Days since the row before."""
    return df.withColumn(name, F.datediff(F.col(day), F.lag(day).over(W.partitionBy(*by).orderBy(day))))


def consecutive(df: DataFrame, by: Sequence[str], day: str, rows: int, days: int) -> DataFrame:
    """First days of ``rows`` successive rows that span exactly ``days``."""
    w = W.partitionBy(*by).orderBy(day)
    return df.withColumn("_last", F.lead(day, rows - 1).over(w)).where(F.datediff(F.col("_last"), F.col(day)) == days).drop("_last")


def yearly_index(by: Sequence[str], day: str) -> Column:
    return F.row_number().over(W.partitionBy(*by, F.year(day)).orderBy(day))


def group_spread(df: DataFrame, by: Sequence[str], value: str, least: float = 1.0) -> DataFrame:
    """Rows of groups whose mean square deviation is above a bound."""
    return df.withColumn("_v", F.var_pop(value).over(W.partitionBy(*by))).where(F.col("_v") > least).drop("_v")


def group_size(df: DataFrame, by: Sequence[str], least: int) -> DataFrame:
    """Rows of groups with enough rows: sizes are counted before anything is joined."""
    return df.join(df.groupBy(*by).count().where(F.col("count") >= least).drop("count"), list(by), "left_semi")
