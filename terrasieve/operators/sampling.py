"""Samples that repeat: rows are ordered by a hash of their key, never by a random number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import null_safe


def md5_order(*key: str, seed: int = 0) -> Column:
    """An order that SQL engines share."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]).cast("binary"))


def hash_rank(df: DataFrame, by: Sequence[str], key: Sequence[str], seed: int = 0, digits: int = 3) -> DataFrame:
    """``_r``: each row's place from 1 in the hash order of its class.

    Rows are numbered inside stretches of the hash and moved by the counts of the stretches before,
    so a class, however large, is spread over 16 ** digits groups.
    """
    held = df.withColumn("_h", md5_order(*key, seed=seed)).withColumn("_s", F.substring("_h", 1, digits))
    counts = held.groupBy(*by, "_s").agg(F.count("*").alias("_n"))
    before = counts.select(*by, "_s", (F.sum("_n").over(W.partitionBy(*by).orderBy("_s")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*by, "_s").orderBy("_h", *key))
    return null_safe(held.withColumn("_i", inside), before, [*by, "_s"]).withColumn("_r", F.col("_before") + F.col("_i")).drop("_h", "_s", "_i", "_before")


def fraction(df: DataFrame, key: Sequence[str], share: float, seed: int = 0) -> DataFrame:
    """A share of keys, all rows of a kept key together; no shuffle."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)) < int(share * (1 << 30)))


def cap_per_class(df: DataFrame, by: Sequence[str], key: Sequence[str], most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows of a class, the first in hash order."""
    return hash_rank(df, by, key, seed).where(F.col("_r") <= most).drop("_r")


def balanced(df: DataFrame, label: str, key: Sequence[str], by: Sequence[str] = (), ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """All rows of the smallest class by distinct keys (in each stratum ``by``); of the others as many keys, times ``ratio``."""
    keys = df.select(*by, label, *key).distinct()
    sizes = keys.groupBy(*by, label).agg(F.count("*").alias("_n"))
    least = sizes.groupBy(*by).agg(F.min("_n").alias("_least"))
    sized = null_safe(null_safe(hash_rank(keys, [*by, label], key, seed), sizes, [*by, label]), least, by)  # without strata one row
    kept = sized.where((F.col("_n") == F.col("_least")) | (F.col("_r") <= F.col("_least") * ratio)).select(*by, label, *key)
    return df.join(kept, [*by, label, *key], "left_semi")


def first_by_priority(df: DataFrame, key: Sequence[str], priority: Sequence[Column]) -> DataFrame:
    """One row of each key, the first by priority."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*priority))).where("_r = 1").drop("_r")


def anchor_days(key: Column | str, first: int, last: int) -> Column:
    """A repeatable number of days in [first, last]."""
    return (F.pmod(F.xxhash64(key), F.lit(last - first + 1)) + first).cast("int")


def holdout(df: DataFrame, key: Sequence[str], share: float = 0.2, seed: int = 1) -> DataFrame:
    """``held_out``, the same for all rows of a key."""
    return df.withColumn("held_out", F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1000)) < int(1000 * share))


def share_per_class(df: DataFrame, by: Sequence[str], key: Sequence[str], share: float, seed: int = 0) -> DataFrame:
    """The first rows of each class in hash order, a share of its count rounded up."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    ranked = null_safe(hash_rank(df, by, key, seed), sizes, by)
    return ranked.where(F.col("_r") <= F.ceil(F.col("_n") * share)).drop("_r", "_n")


def by_ratio_rules(df: DataFrame, district: str, year: str, label: str, key: str, seed: int = 0) -> DataFrame:
    """Distinct keys: all with label 1, and of those with label 0 in each district and year as many as with label 1.

    Where a year has none with label 1, it is the district's ratio of both over all years, or the
    least ratio of all districts where the district has none either.
    """
    keys = df.select(district, year, label, key).distinct()
    one, no = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    ratios = keys.select(district, label, key).distinct().groupBy(district).agg(F.try_divide(one, no).alias("_ratio"))
    least = ratios.agg(F.min(F.when(F.col("_ratio") == 0, 1.0).otherwise(F.col("_ratio")))).first()[0]
    sizes = keys.groupBy(district, year).agg(one.alias("_one"), no.alias("_no")).join(ratios, district)
    by_rule = F.when(F.col("_ratio") == 0, F.lit(least)).otherwise(F.col("_ratio")) * F.col("_no")
    take = F.least(F.col("_no"), F.ceil(F.when(F.col("_one") == 0, by_rule).otherwise(F.least("_one", "_no"))))
    ranked = hash_rank(keys.where(F.col(label) == 0), [district, year], [key], seed).join(sizes.select(district, year, take.alias("_take")), [district, year])
    return keys.where(F.col(label) == 1).unionByName(ranked.where(F.col("_r") <= F.col("_take")).select(*keys.columns))
