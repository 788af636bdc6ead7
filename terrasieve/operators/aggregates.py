"""Grouped statistics, histograms, densities and thresholds."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .counting import counted
from .joins import null_safe
from .lineage import kept

QUANTILES = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)


def share_of_one(c: str) -> Column:
    """Share of rows equal to 1, nulls in the denominator."""
    return F.count_if(F.col(c) == 1) / F.count("*")


#: Parts in which the rows of a group meet what is known of the group.
LOTS = 32

#: Bits of the mantissa that each step of a selection looks at, after the exponent; a step orders 2 ** 18 counts at most.
_STEPS = (17, 17, 18)


def _parts(v: Column) -> list[Column]:
    """Whole numbers that, one after the other, order doubles: the exponent with the sign, then pieces of the mantissa. NaN comes last."""
    x, two = F.abs(v), F.lit(2.0)
    usual = (x > 0) & (x < float("inf"))
    y = F.when(usual, x).otherwise(1.0)
    near = F.floor(F.log2(y))
    near = F.when(F.pow(two, near) > y, near - 1).when(F.pow(two, near + 1) <= y, near + 1).otherwise(near)
    mantissa = ((y / F.pow(two, near) - 1) * 2.0**52).cast("long")
    sign = F.when(v < 0, -1).otherwise(1)
    out = [F.when(F.isnan(v), 9999).when(x == 0, 0).when(~usual, 5000 * sign).otherwise((near + 1075).cast("int") * sign).alias("p0")]
    left = 52
    for i, n in enumerate(_STEPS, 1):
        left -= n
        out.append((F.when(usual, F.pmod(F.shiftright(mantissa, left), F.lit(1 << n)).cast("int")).otherwise(0) * sign).alias(f"p{i}"))
    return out


def counted_values(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, _v and _n: how often each value of a group occurs, null included. Counted once and written, as it is read several times."""
    return kept(df.groupBy(*by, (F.col(value).cast("double") + 0.0).alias("_v")).agg(F.count("*").alias("_n")), "counts")


def counted_columns(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """by, _c, _v and _n: the same for each value of the c-th of many columns. Tasks count what they have before Spark adds up their counts."""
    by = list(by)
    doubles = df.select(*by, *[(F.col(c).cast("double") + 0.0).alias(f"_x{i}") for i, c in enumerate(columns)])
    if any(kind.startswith(("array", "struct", "map", "variant")) for _, kind in doubles.select(*by).dtypes):  # Arrow has no groups of these
        long = doubles.select(*by, F.posexplode(F.array(*[f"_x{i}" for i in range(len(columns))])).alias("_c", "_v"))
        return kept(long.groupBy(*by, "_c", "_v").agg(F.count("*").alias("_n")), "counts")
    schema = T.StructType([*doubles.select(*by).schema.fields, *[T.StructField(c, t) for c, t in (("_c", T.IntegerType()), ("_v", T.DoubleType()), ("_n", T.LongType()))]])
    some = doubles.mapInArrow(lambda it: counted(it, by), schema)
    return kept(some.groupBy(*by, "_c", "_v").agg(F.sum("_n").alias("_n")), "counts")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, quantiles: Sequence[float], name: str = "q") -> DataFrame:
    """by and an array of the linear quantiles of each group's known values, in the order given."""
    return quantiles_of_counts(counted_values(df.where(F.col(value).isNotNull()), by, value), by, quantiles, name)


def quantiles_of_counts(counts: DataFrame, by: Sequence[str], quantiles: Sequence[float], name: str = "q") -> DataFrame:
    """The same of values (by, _v, _n) that are counted already.

    Ranks are found first by exponent, then by pieces of the mantissa: each step adds up the counts below, so neither
    a group nor a frequent value is ever in one buffer, and no window holds more rows than a piece has numbers.
    The last pieces are looked at only for values that have the same first ones as a rank.
    """
    by = list(by)
    steps, chosen = [f"p{i}" for i in range(len(_STEPS) + 1)], None
    counted = counts.where("_v is not null").select(*by, "_v", "_n", *_parts(F.col("_v")))
    coarse = counted.groupBy(*by, *steps[:2]).agg(F.sum("_n").alias("_n"), F.min("_v").alias("_v"))
    for i, step in enumerate(steps):
        over = [*by, *steps[:i]]
        if i == 2:
            chosen = kept(chosen, "ranks")
            counted = null_safe(counted, chosen.select(*over), over)
        sums = (coarse if i < 2 else counted).groupBy(*over, step).agg(F.sum("_n").alias("_n"), F.min("_v").alias("_v"))
        if chosen is not None:
            sums = null_safe(sums, chosen, over)
        w = W.partitionBy(*over)
        sums = sums.withColumn("_upto", F.sum("_n").over(w.orderBy(step).rowsBetween(W.unboundedPreceding, 0)))
        if chosen is None:
            sums = sums.withColumn("_all", F.sum("_n").over(w))
            at = [(F.col("_all") - 1) * F.lit(float(q)) for q in quantiles]
            ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)]))
            sums = sums.withColumn("_left", F.transform(ranks, lambda r: F.struct(r.alias("rank"), r.alias("left"))))
        before = F.col("_upto") - F.col("_n")
        here = F.filter("_left", lambda r: (r["left"] >= before) & (r["left"] < F.col("_upto")))
        moved = F.transform(here, lambda r: F.struct(r["rank"].alias("rank"), (r["left"] - before).alias("left")))
        found = sums.select(*over, step, "_v", "_all", moved.alias("_left")).where(F.size("_left") > 0)
        chosen = found if i == len(steps) - 1 else found.drop("_v")
    at_rank = F.transform("_left", lambda r: F.struct(r["rank"], F.col("_v")))
    both = chosen.groupBy(*by).agg(F.map_from_entries(F.flatten(F.collect_list(at_rank))).alias("_m"), F.max("_all").alias("_all"))  # two values a quantile at most

    def one(q: float) -> Column:
        k = (F.col("_all") - 1) * F.lit(float(q))
        low, high = (F.element_at("_m", f(k).cast("long")) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise(low + (high - low) * (k - F.floor(k)))

    return both.select(*by, F.array(*[one(q) for q in quantiles]).alias(name))


def with_quantiles(df: DataFrame, by: Sequence[str], value: str, quantiles: Sequence[float], name: str) -> DataFrame:
    """Rows of known groups with the quantiles of their group, null where it has no value. A group's rows are dealt in ``LOTS``, so that none is one task."""
    bounds = kept(exact_quantiles(df, by, value, quantiles, name), "bounds").withColumn("_lot", F.explode(F.sequence(F.lit(0), F.lit(LOTS - 1))))
    plain = [c for c, kind in df.dtypes if "map<" not in kind]
    dealt = df.dropna(subset=list(by)).withColumn("_lot", F.pmod(F.xxhash64(*plain), F.lit(LOTS)).cast("int"))
    return dealt.join(bounds, [*by, "_lot"], "left").drop("_lot")


def column_stats(df: DataFrame, by: Sequence[str], columns: Sequence[str], *, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """by, column, min, max, mean, a quantile each (p5, p10, ...) and ratio, the share of ones: a row for each group and column.

    Columns become rows, so the plan is as wide for hundreds of columns as for one. All follows from one count of the values.
    """
    names = list(columns)
    counts = counted_columns(df, by, names)
    known, ones = F.when(F.col("_v").isNotNull(), F.col("_n")), F.when(F.col("_v") == 1, F.col("_n")).otherwise(0)
    plain = counts.groupBy(*by, "_c").agg(F.min("_v").alias("min"), F.max("_v").alias("max"), F.try_divide(F.sum(F.col("_v") * F.col("_n")), F.sum(known)).alias("mean"), (F.sum(ones) / F.sum("_n")).alias("ratio"))
    both = null_safe(plain, quantiles_of_counts(counts, [*by, "_c"], quantiles, "_q"), [*by, "_c"], "left")
    picks = [F.col("_q")[i].alias(f"p{round(100 * q)}") for i, q in enumerate(quantiles)]
    return both.select(*by, F.element_at(F.array(*[F.lit(c) for c in names]), F.col("_c") + 1).alias("column"), "min", "max", "mean", *picks, "ratio")


def stat_pack(df: DataFrame, by: Sequence[str], columns: Sequence[str], *, quantiles: Sequence[float] = QUANTILES, drop_null: bool = True) -> DataFrame:
    """min, max, mean, exact quantiles and share of ones of each column, side by side in a row a group."""
    outs = ["min", "max", "mean", *[f"p{round(100 * q)}" for q in quantiles], "ratio"]
    packed = column_stats(df, by, columns, quantiles=quantiles).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct(*outs).alias("s")))).alias("_s"))
    done = packed.select(*by, *[F.col("_s")[c][o].alias(f"{c}_{o}") for c in columns for o in outs])
    return done.dropna() if drop_null else done


def two_level_mean(df: DataFrame, outer: Sequence[str], inner: Sequence[str], a: str, b: str, name: str) -> DataFrame:
    """Ratio of sums inside, then mean of the ratios."""
    once = df.groupBy(*outer, *inner).agg(F.try_divide(F.sum(a), F.sum(b)).alias("_r"))
    return once.groupBy(*outer).agg(F.avg("_r").alias(name), F.count("_r").alias("n"))


def size_histogram(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """How many keys have how many rows, with the cumulative share of keys."""
    sizes = df.groupBy(*key).count().groupBy(F.col("count").alias("size")).agg(F.count("*").alias("keys"))
    return cumulative_share(sizes, [], "size", "keys")


def cumulative_share(df: DataFrame, by: Sequence[str], order: str, n: str) -> DataFrame:
    w = W.partitionBy(*by)
    return df.withColumn("share", F.sum(n).over(w.orderBy(order).rowsBetween(W.unboundedPreceding, 0)) / F.sum(n).over(w))


def bin_counts(df: DataFrame, by: Sequence[str], c: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows in equal bins over [low, high); 0 and bins + 1 hold what is outside."""
    return df.where(F.col(c).isNotNull()).groupBy(*by, F.width_bucket(F.col(c).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def ecdf(df: DataFrame, by: Sequence[str], c: str, low: float, high: float, bins: int) -> DataFrame:
    return cumulative_share(bin_counts(df, by, c, low, high, bins), by, "bin", "n")


def smallest_mode(c: Column) -> Column:
    return F.mode(c, True)


def class_share(df: DataFrame, by: Sequence[str], c: str) -> DataFrame:
    """Share of each class inside a group."""
    n = df.groupBy(*by, c).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*by)))


def valid_mask(df: DataFrame, pixel: Sequence[str], value: str, images: int, least: float = 0.7) -> DataFrame:
    """If a pixel is positive in more than a share of all images."""
    return df.groupBy(*pixel).agg(F.count_if(F.col(value) > 0).alias("n_valid")).withColumn("valid", F.col("n_valid") > least * images)


def union_mask(df: DataFrame, pixel: Sequence[str], flag: Column) -> DataFrame:
    return df.groupBy(*pixel).agg(F.max(flag.cast("int")).alias("any_flag"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Absolute correlation of each pair, strongest first; one pass makes all of them."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.abs(F.corr(a, b)).alias(f"{a}|{b}") for a, b in pairs])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs]))).orderBy(F.desc("r"), "a", "b")


def kde(df: DataFrame, c: str, low: float, high: float, points: int = 200) -> DataFrame:
    """Gaussian density on a grid, Scott's bandwidth; null where there are no values or all are equal.

    Values are counted first, so equal ones cost once; each makes its terms without a join.
    """
    stats = df.agg(F.count(c).alias("n"), F.stddev_samp(c).alias("sd")).first()
    n, h = stats["n"], (stats["sd"] or 0) * max(stats["n"], 1) ** -0.2
    step = (high - low) / (points - 1)
    if not h:
        return df.sparkSession.range(points).select(F.col("id").cast("int").alias("i"), F.lit(None).cast("double").alias("density"), (low + F.col("id") * step).alias("x"))
    counted = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("double").alias("v")).agg(F.count("*").alias("w"))
    term = lambda i: F.exp(-0.5 * F.pow((F.lit(low) + i * step - F.col("v")) / h, 2))
    each = counted.select("w", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), term)).alias("i", "t"))
    return each.groupBy("i").agg((F.sum(F.col("w") * F.col("t")) / (n * h * sqrt(2 * pi))).alias("density")).withColumn("x", low + F.col("i") * step)


def symmetric_kl(p: DataFrame, q: DataFrame) -> DataFrame:
    """Two densities (i, density), scaled together to [1, 2], compared both ways and added."""
    both = p.select("i", F.col("density").alias("p")).join(q.select("i", F.col("density").alias("q")), "i")
    bounds = both.agg(F.min(F.least("p", "q")).alias("lo"), F.max(F.greatest("p", "q")).alias("hi"))
    scaled = both.crossJoin(F.broadcast(bounds)).select(*[(1 + (F.col(c) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).alias(c) for c in ("p", "q")])
    whole = scaled.agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    norm = scaled.crossJoin(F.broadcast(whole)).select((F.col("p") / F.col("sp")).alias("p"), (F.col("q") / F.col("sq")).alias("q"))
    return norm.agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q")) + F.col("q") * F.log(F.col("q") / F.col("p"))).alias("kl"))


def otsu(df: DataFrame, by: Sequence[str], c: str, low: float, high: float, bins: int = 4096, cap: float | None = None) -> DataFrame:
    """The bin edge with the greatest variance between both sides; the first of ties. Only bins are windowed, never rows."""
    step = (high - low) / bins
    n = bin_counts(df.where((F.col(c) >= low) & (F.col(c) < high)), by, c, low, high, bins)
    x = low + (F.col("bin") - 0.5) * step
    w = W.partitionBy(*by)
    run = w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    s = n.select(*by, "bin", F.sum("n").over(run).alias("n0"), F.sum("n").over(w).alias("nn"), F.sum(F.col("n") * x).over(run).alias("s0"), F.sum(F.col("n") * x).over(w).alias("ss"))
    n1 = F.col("nn") - F.col("n0")
    between = F.col("n0") * n1 * F.pow(F.try_divide(F.col("s0"), F.col("n0")) - F.try_divide(F.col("ss") - F.col("s0"), n1), 2)
    best = s.withColumn("v", between).where("v is not null").groupBy(*by).agg(F.min(F.struct((-F.round("v", 6)).alias("v"), "bin")).alias("b"))
    edge = low + F.col("b.bin") * step
    return best.select(*by, (F.least(edge, F.lit(cap)) if cap is not None else edge).alias("threshold"))


def relative_spread(c: str) -> Column:
    """1.645 standard deviations over the mean."""
    return F.try_divide(1.645 * F.stddev_samp(c), F.avg(c))


def digitized_shares(df: DataFrame, by: Sequence[str], bins: Column, n: int, first: int = 0, prefix: str = "bin") -> DataFrame:
    """Percent of a group's rows in each of bins first to n - 1."""
    return df.withColumn("_b", bins).groupBy(*by).agg(*[(100 * F.count_if(F.col("_b") == k) / F.count("*")).alias(f"{prefix}_{k}") for k in range(first, n)])


def quantile_trim(df: DataFrame, by: Sequence[str], c: str, low: float = 0.001, high: float = 0.999) -> DataFrame:
    """Rows within two quantiles of their group."""
    return with_quantiles(df, by, c, [low, high], "_q").where(F.col(c).between(F.col("_q")[0], F.col("_q")[1])).drop("_q")


def reconcile(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows and all-null rows of a group, to compare stages."""
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_if(F.coalesce(*columns).isNull()).alias("n_all_null"))


def zonal_shares(df: DataFrame, by: Sequence[str], value: str, classes: dict[str, Column]) -> DataFrame:
    """Pixels of a zone that aren't 0, and the share of them in each class; zones without any are left out."""
    total = F.count_if(F.col(value) != 0)
    counted = df.groupBy(*by).agg(total.alias("total"), *[F.count_if(c).alias(f"_{n}") for n, c in classes.items()]).where("total > 0")
    return counted.select(*by, "total", *[(F.col(f"_{n}") / F.col("total")).alias(n) for n in classes])
