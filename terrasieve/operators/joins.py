"""Joins on time and place: as-of, interval, nearest, bucketed. Lookups are plain joins, whose side Spark broadcasts only below its size bound."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on equal keys where null equals null; the left's columns, then what only the right has. Without keys the right side is one row."""
    same = [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in on]
    met = left.alias("_l").join(right.alias("_r"), reduce(and_, same), how) if on else left.crossJoin(right)
    return met.select("_l.*", *[f"_r.{c}" for c in right.columns if c not in on]) if on else met


def _asof(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, value: str, forward: bool, width: int = 32) -> DataFrame:
    """Both sides in one order inside cells of ``width`` days of a key, the nearest right row carried along.

    The frame only ever grows, so a cell is one pass; a key of many rows is spread over its cells,
    and what the cells before hold is carried over as one row a cell, of which the calendar bounds the count.
    """
    cell = lambda c: F.floor(F.unix_date(F.col(c).cast("date")) / width)
    found = F.struct(F.col(right_on).alias("on"), F.col(value).alias("value"))
    known = right.where(F.col(right_on).isNotNull()).groupBy(*by, right_on).agg(F.min(value).alias(value)).select(*by, F.col(right_on).alias("_at"), cell(right_on).alias("_cell"), F.lit(1).alias("_side"), found.alias("_found"))
    asked = left.select(*by, F.col(left_on).alias("_at"), cell(left_on).alias("_cell"), F.lit(2).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"))
    order = lambda c: F.desc(c) if forward else F.asc(c)
    w = W.partitionBy(*by, "_cell").orderBy(order("_at"), "_side").rowsBetween(W.unboundedPreceding, 0)
    both = asked.unionByName(known, allowMissingColumns=True).withColumn("_picked", F.last("_found", ignorenulls=True).over(w)).where("_row is not null and _at is not null")
    far = F.min("_found") if forward else F.max("_found")  # of a cell, the one nearest to the cells beyond it
    held = known.groupBy(*by, "_cell").agg(far.alias("_far"))
    cells = held.unionByName(asked.where("_at is not null").select(*by, "_cell").distinct(), allowMissingColumns=True).groupBy(*by, "_cell").agg(F.max("_far").alias("_far"))
    over = W.partitionBy(*by).orderBy(order("_cell")).rowsBetween(W.unboundedPreceding, -1)
    carried = cells.select(*by, "_cell", F.last("_far", ignorenulls=True).over(over).alias("_carried")).where("_carried is not null")
    got = null_safe(both, carried, [*by, "_cell"], "left").select("_row.*", F.coalesce("_picked", "_carried").alias("_p"))
    without = left.where(F.col(left_on).isNull()).withColumn("_p", F.lit(None).cast(known.schema["_found"].dataType))
    return got.unionByName(without).select(*left.columns, F.col("_p.on").alias(f"asof_{right_on}"), F.col("_p.value").alias(f"asof_{value}"))


def asof_forward(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, value: str) -> DataFrame:
    """Each left row with the first right row on or after it; ties at the right take the least value; null without one."""
    return _asof(left, right, by, left_on, right_on, value, True)


def asof_backward(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, value: str) -> DataFrame:
    """Each left row with the last right row on or before it."""
    return _asof(left, right, by, left_on, right_on, value, False)


def interval_join(left: DataFrame, right: DataFrame, by: Sequence[str], day: str, first: str, last: str, width: int = 32) -> DataFrame:
    """Right rows whose ``day`` lies in [first, last] of the left row.

    Both sides also meet on the ``width``-day cells the interval touches, so a key with a long
    history is spread over many groups.
    """
    cell = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / width)
    a = left.where(F.col(first) <= F.col(last)).withColumn("_cell", F.explode(F.sequence(cell(F.col(first)), cell(F.col(last)))))
    b = right.withColumn("_cell", cell(F.col(day)))
    return a.join(b, [*by, "_cell"]).where(F.col(day).between(F.col(first), F.col(last))).drop("_cell")


def nearest(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, day: str, k: int = 4, reach: int | None = None, width: int = 32) -> DataFrame:
    """The k right rows nearest in days to each left row, at most ``reach`` days away if given; the earlier of ties. ``n`` numbers them in order of day.

    Each left row gives k rows; those beyond what is found are null. Of a key's day k rows count, so a
    cell of ``width`` days holds a bounded array. A left row meets that of its cell, the last k rows
    before and the first k after; these are carried over the key's cells, of which the calendar bounds the count.
    """
    others = [c for c in right.columns if c not in by and c != day]
    cell = lambda d: F.floor(F.datediff(F.col(d), F.lit("1970-01-01").cast("date")) / width)
    of_day = W.partitionBy(*by, day).orderBy(*others or [day])
    few = right.where(F.col(day).isNotNull()).withColumn("_k", F.row_number().over(of_day)).where(F.col("_k") <= k)
    held = few.groupBy(*by, cell(day).alias("_cell")).agg(F.array_sort(F.collect_list(F.struct(day, *others))).alias("_own"))
    w = W.partitionBy(*by).orderBy("_cell")
    some = lambda lo, hi: F.flatten(F.collect_list("_own").over(w.rowsBetween(lo, hi)))
    held = held.withColumn("_upto", some(1 - k, 0)).withColumn("_onward", F.slice(some(0, k - 1), 1, k))
    latest = F.array_sort(F.transform("_upto", lambda r: F.struct((-F.unix_date(r[day])).alias("ago"), r.alias("r"))))  # of a day the least rows first
    held = held.withColumn("_upto", F.transform(F.slice(latest, 1, k), lambda x: x["r"]))
    asked = left.select(*by, cell(at).alias("_cell")).distinct()
    cells = held.unionByName(asked, allowMissingColumns=True).groupBy(*by, "_cell").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("_own", "_upto", "_onward")])
    before = F.last("_upto", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.first("_onward", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    none = F.array().cast(cells.schema["_own"].dataType)
    cells = cells.select(*by, "_cell", F.concat(*[F.coalesce(x, none) for x in (before, F.col("_own"), after)]).alias("_r"))
    gap = lambda r: F.abs(F.datediff(r[day], F.col(at)))
    met = left.withColumn("_cell", cell(at)).join(cells, [*by, "_cell"], "left").withColumn("_r", F.when(F.col(at).isNotNull(), F.col("_r")))
    near = F.coalesce(F.col("_r") if reach is None else F.filter("_r", lambda r: gap(r) <= reach), none)
    ranked = F.array_sort(F.transform(near, lambda r: F.struct(gap(r).alias("gap"), r.alias("r"))))
    first = F.array_sort(F.transform(F.slice(ranked, 1, k), lambda x: x["r"]))
    padded = F.slice(F.concat(first, F.array_repeat(F.lit(None).cast(cells.schema["_r"].dataType.elementType), k)), 1, k)
    found = met.select(*left.columns, F.posexplode(padded).alias("n", "_x"))
    return found.select(*left.columns, (F.col("n") + 1).alias("n"), *[F.col(f"_x.{c}").alias(c) for c in (day, *others)])


def to_intervals(points: DataFrame, by: Sequence[str], day: str) -> DataFrame:
    """Half-open intervals (start, stop] between successive days of a key."""
    w = W.partitionBy(*by).orderBy(day)
    return points.select(*by, day).distinct().select(*by, F.col(day).alias("start"), F.lead(day).over(w).alias("stop")).where("stop is not null")


def day_bucket(day: Column | str, origin: str, width: int) -> Column:
    """Number of the ``width``-day bucket since an origin date."""
    return F.floor(F.datediff(F.col(day) if isinstance(day, str) else day, F.lit(origin).cast("date")) / width).cast("int")


def renumbered(df: DataFrame, bucket: str, name: str) -> DataFrame:
    """Buckets that occur, numbered without gaps from 0; the buckets alone are ordered, not the rows."""
    numbers = df.select(bucket).distinct().withColumn(name, (F.row_number().over(W.orderBy(bucket)) - 1).cast("int"))
    return df.join(numbers, bucket)


def best_source(df: DataFrame, key: Sequence[str], source: str) -> DataFrame:
    """The source with most rows of each key; the least of ties."""
    counts = df.groupBy(*key, source).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(source).alias("s")))
    return counts.groupBy(*key).agg(best.alias("b")).select(*key, F.col("b.s").alias(source), (-F.col("b.n")).alias("n"))


def shared_pixels(values: DataFrame, plots: DataFrame, on: Sequence[str] = ("row", "col")) -> DataFrame:
    """Each distinct pixel is read once, then goes back to all plots that share it."""
    return values.dropDuplicates(list(on)).join(plots, list(on))


def not_done(todo: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that have no output yet."""
    return todo.join(done.select(*on).distinct(), list(on), "left_anti")


def merged(frames: Sequence[DataFrame], on: Sequence[str], how: str = "inner") -> DataFrame:
    """Frames joined one after another on the columns they share."""
    return reduce(lambda a, b: a.join(b, list(on), how), frames)


def compared(a: DataFrame, b: DataFrame, on: Sequence[str], suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """A left join where every other column of a and b carries its suffix."""
    x, y = (df.select(*on, *[F.col(c).alias(c + s) for c in df.columns if c not in on]) for df, s in zip((a, b), suffixes))
    return x.join(y, list(on), "left")


def stacked(frames: Sequence[DataFrame]) -> DataFrame:
    """Frames one below the other by column name; what one lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def coded(df: DataFrame, names: Sequence[str], code: str) -> DataFrame:
    """Names numbered from 1 in order, joined back; only the distinct names are ordered, which a gazetteer bounds."""
    distinct = df.select(*names).distinct()
    return df.join(distinct.withColumn(code, F.row_number().over(W.orderBy(*names))), list(names))
