"""Kernels on series: ``array<double>`` with null gaps. Higher-order functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import col, power_to_db


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_null(ts: Column | str) -> Column:
    return F.size(F.filter(col(ts), lambda x: x.isNull()))


def interpolate(ts: Column | str) -> Column:
    """Linear between known neighbours, flat before the first and after the last; all null stays."""
    ts = col(ts)
    known = F.filter(F.transform(ts, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["x"].isNotNull())

    def fill(x: Column, i: Column, known: Column) -> Column:
        before = F.try_element_at(F.filter(known, lambda p: p["i"] < i), F.lit(-1))
        after = F.try_element_at(F.filter(known, lambda p: p["i"] > i), F.lit(1))
        between = before["x"] + (after["x"] - before["x"]) * (i - before["i"]) / (after["i"] - before["i"])
        return F.when(x.isNotNull(), x).otherwise(F.coalesce(between, before["x"], after["x"]))

    return let(known, lambda k: F.transform(ts, lambda x, i: fill(x, i, k)))


def clean_db(ts: Column | str, most_null: int = 10) -> Column:
    """Power to dB: non-positive to null, null where ``most_null`` or more gaps, filled, then 10 log10."""
    held = F.transform(col(ts), lambda x: F.when(x > 0, x))
    return let(held, lambda h: F.when(count_null(h) < most_null, F.transform(interpolate(h), lambda x: power_to_db(x))))


def diff(ts: Column | str, lag: int = 1) -> Column:
    """x[t] - x[t - lag], null at the start."""
    ts = col(ts)
    return F.transform(ts, lambda x, i: F.when(i >= lag, x - F.get(ts, i - lag)))


def arg_min(ts: Column | str) -> Column:
    """Index of the least value, the first of ties."""
    pairs = F.transform(col(ts), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.array_min(F.filter(pairs, lambda p: p["x"].isNotNull()))["i"]


def arg_max(ts: Column | str) -> Column:
    """Index of the greatest value, the first of ties."""
    pairs = F.transform(col(ts), lambda x, i: F.struct(x.alias("x"), (-i).alias("i")))
    return -F.array_max(F.filter(pairs, lambda p: p["x"].isNotNull()))["i"]


def series_sum(ts: Column | str) -> Column:
    return F.aggregate(col(ts), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def series_mean(ts: Column | str) -> Column:
    return F.try_divide(series_sum(ts), (F.size(col(ts)) - count_null(ts)).cast("double"))


def series_std(ts: Column | str) -> Column:
    """Sample standard deviation of what is known."""
    ts, n = col(ts), (F.size(col(ts)) - count_null(ts)).cast("double")
    squares = let(series_mean(ts), lambda m: series_sum(F.transform(ts, lambda x: (x - m) * (x - m))))
    return F.sqrt(F.try_divide(squares, F.nullif(n - 1, F.lit(0.0))))


def series_median(ts: Column | str) -> Column:
    known = F.array_sort(F.filter(col(ts), lambda x: x.isNotNull()))

    def middle(k: Column) -> Column:
        n = F.size(k)
        return F.when(n > 0, (F.get(k, F.floor((n - 1) / 2).cast("int")) + F.get(k, F.floor(n / 2).cast("int"))) / 2)

    return let(known, middle)


def longest_run(flags: Column | str) -> Column:
    """Length of the longest run of ones."""
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        now = F.when(x == 1, s["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"))

    return F.aggregate(col(flags), zero, step, lambda s: s["best"])


def relax(flags: Column | str) -> Column:
    """Single zeros between ones filled."""
    flags = col(flags)
    return F.transform(flags, lambda x, i: F.when((F.get(flags, i - 1) == 1) & (F.get(flags, i + 1) == 1) & (i > 0), 1).otherwise(x))


def under(ts: Column | str, threshold: Column | float) -> Column:
    """1 where below the threshold, else 0."""
    return F.transform(col(ts), lambda x: F.when(x < threshold, 1).otherwise(0))


def stretch(ts: Column | str, first: int, last: int) -> Column:
    """Periods first to last, both included, from 0."""
    return F.slice(col(ts), first + 1, last - first + 1)


def around(ts: Column | str, t: Column, before: int, after: int) -> Column:
    """Values from t - before to t + after, null beyond the ends."""
    ts = col(ts)
    return F.transform(F.sequence(F.lit(-before), F.lit(after)), lambda k: F.when(t + k >= 0, F.get(ts, t + k)))


def background(ts: Column | str, t: Column, back: int, gap: int = 2) -> Column:
    """Median of the periods from t - back to t - gap; null where there are none."""
    ts = col(ts)
    first = F.greatest(t - back, F.lit(0))
    return F.when(t - gap >= 0, series_median(F.slice(ts, first + 1, F.greatest(t - gap - first + 1, F.lit(0)))))


def under_median(ts: Column | str) -> Column:
    """The run below the median that holds the minimum: area, size, and if it touches an end."""
    ts = col(ts)
    index = F.transform(ts, lambda x, i: i)

    def run(k: Column) -> Column:
        start = F.coalesce(F.array_max(F.filter(index, lambda i: (i < k["at"]) & ~F.get(k["low"], i))) + 1, F.lit(0))
        end = F.coalesce(F.array_min(F.filter(index, lambda i: (i > k["at"]) & ~F.get(k["low"], i))) - 1, F.size(ts) - 1)
        return F.struct(start.alias("start"), F.when(F.get(k["low"], k["at"]), end - start + 1).otherwise(0).alias("size"), k["m"].alias("m"))

    def measured(r: Column) -> Column:
        area = F.aggregate(F.slice(ts, r["start"] + 1, r["size"]), F.lit(0.0), lambda s, x: s + (r["m"] - x))
        edge = (r["size"] > 0) & ((r["start"] == 0) | (r["start"] + r["size"] == F.size(ts)))
        return F.struct(area.alias("area"), r["size"].alias("size"), edge.alias("edge"))

    with_low = let(series_median(ts), lambda m: F.struct(m.alias("m"), arg_min(ts).alias("at"), F.transform(ts, lambda x: F.coalesce(x < m, F.lit(False))).alias("low")))
    return let(let(with_low, run), measured)


def flood_fold(ts: Column | str, water: float, to_water: float, from_water: float) -> Column:
    """flood = (flood or drop into water) and water now and no rise out of it, period by period.

    A period is water at or below ``water``; it enters where the value fell by
    ``to_water`` or more and leaves where it rose by ``-from_water`` or more.
    """
    ts = col(ts)
    state = F.struct(F.lit(False).alias("on"), F.array().cast("array<boolean>").alias("out"), F.lit(None).cast("double").alias("last"))

    def step(s: Column, x: Column) -> Column:
        fell = s["last"] - x
        on = F.coalesce((s["on"] | F.coalesce(fell >= to_water, F.lit(False))) & (x <= water) & ~F.coalesce(fell <= from_water, F.lit(False)), F.lit(False))
        return F.struct(on.alias("on"), F.array_append(s["out"], on).alias("out"), F.coalesce(x, s["last"]).alias("last"))

    return F.aggregate(ts, state, step, lambda s: s["out"])


def water_count(ts: Column | str, water: float, to_water: float, from_water: float) -> Column:
    """The counter form, strict: periods in flood so far, back to 0 when out of it."""
    state = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"), F.lit(None).cast("double").alias("last"))

    def step(s: Column, x: Column) -> Column:
        fell = s["last"] - x
        n = F.when(F.coalesce((x < water) & ~(fell < from_water) & ((s["n"] > 0) | (fell > to_water)), F.lit(False)), s["n"] + 1).otherwise(0)
        return F.struct(n.alias("n"), F.array_append(s["out"], n).alias("out"), F.coalesce(x, s["last"]).alias("last"))

    return F.aggregate(col(ts), state, step, lambda s: s["out"])


def suppress_pairs(ts: Column | str) -> Column:
    """Of neighbours t-1 and t, the greater where both are above 0, else 0; the first period is 0."""
    ts = col(ts)
    return F.transform(ts, lambda x, i: F.when((i > 0) & (x > 0) & (F.get(ts, i - 1) > 0), F.greatest(x, F.get(ts, i - 1))).otherwise(F.lit(0).cast("double")))


def windows(ts: Column | str, size: int) -> Column:
    """All stretches of ``size`` neighbouring periods."""
    ts = col(ts)
    return F.when(F.size(ts) >= size, F.transform(F.sequence(F.lit(1), F.size(ts) - size + 1), lambda i: F.slice(ts, i, size))).otherwise(F.array().cast("array<array<double>>"))


def halves(ts: Column | str) -> Column:
    """Least, greatest and mean of the first and the second half."""
    ts = col(ts)
    half = F.floor(F.size(ts) / 2).cast("int")
    a, b = F.slice(ts, F.lit(1), half), F.slice(ts, half + 1, F.size(ts) - half)
    return F.struct(*[f(x).alias(f"{n}_{k}") for k, x in (("first", a), ("second", b)) for n, f in (("min", F.array_min), ("max", F.array_max), ("mean", series_mean))])


def stitch_max(a: Column | str, b: Column | str, overlap: int) -> Column:
    """Two series, the last ``overlap`` periods of a over the first of b; the greater counts."""
    a, b = col(a), col(b)
    n = F.size(a) - overlap
    shared = F.zip_with(F.slice(a, n + 1, overlap), F.slice(b, F.lit(1), F.lit(overlap)), lambda x, y: F.greatest(x, y))
    return F.concat(F.slice(a, F.lit(1), n), shared, F.slice(b, F.lit(overlap + 1), F.size(b)))


def lowest(ts: Column | str, k: int) -> Column:
    """Indexes of the k least values, least first; the earlier of ties."""
    pairs = F.transform(col(ts), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(F.filter(pairs, lambda p: p["x"].isNotNull())), 1, k), lambda p: p["i"])


def agreed_day(a: Column | str, b: Column | str, k: int) -> Column:
    """The period lowest in a that is among the k lowest of both series; null where they share none."""
    return F.get(F.array_intersect(lowest(a, k), lowest(b, k)), F.lit(0))


def sum_under_median(ts: Column | str) -> Column:
    """Sum of what values lie below their median, wherever they are."""
    return let(series_median(ts), lambda m: series_sum(F.transform(col(ts), lambda x: F.greatest(m - x, F.lit(0.0)))))


def above(ts: Column | str, threshold: Column | float) -> Column:
    """1 where above the threshold, else 0."""
    return F.transform(col(ts), lambda x: F.when(x > threshold, 1).otherwise(0))
