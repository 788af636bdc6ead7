"""Series of plots and pixels: completion, re-basing, drops, runs under thresholds, floods.

A long table (key, period, value) becomes one array a key, with null for what is missing;
everything after that works inside the row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import series as S
from ..functions.exprs import digitize
from .aggregates import stat_pack

#: First and last period of the growth stages, by cadence.
STAGES = {
    "6-day": {"stage1": (0, 6), "stage2": (7, 14), "stage3": (15, 19), "stage4": (20, 29)},
    "12-day": {"stage1": (0, 3), "stage2": (4, 7), "stage3": (8, 9), "stage4": (10, 14)},
}


def grid_complete(df: DataFrame, key: Sequence[str], period: str, value: str, periods: int, fill: float | None = None) -> DataFrame:
    """A row for each key and period 0 to periods - 1; no join: the periods come from the series itself."""
    s = to_series(df, key, period, value, periods, fill)
    return s.select(*key, F.posexplode("ts").alias(period, value))


def to_series(df: DataFrame, key: Sequence[str], period: str, value: str, periods: int, fill: float | None = None) -> DataFrame:
    """One array of ``periods`` values a key; the mean where a period has several rows."""
    inside = df.where(F.col(period).between(0, periods - 1)).groupBy(*key, period).agg(F.avg(value).alias("_v"))
    held = inside.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(F.col(period), F.col("_v")))).alias("_m"))
    at = lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(fill).cast("double"))
    return held.select(*key, F.transform(F.sequence(F.lit(0), F.lit(periods - 1)), at).alias("ts"))


def rebase(df: DataFrame, ts: str, first_day: str, day: str, cycle: int, n: int, *, forward: bool = True) -> DataFrame:
    """The n periods from the first on or after (else: on or before) a day; rows without all n periods are dropped."""
    at = F.datediff(F.col(day), F.col(first_day)) / cycle
    start = (F.ceil(at) if forward else F.floor(at)).cast("int")
    return df.where((start >= 0) & (start + n <= F.size(ts))).withColumn(ts, F.slice(F.col(ts), start + 1, n))


def _least_cell(df: DataFrame, by: Sequence[str], ts: str, first: int, last: int, lags: Sequence[int], score: Callable[[Column, Column], Column]) -> DataFrame:
    """Of all rows of a group: lag and period with the least score of (x[t], x[t - lag]). Each row gives its own least first."""

    def cells(lag: int) -> Column:
        cell = lambda t: F.struct(score(F.get(ts, t), F.get(ts, t - lag)).alias("coef"), F.lit(lag).alias("lag"), t.alias("t"))
        return F.transform(F.sequence(F.lit(max(first, lag)), F.lit(last)), cell)

    every = F.concat(*[cells(lag) for lag in lags if max(first, lag) <= last])
    own = df.select(*by, F.array_min(F.filter(every, lambda s: s["coef"].isNotNull())).alias("_s"))
    return own.groupBy(*by).agg(F.min("_s").alias("s")).select(*by, "s.coef", "s.lag", "s.t")


def sharp_drop(df: DataFrame, by: Sequence[str], ts: str, first: int, last: int, lags: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Of all pixels of a group: lag p and period t in [first, last] with the least x[t] - x[t - p] + x[t]; the smallest lag wins ties, then the earliest period."""
    return _least_cell(df, by, ts, first, last, lags, lambda x, y: 2 * x - y)


def sharp_drop_product(df: DataFrame, by: Sequence[str], ts: str, first: int, last: int, lags: Sequence[int] = (1, 2)) -> DataFrame:
    """The greatest (x[t] - x[t - p]) * x[t], same ties."""
    return _least_cell(df, by, ts, first, last, lags, lambda x, y: -(x - y) * x).withColumn("coef", -F.col("coef"))


def drop_rise(df: DataFrame, ts: str, lags: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """For each lag the least difference of a row, its period, and the greatest rise after it."""
    out = df
    for p in lags:
        d = S.diff(ts, p)
        out = out.withColumn(f"drop_{p}", F.array_min(d)).withColumn(f"drop_t_{p}", S.arg_min(d))
        out = out.withColumn(f"rise_{p}", F.array_max(F.slice(S.diff(ts, p), F.col(f"drop_t_{p}") + 2, F.size(ts))))
    return out


def run_features(df: DataFrame, by: Sequence[str], ts: str, thresholds: Mapping[str, float], edges: Sequence[float], first: int = 0, last: int | None = None) -> DataFrame:
    """Percent of a group's pixels by length of their longest run under each threshold, strict and with single gaps filled."""
    part = S.stretch(ts, first, last) if last is not None else F.slice(F.col(ts), first + 1, F.size(ts))
    runs = {f"{name}_{mode}": S.longest_run(f(S.under(part, v))) for name, v in thresholds.items() for mode, f in (("strict", lambda x: x), ("relax", S.relax))}
    measured = df.select(*by, *[r.alias(name) for name, r in runs.items()])  # each run once, then binned
    binned = measured.select(*by, *[digitize(name, edges).alias(name) for name in runs])
    shares = [(100 * F.count_if(F.col(name) == k) / F.count("*")).alias(f"{name}_b{k}") for name in runs for k in range(1, len(edges) + 1)]
    return binned.groupBy(*by).agg(*shares)


def horizons(df: DataFrame, by: Sequence[str], ts: str, periods: Mapping[int, int], threshold: float, edges: Sequence[float]) -> DataFrame:
    """What is known some days after planting: shares by longest run over the first periods of each horizon (days to periods)."""
    table = F.array(*[F.struct(F.lit(d).alias("horizon"), F.lit(n).alias("n")) for d, n in periods.items()])
    each = df.select(*by, ts, F.inline(table))
    run = S.longest_run(S.under(F.slice(F.col(ts), F.lit(1), F.col("n")), threshold))
    return each.withColumn("_r", run).withColumn("_b", digitize("_r", edges)).groupBy(*by, "horizon").agg(F.count("*").alias("n_rows"), *[(100 * F.count_if(F.col("_b") == k) / F.count("*")).alias(f"run_b{k}") for k in range(len(edges) + 1)])


def min_composite(df: DataFrame, pixel: Sequence[str], day: str, bands: Sequence[str], shadow: Column) -> DataFrame:
    """Each pixel's bands of the image where all of them fell below the ones held, images in order; shadowed pixels start at 1."""
    start = F.struct(*[F.lit(1.0).alias(b) for b in bands], F.lit(None).cast("date").alias(day))
    seen = df.where(~shadow).select(*pixel, F.struct(F.col(day), *[F.col(b).cast("double").alias(b) for b in bands]).alias("s"))
    held = seen.groupBy(*pixel).agg(F.array_sort(F.collect_list("s")).alias("_s"))

    def step(a: Column, x: Column) -> Column:
        lower = a[bands[0]] > x[bands[0]]
        for b in bands[1:]:
            lower = lower & (a[b] > x[b])
        return F.when(lower, F.struct(*[x[b].alias(b) for b in bands], x[day].alias(day))).otherwise(a)

    return held.withColumn("c", F.aggregate("_s", start, step)).select(*pixel, *[F.col(f"c.{b}").alias(b) for b in bands], F.col(f"c.{day}").alias(day))


def any_flood_near(reports: DataFrame, maps: DataFrame, key: Sequence[str], at: str, day: str, flag: str, days: int) -> DataFrame:
    """Share of a plot's pixels with any flood within some days of a report (at)."""
    from .joins import interval_join

    bounded = reports.withColumn("_lo", F.date_sub(at, days)).withColumn("_hi", F.date_add(at, days))
    pairs = interval_join(bounded, maps, key, day, "_lo", "_hi")
    return pairs.groupBy(*reports.columns).agg(F.max(F.col(flag).cast("int")).alias("any_flood"))


def stitched(df: DataFrame, key: Sequence[str], day: str, value: str) -> DataFrame:
    """Series of overlapping seasons as one: the greater value of a day."""
    return df.groupBy(*key, day).agg(F.max(value).alias(value))


def missing_days(df: DataFrame, key: Sequence[str], day: str, cycle: int) -> DataFrame:
    """Days of the ideal cycle, from the first to the last of a key, that have no row."""
    ideal = df.groupBy(*key).agg(F.min(day).alias("_a"), F.max(day).alias("_b")).select(*key, F.explode(F.expr(f"sequence(_a, _b, interval {cycle} day)")).alias(day))
    return ideal.join(df.select(*key, day).distinct(), [*key, day], "left_anti")


def band_numbers(df: DataFrame, by: Sequence[str], day: str, present: Column) -> DataFrame:
    """Band number of each available day: the count of available days up to it."""
    w = W.partitionBy(*by).orderBy(day).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("band", F.when(present, F.sum(present.cast("int")).over(w)))


def by_day_index(df: DataFrame, key: Sequence[str], day: str, plant: str, value: str, step: int, n: int) -> DataFrame:
    """Series by days since planting: index = half-even (days - d0 % step) / step, where d0 is the key's first offset."""
    since = F.datediff(F.col(day), F.col(plant))
    first = df.withColumn("_d", since).where(F.col("_d") >= 0)
    offset = first.groupBy(*key).agg((F.min("_d") % step).alias("_o"))
    placed = first.join(offset, list(key)).withColumn("_i", F.bround((F.col("_d") - F.col("_o")) / step).cast("int"))
    return to_series(placed, key, "_i", value, n)


def window_at(series: DataFrame, anchors: DataFrame, key: Sequence[str], t: str, ts: str = "ts", before: int = 2, after: int = 1, fill: float = 0.0) -> DataFrame:
    """Values of a second series from ``before`` periods before an anchor to ``after`` behind it; what is missing is ``fill``."""
    joined = anchors.join(series, list(key), "left")
    held = F.coalesce(S.around(ts, F.col(t), before, after), F.array_repeat(F.lit(None).cast("double"), before + after + 1))
    return joined.withColumn("window", F.transform(held, lambda x: F.coalesce(x, F.lit(fill)))).drop(ts)


def merged_runs(df: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Runs under the median (area, size, edge) of successive stages: one that touches the end of its stage takes in the next
    stage's that touches its begin, stage by stage in order."""
    out = df
    for a, b in zip(stages, stages[1:]):
        join = F.col(f"{a}.edge") & F.col(f"{b}.edge")
        whole = F.struct((F.col(f"{a}.area") + F.col(f"{b}.area")).alias("area"), (F.col(f"{a}.size") + F.col(f"{b}.size")).alias("size"), F.col(f"{b}.edge").alias("edge"))
        out = out.withColumn("_m", F.when(join, whole)).withColumn(a, F.coalesce("_m", a)).withColumn(b, F.coalesce("_m", b)).drop("_m")
    return out


def rolled_up(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Pixels to plots: min, max, mean, quartiles of each column, the quartiles selected by counts."""
    packed = stat_pack(df, by, columns, quantiles=(0.25, 0.5, 0.75), drop_null=False)
    return packed.drop(*[f"{c}_ratio" for c in columns])


def event_curve(df: DataFrame, by: Sequence[str], ts: str, t: str, reach: int) -> DataFrame:
    """Mean value at each distance from the event, and its change from the distance before."""
    each = df.select(*by, F.posexplode(S.around(ts, F.col(t), reach, reach)).alias("_p", "_v")).select(*by, (F.col("_p") - reach).alias("distance"), "_v")
    mean = each.groupBy(*by, "distance").agg(F.avg("_v").alias("mean"))
    return mean.withColumn("change", F.col("mean") - F.lag("mean").over(W.partitionBy(*by).orderBy("distance")))


def two_satellites(first: str | Column, last: str | Column, cycle: int = 12) -> Column:
    """Days of two alternating satellites: (day, satellite) every half cycle."""
    first, last = (F.lit(x).cast("date") if isinstance(x, str) else x for x in (first, last))
    days = F.sequence(first, last, F.expr(f"interval {cycle // 2} day"))
    return F.transform(days, lambda d, i: F.struct(d.alias("day"), F.when(i % 2 == 0, "A").otherwise("B").alias("satellite")))


def ideal_days(df: DataFrame, key: Sequence[str], day: str, cycle: int, back: int = 20, ahead: int = 20) -> DataFrame:
    """The days of a cycle from ``back`` cycles before a key's first day to ``ahead`` cycles after its last."""
    ends = df.groupBy(*key).agg(F.date_sub(F.min(day), cycle * back).alias("_a"), F.date_add(F.max(day), cycle * ahead).alias("_b"))
    return ends.select(*key, F.explode(F.expr(f"sequence(_a, _b, interval {cycle} day)")).alias(day))


def band_window(ideal: DataFrame, actual: DataFrame, key: Sequence[str], day: str, first: str, last: str) -> DataFrame:
    """Ideal days inside a window with the number of the band acquired on each, null where there is none."""
    bands = actual.withColumn("band", F.row_number().over(W.partitionBy(*key).orderBy(day)))
    inside = ideal.where(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return inside.join(bands.select(*key, day, "band"), [*key, day], "left")


def stage_drops(df: DataFrame, ts: str, stages: Mapping[str, tuple[int, int]], *, with_first: bool = True, before: int = 1, after: int = 5) -> DataFrame:
    """Least one-period difference of each stage (the first of a stage is against the stage before), which stage has the least, its period, and the values around it.

    Without the first stage, ``period`` and ``at`` look at the others alone, and ``at`` not at the step into them.
    """
    (start, _), names = next(iter(stages.values())), list(stages)
    end = max(b for _, b in stages.values())
    d = df.withColumn("_d", S.diff(F.slice(F.col(ts), F.lit(1), F.lit(end + 1))))
    for n, (a, b) in stages.items():
        d = d.withColumn(n, F.array_min(S.stretch("_d", max(a, start + 1), b)))
    used = names if with_first else names[1:]
    least = F.least(*[F.col(n) for n in used]) if len(used) > 1 else F.col(used[0])
    period = F
    for n in used:
        period = period.when(F.col(n) == least, names.index(n) + 1)
    first = start + 1 if with_first else stages[names[1]][0] + 1
    held = d.withColumn("period", period).withColumn("sharpest", least).withColumn("at", S.arg_min(F.transform("_d", lambda x, i: F.when(i >= first, x))))
    return held.withColumn("window", S.around(ts, F.col("at"), before, after)).drop("_d")


def between_periods(ts: Column | str, first: Column, last: Column) -> Column:
    """Periods first to last, cut at both ends of the series."""
    a, b = F.greatest(first, F.lit(0)), F.least(last, F.size(ts) - 1)
    return F.slice(ts, a + 1, F.greatest(b - a + 1, F.lit(0)))


def run_shares(df: DataFrame, by: Sequence[str], flags: str, edges: Sequence[int]) -> DataFrame:
    """Rows of a group and the shares of them by length of their longest run of flags, strict and with single gaps filled."""
    modes = {"strict": S.longest_run(flags), "relax": S.longest_run(S.relax(flags))}
    binned = df.select(*by, *[r.alias(m) for m, r in modes.items()]).select(*by, *[digitize(m, edges).alias(m) for m in modes])
    shares = [(F.count_if(F.col(m) == k) / F.count("*")).alias(f"{m}_{k}") for m in modes for k in range(len(edges) + 1)]
    return binned.groupBy(*by).agg(F.count("*").alias("n"), *shares)


def image_window(plant: str, cycle: int, images: int, before: int) -> tuple[Column, Column]:
    """First and last day of a window of images, ``before`` of them before planting."""
    return F.date_sub(plant, cycle * before), F.date_add(plant, cycle * (images - before - 1))


def dual_era(df: DataFrame, by: Sequence[str], day: str, second: Column, days: int = 6) -> DataFrame:
    """Rows since some days before the second satellite's first, with that ``start``."""
    first = df.where(second).groupBy(*by).agg(F.date_sub(F.min(day), days).alias("start"))
    return df.join(first, list(by)).where(F.col(day) >= F.col("start"))


def percentile_runs(pct: Column, under: Sequence[float], above: Sequence[float]) -> dict[str, Column]:
    """Longest runs of percentiles under and above each bound, strict and with single gaps filled, by name."""
    flags = {**{f"u{v}": S.under(pct, v) for v in under}, **{f"a{v}": S.above(pct, v) for v in above}}
    return {f"{n}_{m}": S.longest_run(g(f)) for n, f in flags.items() for m, g in (("strict", lambda x: x), ("relax", S.relax))}
