"""The flood recurrence over a stream of acquisitions, and what is known some days after planting."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def flood_stream(acquisitions: DataFrame, pixel: str, day: str, value: str, *, water: float, to_water: float, from_water: float) -> DataFrame:
    """A row for each acquisition of a pixel: pixel, day, flood.

    State is the last value and if the pixel is in flood; a batch's rows of a pixel are taken
    in order of day, and a row older than the state is passed over, as it can't change what
    has been put out.
    """
    kind = acquisitions.schema[pixel].dataType.simpleString()

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        on, last, at = state.get if state.exists else (False, None, None)
        out = []
        for d, x in sorted((r for pdf in rows for r in zip(pdf[day], pdf[value])), key=lambda r: r[0]):
            if at is not None and d <= at:
                continue
            x = None if x is None or x != x else float(x)
            fell = last - x if last is not None and x is not None else None
            on = x is not None and (on or fell is not None and fell >= to_water) and x <= water and not (fell is not None and fell <= from_water)
            last, at = x if x is not None else last, d
            out.append((key[0], d, bool(on)))
        if at is not None:
            state.update((on, last, at))
        yield pd.DataFrame(out, columns=[pixel, day, "flood"])

    return acquisitions.select(pixel, day, value).groupBy(pixel).applyInPandasWithState(step, f"{pixel} {kind}, {day} date, flood boolean", "flood boolean, last double, at date", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str, key: str, *, late: str = "1 day", width: str = "5 days") -> DataFrame:
    """Rows and sums by tumbling event-time window; late rows are taken up to the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def append_new(batch: DataFrame, path: str, key: list[str]) -> None:
    """For ``foreachBatch``: writes only keys that the table lacks, so a repeated batch changes nothing."""
    from ..sources.tables import write_missing

    write_missing(batch.dropDuplicates(key), path, key)


#: Days after planting at which a plot is judged.
HORIZONS = (40, 90, 120, 180)


def horizon_stream(acquisitions: DataFrame, key: str, planted: str, time: str, value: str, *, below: float, horizons: Sequence[int] = HORIZONS, late: str = "12 days") -> DataFrame:
    """(key, horizon, n, run) once a horizon is over: the acquisitions since planting and the longest run of them under a bound.

    Rows come in any order up to ``late`` behind the newest; older ones are dropped. State is the days seen and if each
    was low, no more than the last horizon has days. A timer on event time puts a horizon out when the watermark
    reaches it, with or without new rows of the key. Of two rows of a day the first stays; a null value isn't low and ends a run;
    rows before planting, after the last horizon or without a planting date change nothing.
    """
    kind, ends = acquisitions.schema[key].dataType.simpleString(), sorted(horizons)
    day_ms = 86_400_000

    def step(keys: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, days, low, done = state.get if state.exists else (None, [], [], 0)
        seen = dict(zip(days, low))
        if not state.hasTimedOut:
            for pdf in rows:
                for first, at, ms, x in zip(*[pdf[c] for c in ("_first", "_at", "_ms", value)]):
                    if not pd.isna(at) and 0 <= at < ends[-1] and ms >= state.getCurrentWatermarkMs():
                        start = int(first) if start is None else start
                        seen.setdefault(int(at), bool(not pd.isna(x) and x < below))
        if start is None:
            return
        out = []
        while done < len(ends) and state.getCurrentWatermarkMs() >= start + ends[done] * day_ms:
            until = [seen[d] for d in sorted(seen) if d < ends[done]]
            out.append((keys[0], ends[done], len(until), max((len(list(g)) for is_low, g in groupby(until) if is_low), default=0)))
            done += 1
        if done == len(ends):
            state.remove()
        else:
            state.update((start, sorted(seen), [seen[d] for d in sorted(seen)], done))
            state.setTimeoutTimestamp(start + ends[done] * day_ms)
        if out:
            yield pd.DataFrame(out, columns=[key, "horizon", "n", "run"])

    since = [F.unix_millis(F.col(planted).cast("timestamp")).alias("_first"), F.datediff(time, planted).alias("_at"), F.unix_millis(time).alias("_ms")]
    held = acquisitions.withWatermark(time, late).select(key, time, value, *since).groupBy(key)
    return held.applyInPandasWithState(step, f"{key} {kind}, horizon int, n int, run int", "start long, days array<int>, low array<boolean>, done int", "append", GroupStateTimeout.EventTimeTimeout)
