"""Streams against batches: horizons by event-time timers with rows out of order, and windows with late rows."""

from __future__ import annotations

import datetime as dt
import random
from itertools import groupby

from terrasieve.streaming import flood

START = dt.date(2024, 1, 1)


def replay(spark, batches, schema, tmp_path, make):
    """The rows that a stream over the batches, one file each, gives."""
    source, kept = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(source)
    query = make(stream).writeStream.format("parquet").option("path", kept).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(kept).collect()


def brute(rows, horizons, below):
    out = {}
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key and r[1] is not None]
        if not mine:
            continue
        seen = {}
        for _, p, t, x in mine:
            seen.setdefault((t.date() - p).days, x is not None and x < below)
        for h in horizons:
            until = [seen[d] for d in sorted(seen) if 0 <= d < h]
            if any(0 <= d < max(horizons) for d in seen):
                out[key, h] = (len(until), max((len(list(g)) for low, g in groupby(until) if low), default=0))
    return out


def test_horizons_equal_batch_with_rows_out_of_order(spark, tmp_path):
    r = random.Random(12)
    rows = []
    for key in range(12):
        planted = START + dt.timedelta(days=key * 3)
        for d in range(-12, 200, 6):
            rows.append((key, planted, dt.datetime.combine(planted + dt.timedelta(days=d), dt.time(5)), r.choice([-20.0, -18.0, -16.0, -10.0, None])))
    rows.append((50, None, dt.datetime(2024, 1, 5), -20.0))
    order = sorted(rows, key=lambda x: (x[2] + dt.timedelta(days=r.uniform(-5, 5))))  # up to ten days out of order
    batches = [order[i : i + 60] for i in range(0, len(order), 60)] + [[(99, dt.date(2030, 1, 1), dt.datetime(2030, 1, 1), 0.0)]]
    schema = "k int, p date, t timestamp, x double"
    got = replay(spark, batches, schema, tmp_path, lambda s: flood.horizon_stream(s, "k", "p", "t", "x", below=-14.0))
    found = {(q.k, q.horizon): (q.n, q.run) for q in got if q.k != 99}
    assert len(found) == len([q for q in got if q.k != 99]) == 48 and found == brute(rows, flood.HORIZONS, -14.0)


def test_rows_behind_the_watermark_change_nothing(spark, tmp_path):
    at = lambda d: dt.datetime.combine(START + dt.timedelta(days=d), dt.time())
    batches = [[(1, START, at(d), -20.0) for d in (0, 6, 12)], [(1, START, at(60), -20.0)], [(1, START, at(18), -20.0), (1, START, at(54), -20.0)], [(1, START, at(400), 0.0)]]
    got = replay(spark, batches, "k int, p date, t timestamp, x double", tmp_path, lambda s: flood.horizon_stream(s, "k", "p", "t", "x", below=-14.0, horizons=(40, 90)))
    assert {(q.horizon, q.n, q.run) for q in got} == {(40, 3, 3), (90, 5, 5)}


def test_windows_take_late_rows_up_to_the_watermark(spark, tmp_path):
    at = lambda d: dt.datetime.combine(START + dt.timedelta(days=d), dt.time(1))
    batches = [[("a", at(1), 1.0), ("a", at(6), 2.0)], [("a", at(5.2), 4.0), ("b", at(12), 1.0)], [("a", at(0), 99.0), ("a", at(11.5), 3.0)], [("z", at(400), 0.0)]]
    rows = [(k, t, v) for b in batches for k, t, v in b]
    got = replay(spark, batches, "k string, t timestamp, value double", tmp_path, lambda s: flood.windowed_counts(s, "t", "k"))
    late = [x for x in rows if x[2] != 99.0 and x[0] != "z"]
    want = {(r.start, r.k): (r.n, r.total) for r in flood.windowed_counts(spark.createDataFrame(late, "k string, t timestamp, value double"), "t", "k").collect()}
    assert {(q.start, q.k): (q.n, q.total) for q in got if q.k != "z"} == want
