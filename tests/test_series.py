"""Kernels on fixed values."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasieve.functions import exprs as X
from terrasieve.functions import series as S


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def array(*x, kind="double"):
    return F.array(*[F.lit(v).cast(kind) for v in x])


@pytest.mark.parametrize(
    "make,want",
    [
        (lambda: S.interpolate(array(None, 1, None, 3, None)), [1, 1, 2, 3, 3]),
        (lambda: S.interpolate(array(None, None)), [None, None]),
        (lambda: F.round(X.power_to_db(F.lit(0.05)), 4), -13.0103),
        (lambda: X.power_to_db(F.lit(0.0)), None),
        (lambda: X.positive(F.lit(-1)), None),
        (lambda: S.longest_run(array(1, 1, 0, 1, 1, 1, 0, kind="int")), 3),
        (lambda: S.relax(array(1, 0, 1, 0, 0, 1, kind="int")), [1, 1, 1, 0, 0, 1]),
        (lambda: S.longest_run(S.relax(array(1, 0, 1, 0, 0, 1, kind="int"))), 3),
        (lambda: F.transform(array(0, 1, 2, 3, 9), lambda x: X.digitize(x, (1, 2, 3))), [0, 1, 2, 3, 3]),
        (lambda: F.transform(array(0, 0.25, 0.26, 1), lambda x: X.loss_class(x)), [0, 1, 2, 4]),
        (lambda: S.flood_fold(array(0.3, 0.1, 0.1, 0.4), 0.2, 0.15, -0.1), [False, True, True, False]),
        (lambda: S.suppress_pairs(array(0, 2, 3, 0, 1)), [0, 0, 3, 0, 0]),
        (lambda: X.bit_field(F.lit(2800), 5, 2), 3),
        (lambda: X.normalized_difference(F.lit(0), F.lit(0)), 0),
        (lambda: X.safe_ratio(F.lit(0), F.lit(0)), 0),
        (lambda: X.safe_ratio(F.lit(None), F.lit(5)), 0),
        (lambda: X.safe_ratio(F.lit(2), F.lit(0)), None),
        (lambda: S.background(array(0, 2, 3, 0, 1, 9), F.lit(5), 10), 1.0),
        (lambda: S.background(array(0, 2, 3), F.lit(1), 10), None),
        (lambda: S.series_median(array(3, None, 1)), 2),
        (lambda: S.arg_min(array(3, None, 1, 1)), 2),
        (lambda: S.arg_max(array(3, None, 1, 3)), 0),
        (lambda: S.diff(array(3, 5, None, 1), 1), [None, 2, None, None]),
        (lambda: S.around(array(1, 2, 3), F.lit(0), 1, 3), [None, 1, 2, 3, None]),
        (lambda: S.count_null(array(1, None, None)), 2),
        (lambda: S.clean_db(array(*[0] * 10, 1)), None),
        (lambda: S.stitch_max(array(1, 2, 3), array(9, 0, 4), 2), [1, 9, 3, 4]),
        (lambda: S.lowest(array(3, None, 1, 1), 2), [2, 3]),
        (lambda: S.agreed_day(array(3, 0, 1, 5), array(9, 8, 2, 1), 2), 2),
        (lambda: S.agreed_day(array(0, 1), array(1, 0), 1), None),
        (lambda: X.finite(F.lit(float("inf"))), None),
        (lambda: X.finite(F.lit(float("nan"))), None),
        (lambda: X.outcome(F.lit(True), F.lit(False)), "FP"),
        (lambda: X.period_name(F.lit("2024-01-20").cast("date"), F.lit("2024-01-01").cast("date"), 6), "t3"),
        (lambda: X.recode(F.lit(None).cast("string"), {"a": ["x"]}, "other", "none"), "none"),
        (lambda: X.lookup(F.lit("z"), {"a": 1}), None),
        (lambda: X.weighted_shares(array(1, 2), array(0.5, 0.25)), 1.0),
        (lambda: X.clip(F.lit(7), 0, 1), 1),
    ],
)
def test_fixed_values(spark, make, want):
    got = value(spark, make())
    assert got == want or got is None and want is None


def test_interpolation_equals_numpy(spark):
    r = random.Random(1)
    rows = [(i, [None if r.random() < 0.4 else float(r.randint(0, 50)) for _ in range(r.randint(1, 20))]) for i in range(80)]
    df = spark.createDataFrame(rows, "k int, ts array<double>")
    for k, ts, x in df.select("k", "ts", S.interpolate("ts")).collect():
        known = [i for i, v in enumerate(ts) if v is not None]
        want = np.interp(range(len(ts)), known, [ts[i] for i in known]) if known else [None] * len(ts)
        assert x == pytest.approx(list(want)) if known else x == list(want)


def test_runs_equal_brute_force(spark):
    r = random.Random(2)
    rows = [(i, r.choices((0, 1), k=r.randint(1, 25))) for i in range(100)]
    for _, f, run, filled in spark.createDataFrame(rows, "k int, f array<int>").select("k", "f", S.longest_run("f"), S.relax("f")).collect():
        assert run == max(map(len, "".join(map(str, f)).split("0")))
        assert filled == [1 if 0 < i < len(f) - 1 and f[i - 1] == f[i + 1] == 1 else x for i, x in enumerate(f)]
