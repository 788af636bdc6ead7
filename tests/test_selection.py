"""Quantiles selected by counts against numpy: one group of all rows, ties, signs, tiny and huge values, nulls and groups without values."""

from __future__ import annotations

import numpy as np
import pytest


from terrasieve.operators import aggregates as A
from terrasieve.operators import raster as R
from terrasieve.operators import timeseries as T
from terrasieve.plans import catalogue

Q = (0.0, 0.05, 0.25, 0.5, 0.9, 1.0)


def quantiles(spark, rows):
    df = spark.createDataFrame(rows, "g string, x double")
    return {r.g: r.q for r in A.exact_quantiles(df, ["g"], "x", Q).collect()}


def test_quantiles_equal_numpy(spark):
    r = np.random.default_rng(4)
    groups = {
        "hot": np.concatenate([r.normal(0, 1, 30_000), np.zeros(9000), np.full(9000, 1.5)]),
        "near": 1 + r.integers(0, 1 << 20, 5000) * 2.0**-52,
        "wide": r.normal(0, 1, 400) * 10.0 ** r.integers(-300, 300, 400),
        "tiny": np.array([5e-324, -5e-324, 1e-310, 0.0, -0.0, 2.2250738585072014e-308]),
        "powers": np.array([2.0**i for i in range(-30, 31)] + [np.nextafter(2.0**i, 0) for i in range(-30, 31)]),
        "one": np.array([7.0]),
        None: np.array([1.0, 2.0]),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("hot", None), ("empty", None)]
    found = quantiles(spark, rows)
    assert set(found) == set(groups)
    for g, xs in groups.items():
        assert found[g] == pytest.approx(np.quantile(xs, Q).tolist(), rel=1e-12, abs=1e-320), g


def test_infinite_values_and_nan_come_last(spark):
    found = quantiles(spark, [("a", x) for x in (float("nan"), float("inf"), 1.0, -float("inf"), 2.0)])
    assert found["a"][0] == -float("inf") and found["a"][3] == 2.0 and np.isnan(found["a"][5])


def test_statistics_of_many_columns_equal_those_of_each(spark):
    r = np.random.default_rng(5)
    names = [f"c{i}" for i in range(40)]
    rows = [(int(i % 3), *[None if r.random() < 0.1 else float(r.integers(-3, 4)) for _ in names]) for i in range(300)] + [(9, *[None] * 40)]
    df = spark.createDataFrame(rows, "g int, " + ", ".join(f"{c} double" for c in names))
    found = {(x.g, x.column): x for x in A.column_stats(df, ["g"], names, quantiles=(0.5, 0.95)).collect()}
    assert len(found) == 4 * 40 and found[9, "c0"]["p50"] is None and found[9, "c0"]["ratio"] == 0
    for g in range(3):
        for i, c in enumerate(names, 1):
            every = [x[i] for x in rows if x[0] == g]
            known, x = [v for v in every if v is not None], found[g, c]
            assert [x["min"], x["max"], x["p50"], x["p95"]] == pytest.approx([min(known), max(known), np.quantile(known, 0.5), np.quantile(known, 0.95)])
            assert x["ratio"] == pytest.approx(sum(v == 1 for v in known) / len(every)) and x["mean"] == pytest.approx(np.mean(known))
    wide = A.stat_pack(df, ["g"], names, quantiles=(0.5,))
    assert wide.columns[:6] == ["g", "c0_min", "c0_max", "c0_mean", "c0_p50", "c0_ratio"] and wide.count() == 3


def test_density_of_nothing_and_of_one_value_is_null(spark):
    for rows in ([], [(None,)], [(2.0,)], [(2.0,)] * 5):
        got = A.kde(spark.createDataFrame(rows, "x double"), "x", 0.0, 4.0, 5).orderBy("i").collect()
        assert [(r.i, r.density, r.x) for r in got] == [(i, None, float(i)) for i in range(5)]


def test_rows_within_quantiles_need_no_buffer_of_a_group(spark):
    r = np.random.default_rng(6)
    rows = [("a", float(x)) for x in r.normal(0, 1, 5000)] + [("b", 1.0)] * 50 + [("c", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    trimmed, shaded, rolled = A.quantile_trim(df, ["g"], "x", 0.1, 0.9), R.stretched(df, ["g"], "x", "shade"), T.rolled_up(df, ["g"], ["x"])
    for d in (trimmed, shaded, rolled):
        assert "percentile(" not in d._jdf.queryExecution().optimizedPlan().toString()
    a = np.array([x for g, x in rows if g == "a"])
    low, high = np.quantile(a, [0.1, 0.9])
    assert sorted(x.x for x in trimmed.where("g = 'a'").collect()) == sorted(a[(a >= low) & (a <= high)].tolist())
    assert trimmed.where("g = 'b'").count() == 50 and trimmed.where("g is null or g = 'c'").count() == 0
    assert shaded.count() == 5051 and shaded.where("g = 'a' and shade = 255").count() == 100
    found = {x.g: x for x in rolled.collect()}
    assert found["c"].x_p50 is None and found[None].x_max == 3.0 and found["a"].x_p75 == pytest.approx(np.quantile(a, 0.75))
    with_parts = A.with_quantiles(df, ["g"], "x", [0.5], "q").selectExpr("g", "q[0]").distinct()
    assert with_parts.count() == 3


@pytest.mark.parametrize(("groups", "gathered", "most"), [(3, 1 << 23, 1 << 23), (3, 900, 1 << 23), (3, 900, 50), (400, 1 << 23, 1 << 23), (0, 900, 1 << 23)])
def test_tasks_count_what_they_have(groups, gathered, most):
    """Values, nulls and NaNs of each column, whatever is gathered or passed on at once; a large group gives one row a distinct value."""
    from collections import Counter

    import pyarrow as pa

    from terrasieve.operators.counting import counted

    r = np.random.default_rng(6)
    x = [[None if v == 0 else float("nan") if v == 1 else float(v) for v in r.integers(0, 12, 1200)] for _ in range(2)]
    g = [None if v == 0 else f"g{v}" for v in r.integers(0, max(groups, 1), 1200)]
    keys = {"g": pa.array(g, pa.string())} if groups else {}
    t = pa.table({**keys, **{f"_x{i}": pa.array(v, pa.float64(), from_pandas=False) for i, v in enumerate(x)}})
    rows = pa.Table.from_batches(counted(iter(t.to_batches(max_chunksize=100)), list(keys), gathered, most)).to_pylist()
    found = Counter()
    for y in rows:
        found[y.get("g"), y["_c"], str(y["_v"])] += y["_n"]
    assert found == Counter((k if groups else None, c, str(v)) for c in range(2) for k, v in zip(g, x[c]))
    if groups < 400 and most > 50:
        assert len(rows) == len(found)


def test_keys_that_arrow_cannot_group_give_the_same(spark):
    d = spark.range(5000).selectExpr("id % 2 g", *[f"double(id % {k}) x{k}" for k in range(1, 9)])
    found = A.column_stats(d, ["g"], [f"x{k}" for k in range(1, 9)], quantiles=(0.5,))
    assert found.count() == 16
    keyed = d.selectExpr("array(g) g", "x3")
    assert {(x.g[0], x.mean) for x in A.column_stats(keyed, ["g"], ["x3"], quantiles=(0.5,)).collect()} == {(x.g, x.mean) for x in found.where("column = 'x3'").collect()}
