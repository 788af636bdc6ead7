"""Operators whose results SQL doesn't check: sources, sinks, geometry, sampling, models, streams."""

from __future__ import annotations

import datetime as dt
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasieve.functions import series as S
from terrasieve.operators import geometry as G
from terrasieve.operators import joins, metrics, ml, raster, sampling, timeseries, windows
from terrasieve.sources import geotiff, shapefile, tables
from terrasieve.streaming import flood


def test_forward_and_backward_on_a_grid(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    left = spark.createDataFrame([(1, day(n)) for n in (0, 1, 12, 30)] + [(2, day(0))], "k int, at date")
    grid = spark.createDataFrame([(1, day(n), float(n)) for n in (0, 12, 24)], "k int, day date, v double")
    fwd = {(r.k, r["at"]): r.asof_v for r in joins.asof_forward(left, grid, ["k"], "at", "day", "v").collect()}
    back = {(r.k, r["at"]): r.asof_v for r in joins.asof_backward(left, grid, ["k"], "at", "day", "v").collect()}
    assert [fwd[1, day(n)] for n in (0, 1, 12, 30)] == [0, 12, 12, None] and fwd[2, day(0)] is None
    assert [back[1, day(n)] for n in (0, 1, 12, 30)] == [0, 0, 12, 24]


def test_sharp_drop_and_ties(spark):
    df = spark.createDataFrame([(1, [-8.0, -8.0, -16.0, -9.0]), (2, [None, None, None, None])], "plot int, ts array<double>")
    got = {r.plot: (r.coef, r.lag, r.t) for r in timeseries.sharp_drop(df, ["plot"], "ts", 0, 3).collect()}
    assert got == {1: (-24.0, 1, 2), 2: (None, None, None)}


def test_percent_rank_of_ties(spark):
    df = spark.createDataFrame([(i, "d", v) for i, v in enumerate([3.0, 1.0, 3.0, None, 7.0])], "i int, d string, v double")
    got = [r.pct for r in windows.percent_rank_avg(df, ["d"], "v").orderBy("i").collect()]
    assert got == [0.625, 0.25, 0.625, None, 1.0]


def test_null_groups_are_groups(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, 3.0), ("a", 3, 5.0)], "g string, k int, v double")
    assert [r.pct for r in windows.percent_rank_avg(df, ["g"], "v").orderBy("k").collect()] == [0.5, 1.0, 1.0]
    assert sampling.cap_per_class(df, ["g"], ["k"], 1).count() == 2
    assert metrics.roc_curve(df, "v", F.col("k") > 1, ["g"]).count() == 3


def test_fuzzy_confusion_and_threshold(spark):
    m = metrics.fuzzy_confusion(spark.createDataFrame([(0.5, 0.7), (1.0, 0.0)], "p double, a double"), "p", "a").first()
    assert [round(m[c], 6) for c in ("tn", "fp", "fn", "tp")] == [0.3, 1.3, 0.5, 0.5]
    curve = spark.createDataFrame([(3.0, 0.0), (2.0, 0.25), (1.0, 0.75)], "threshold double, fpr double")
    assert metrics.threshold_at_fpr(curve, 0.5).first().threshold == 2.0


def test_samples_repeat_and_balance(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("y"), (F.col("id") % 3).alias("s"))
    a = sampling.balanced(df, "y", ["id"], by=["s"])
    assert {(r.s, r.y): r["count"] for r in a.groupBy("s", "y").count().collect()} == {(s, y): n for s, n in ((0, 34), (1, 33), (2, 33)) for y in ("rare", "common")}
    assert a.exceptAll(sampling.balanced(df.repartition(7), "y", ["id"], by=["s"])).count() == 0
    assert 120 < sampling.fraction(df, ["id"], 0.2).count() < 280
    assert 120 < sampling.holdout(df, ["id"]).where("held_out").count() < 280
    d = df.select(sampling.anchor_days("id", 30, 121).alias("d")).agg(F.min("d"), F.max("d")).first()
    assert 30 <= d[0] and d[1] <= 121


def test_polygons(spark):
    ring = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))"
    df = spark.createDataFrame([(1, ring), (2, "MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((5 5, 6 5, 6 6, 5 6, 5 5)))"), (3, None), (4, "POLYGON EMPTY"), (5, "POLYGON ((3.1 3.1, 3.2 3.1, 3.2 3.2, 3.1 3.1))")], "k int, wkt string")
    m = {r.k: r.m for r in df.select("k", G.measures("wkt").alias("m")).collect()}
    assert m[1].area == 96 and m[2].area == 5 and not m[3].valid and not m[4].valid
    assert m[1].x == pytest.approx((100 * 5 - 4 * 3) / 96)
    cells = G.pixels_of(df, "k", "wkt", (0.0, 1.0, 0.0, 0.0, 0.0, 1.0))
    n = {r.k: (r.n, r.inside) for r in cells.groupBy("k").agg(F.count("*").alias("n"), F.min("is_within").alias("inside")).collect()}
    assert n == {1: (96, True), 2: (5, True), 5: (1, False)}
    touched = G.pixels_of(df.where("k = 5"), "k", "wkt", (0.0, 1.0, 0.0, 0.0, 0.0, 1.0), all_touched=True)
    assert [(r.row, r.col) for r in touched.collect()] == [(3, 3)]
    on = G.pixels_of(df.where("k < 3"), "k", "wkt", (0.0, 1.0, 0.0, 0.0, 0.0, 1.0), size=(3, 6))  # of a raster of 3 x 6 pixels
    assert {r.k: (r.n, r.row, r.col) for r in on.groupBy("k").agg(F.count("*").alias("n"), F.max("row").alias("row"), F.max("col").alias("col")).collect()} == {1: (16, 2, 5), 2: (4, 1, 1)}
    line = np.array([[0, 0], [1, 0.001], [2, 0], [2, 2], [0, 0]], float)
    assert len(G.simplify(line, 0.01)) == 4
    assert df.where("k = 2").select(G.simplified("wkt").alias("s")).first().s.startswith("MULTIPOLYGON")


def test_utm_of_known_places(spark):
    # Bangkok and a point on a central meridian, by the published series
    e, n = G.to_utm(F.lit(100.5018), F.lit(13.7563), 47)
    x, y = G.to_utm(F.lit(99.0), F.lit(0.0), 47)
    r = spark.range(1).select(e, n, x, y, G.utm_zone(F.lit(100.5018)), G.utm_zone(F.lit(102.0))).first()
    assert abs(r[0] - 662_350) < 150 and abs(r[1] - 1_521_260) < 300
    assert abs(r[2] - 500_000) < 1e-6 and abs(r[3]) < 1e-6 and r[4] == 47 and r[5] == 48
    one = spark.range(1).select(*G.to_utm(F.lit(99.0), F.lit(1.0), 47)).first()
    assert one[1] == pytest.approx(0.9996 * 110_574.3886, abs=0.5)


def test_raster_arithmetic(spark):
    t = (100.0, 2.0, 0.0, 50.0, 0.0, -2.0)
    assert raster.bounds(t, 5, 10) == (100.0, 40.0, 120.0, 50.0)
    r, c = raster.to_pixel(F.lit(105.0), F.lit(45.0), t)
    assert tuple(spark.range(1).select(r, c).first()) == (2, 2)
    images = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 0.0), ("c", None)], "image string, v double")
    assert {r.image for r in raster.defects(images, "image", "v").collect()} == {"b", "c"}


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "thai.csv").write_bytes("n,name\n0,ข้าว\n1,น้ำ\n".encode("cp874"))
    got = tables.csv(spark, str(tmp_path / "thai.csv"), "n int, name string", encoding="windows-874", drop_first=True).collect()
    assert [r.name for r in got] == ["ข้าว", "น้ำ"]
    for f in ("S1A_304_20240112.tif", "S1B_304_20240118.tif", "notes.txt"):
        (tmp_path / f).write_bytes(b"x" * len(f))
    c = tables.file_catalog(spark, str(tmp_path), r"(S1[AB])_(\d+)_(\d{8})\.tif$", ["satellite", "strip_id", "day"])
    assert tables.by_satellite(c, "304", "S1AB").count() == 2 and tables.by_satellite(c, "304", "S1A").count() == 1
    assert str(c.where("satellite = 'S1A'").select(tables.band_day("day").alias("d")).first().d) == "2024-01-12"
    df = spark.createDataFrame([(i, i % 3) for i in range(9)], "k int, g int")
    tables.write_partitioned(df, str(tmp_path / "p"), ["g"])
    assert spark.read.parquet(str(tmp_path / "p")).where("g = 1").count() == 3
    for _ in range(2):
        tables.write_missing(df, str(tmp_path / "m"), ["k"])
    tables.write_missing(df.union(spark.createDataFrame([(99, 0)], df.schema)), str(tmp_path / "m"), ["k"])
    assert spark.read.parquet(str(tmp_path / "m")).count() == 10
    shape = spark.createDataFrame([(1, "POLYGON ((0 0, 1 0, 1 1, 0 0))")], "k int, wkt string")
    assert tables.geojson(shape, "wkt", ["k"]).first().value == '{"type":"Feature","properties":{"k":1},"geometry":{"type":"Polygon","coordinates":[[[0.0,0.0],[1.0,0.0],[1.0,1.0],[0.0,0.0]]]}}'


def test_shapefile(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0), (0.0, 0.0)]
    body = struct.pack("<i4d2i", 5, 0, 0, 2, 2, 1, len(ring)) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    record = struct.pack(">ii", 1, len(body) // 2) + body
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + record)
    field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([5, 0]) + b"\0" * 14
    (tmp_path / "a.dbf").write_bytes(struct.pack("<B3BIHH20x", 3, 24, 1, 1, 1, 65, 6) + field + b"\r" + b" paddy")
    got = shapefile.read(spark, str(tmp_path)).first()
    assert got.number == 1 and got.attributes == {"NAME": "paddy"}
    assert spark.createDataFrame([(got.wkt,)], "wkt string").select(G.measures("wkt").alias("m")).first().m.area == 4


def test_stream_equals_fold(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(p, dt.date(2024, 1, 1) + dt.timedelta(t), float(v)) for p in range(6) for t, v in enumerate(rng.normal(-13, 2, 20))]
    df = spark.createDataFrame(rows, "pixel long, day date, v double")
    for k in range(4):  # batches in order of time
        df.where((F.dayofmonth("day") > 5 * k) & (F.dayofmonth("day") <= 5 * k + 5)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")
    out = flood.flood_stream(stream, "pixel", "day", "v", water=-12.5, to_water=2.5, from_water=-2.0)
    q = out.writeStream.format("memory").queryName("floods").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.pixel, r.day): r.flood for r in spark.table("floods").collect()}
    series = df.groupBy("pixel").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "v"))), lambda s: s["v"]).alias("ts"))
    want = {(r.pixel, dt.date(2024, 1, 1) + dt.timedelta(i)): f for r in series.select("pixel", S.flood_fold("ts", -12.5, 2.5, -2.0).alias("f")).collect() for i, f in enumerate(r.f)}
    assert got == want


def test_models(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b), float(rng.normal()), int(a + 0.2 * rng.normal() > 0)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, y int")
    assert ml.importances(ml.forest(["a", "b", "c"], "y", trees=10).fit(df), ["a", "b", "c"])[0][0] == "a"
    assert ml.eliminated(df, ["a", "b", "c"], "y", 1, trees=5) == ["a"]
    assert ml.mean_f1(df, ["a"], "y", "k", trials=1, trees=5) > 0.8
    assert ml.staged_selection(df, [["a"], ["c"]], "y", "k", trials=1, trees=5)[0] == "a"
    paths = ml.path_clusters(df, ["a", "b"], 2)
    assert {r.path for r in paths.select("path").distinct().collect()} <= set(range(4)) and paths.count() == 300
    assert ml.descendants(1, 1, 3) == [4, 5, 6, 7] and len(ml.feature_sets("abc")) == 7
    for name, p in ml.baselines(["a", "b"], "y").items():
        assert p.fit(df).transform(df).where("prediction = y").count() > 200, name
    assert ml.searched(df, ["a", "b"], "y", {"maxDepth": [2, 4], "numTrees": [5]}, folds=2, draws=1).stages
    fits = {k: p.fit(df) for k, p in ml.regressors(["a", "b"], "c").items()}
    assert len(fits) == 6
    made = ml.oversampled(df, "y", 1, ["a", "b"], "k")
    assert made.where("a is null or y <> 1").count() == 0 and made.count() > 100
    series = spark.createDataFrame([(1, [1.0, None, 3.0, 4.0]), (2, [1.0, -1.0, 2.0, 3.0])], "p int, ts array<double>")
    found = ml.scored_windows(ml.forest(["a", "b", "c"], "y", trees=5).fit(df), series, ["p"], "ts", ["a", "b", "c"])
    assert sorted((r.p, r.first) for r in found.select("p", "first").collect()) == [(1, 0), (1, 1)]


def test_runs_of_successive_stages_merge_in_order(spark):
    run = "struct<area:double,size:int,edge:boolean>"
    df = spark.createDataFrame([(1, (1.0, 2, True), (2.0, 3, True), (4.0, 1, False)), (2, (1.0, 2, False), (2.0, 3, True), (4.0, 1, True))], f"k int, s1 {run}, s2 {run}, s3 {run}")
    got = {r.k: (r.s1.area, r.s2.area, r.s3.area, r.s3.size) for r in timeseries.merged_runs(df, ["s1", "s2", "s3"]).collect()}
    assert got == {1: (3.0, 3.0, 4.0, 1), 2: (1.0, 6.0, 6.0, 4)}


def test_geotiff_round_trip(spark, tmp_path):
    x = np.arange(150 * 70, dtype=np.float32).reshape(150, 70)
    x[3, 4] = -9999
    t = (600_000.0, 30.0, 0.0, 1_500_000.0, 0.0, -30.0)
    (tmp_path / "a.tif").write_bytes(geotiff.encode(x, t, -9999))
    (tmp_path / "b.tif").write_bytes(geotiff.encode((x % 250).astype(np.uint8)))
    assert geotiff.header((tmp_path / "a.tif").read_bytes()).transform == t
    df = geotiff.read(spark, str(tmp_path))
    a = df.where("path like '%a.tif'")
    assert a.count() == x.size and a.where("value is null").collect()[0].asDict().items() >= {"row": 3, "col": 4, "band": 1}.items()
    assert a.where("row = 149 and col = 69").first().value == 150 * 70 - 1
    back = geotiff.tiles(a.withColumn("image", F.lit("a")), "image", "value", 64, t)
    assert back.count() == 6
    tile = back.where("tile_row = 2 and tile_col = 1").first().content
    assert geotiff.header(tile).transform == (600_000.0 + 64 * 30, 30.0, 0.0, 1_500_000.0 - 128 * 30, 0.0, -30.0)
    [(band, r, c, v)] = list(geotiff.blocks(tile))
    assert (band, r, c) == (1, 0, 0) and (v[: 150 - 128, : 70 - 64] == x[128:, 64:]).all() and (v[22:] == -9999).all()


def test_nearest_has_no_reach_and_pads(spark):
    import random
    from datetime import date, timedelta

    r, day = random.Random(3), lambda n: date(2000, 1, 1) + timedelta(n)
    right = [(k, day(r.choice([r.randint(0, 3000), 1500])), r.randint(0, 50)) for k in range(5) for _ in range((0, 2, 9, 40, 300)[k])]
    left = [(i, r.randint(-1, 4), day(r.randint(-500, 3500))) for i in range(60)] + [(60, 4, None), (61, None, day(9))]
    a, b = spark.createDataFrame(left, "i int, p int, at date"), spark.createDataFrame(right, "p int, day date, v int")
    for reach in (None, 64):
        want = []
        for i, p, at in left:
            near = sorted((abs((d - at).days), d, v) for q, d, v in right if q == p and at) if at else []
            best = sorted(x[1:] for x in [x for x in near if reach is None or x[0] <= reach][:4])
            want += [(i, n + 1, *x) for n, x in enumerate([*best, *[(None, None)] * 4][:4])]
        got = [(x.i, x.n, x.day, x.v) for x in joins.nearest(a, b, ["p"], "at", "day", reach=reach).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_sinks_views_and_files_of_years(spark, tmp_path):
    from terrasieve.sources import tables as S

    a, b = spark.createDataFrame([(1, 2.5, "x")], "k long, v double, s string"), spark.createDataFrame([(2, "y")], "k long, s string")
    S.write_csv(a, f"{tmp_path}/csv")
    assert [tuple(r) for r in S.csv(spark, f"{tmp_path}/csv", "k long, v double, s string").collect()] == [(1, 2.5, "x")]
    S.write_json(a, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").first().asDict() == {"k": 1, "v": 2.5, "s": "x"}
    stack = S.stack_view(spark, [a, b], "stack_of_two")
    assert sorted(map(tuple, stack.collect())) == [(1, 2.5, "x"), (2, None, "y")] and spark.table("stack_of_two").count() == 2
    assert S.materialized(stack, f"{tmp_path}/stack").count() == 2
    for y, df in ((2018, a), (2019, b)):
        df.write.parquet(f"{tmp_path}/{y}")
    assert sorted((r.k, r.year) for r in S.by_year(spark, {2019: f"{tmp_path}/2019", 2018: f"{tmp_path}/2018"}).collect()) == [(1, 2018), (2, 2019)]
    S.write_outcomes(a.withColumn("p", a.k == 1), f"{tmp_path}/outcomes", F.when(F.col("k") == 1, "TP").otherwise("FN"))
    assert spark.read.parquet(f"{tmp_path}/outcomes/outcome=TP").count() == 1


def test_small_files_are_found(spark):
    from terrasieve.sources.tables import small_files

    df = spark.createDataFrame([("b", 1000 + i, str(i)) for i in range(60)] + [("b", 3, "tiny")], "band string, length long, path string")
    assert "tiny" in {r.path for r in small_files(df, ["band"]).collect()}


def test_models_are_saved_and_scored_at_a_false_positive_rate(spark, tmp_path):
    from terrasieve.operators import ml

    df = spark.createDataFrame([(float(i % 10), float(i % 7), int(i % 10 > 5)) for i in range(200)], "a double, b double, y int")
    model = ml.saved(ml.forest(["a", "b"], "y", trees=5).fit(df), f"{tmp_path}/model")
    done = ml.scored_at_fpr(model, df, "y", 0.2)
    assert done.where("positive and y = 1").count() > 70 and done.where("positive and y = 0").count() <= 40


def test_nearest_rows_equal_brute_force(spark):
    import random

    from terrasieve.operators import ml

    r = random.Random(3)
    rows = [(i, r.random() ** 3, r.random(), r.random()) for i in range(150)]
    got = {}
    for x in ml.nearest_rows(spark.createDataFrame(rows, "k int, a double, b double, c double"), ["a", "b", "c"], "k", 4).collect():
        got.setdefault(x.k, {})[x["rank"]] = x.other
    for k, *p in rows:
        near = sorted((sum((u - v) ** 2 for u, v in zip(p, q)) ** 0.5, j) for j, *q in rows if j != k)[:4]
        assert [got[k][n] for n in (1, 2, 3, 4)] == [j for _, j in near]
    few = spark.createDataFrame(rows[:2], "k int, a double, b double, c double")
    assert ml.nearest_rows(few, ["a", "b"], "k", 5).count() == 2


def test_path_clusters_part_what_lies_apart(spark):
    from terrasieve.operators import ml

    rows = [(float(x + dx), float(y + dy)) for x in (0, 100) for y in (0, 30) for dx in range(3) for dy in range(3)]
    out = ml.path_clusters(spark.createDataFrame(rows, "x double, y double"), ["x", "y"], 3).collect()
    assert {(r.x >= 50, r.y >= 15, r.path >> 1) for r in out} == {(False, False, 0), (False, True, 1), (True, False, 2), (True, True, 3)}
    same = ml.path_clusters(spark.createDataFrame([(1.0, 1.0)] * 4, "x double, y double"), ["x", "y"], 2)
    assert {r.path for r in same.collect()} == {0}


def test_asof_over_many_rows_of_one_key(spark):
    import time

    from terrasieve.operators import joins as J

    left = spark.range(200_000).select(F.lit(1).alias("k"), "id", F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 9000).cast("int")).alias("at"))
    right = spark.range(100_000).select(F.lit(1).alias("k"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 4500 * 2).cast("int")).alias("day"), F.col("id").alias("v"))
    took = []
    for f in (J.asof_backward, J.asof_forward):
        began = time.time()
        d = f(left, right, ["k"], "at", "day", "v")
        gap = F.datediff("asof_day", "at")
        assert d.where(F.abs(gap) <= 1).count() == 200_000 - (f is J.asof_forward) * d.where("asof_day is null").count()
        took.append(time.time() - began)
    assert took[1] < 4 * took[0] + 2
    none = spark.createDataFrame([(1, None), (None, None)], "k int, at date")
    assert J.asof_backward(none, right, ["k"], "at", "day", "v").where("asof_day is null").count() == 2

