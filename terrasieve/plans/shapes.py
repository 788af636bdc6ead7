"""Queries on the shape of tables, on band lists and date windows, and on the fuller feature sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import series as S
from ..operators import aggregates as A
from ..operators import geometry as G
from ..operators import joins as J
from ..operators import raster as R
from ..operators import sampling as P
from ..operators import timeseries as T
from ..operators import windows as V
from ..sources.tables import table
from .relational import DAYS, PLANTED, days, planted
from .season import DB, decibel, runs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def r4(c, name: str):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + 1e-9, 4).alias(name)


# --- tables

_CODES = "SELECT c_custkey, r_name, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query(f"""WITH t AS ({_CODES}), c AS (SELECT r_name, n_name, c_mktsegment, row_number() OVER (ORDER BY r_name, n_name, c_mktsegment) AS code FROM (SELECT DISTINCT r_name, n_name, c_mktsegment FROM t))
SELECT c_custkey, code FROM t JOIN c USING (r_name, n_name, c_mktsegment)""")
def names_to_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on three name columns; only the distinct names are ordered."""
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    named = c.join(n, c.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey).select("c_custkey", "r_name", "n_name", "c_mktsegment")
    return J.coded(named, ["r_name", "n_name", "c_mktsegment"], "code").select("c_custkey", F.col("code").cast("long").alias("code"))


_TEN = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_shipdate, year(l_shipdate) AS y, month(l_shipdate) AS m, day(l_shipdate) AS d"


@query(f"""WITH a AS (SELECT {_TEN}, l_quantity AS red FROM lineitem WHERE l_quantity > 5), b AS (SELECT {_TEN}, l_tax AS nir FROM lineitem WHERE l_tax > 0.01), c AS (SELECT {_TEN}, l_discount AS swir FROM lineitem)
SELECT l_orderkey, l_linenumber, red, nir, swir FROM a JOIN b USING (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_shipdate, y, m, d) JOIN c USING (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_shipdate, y, m, d)""")
def band_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of a scene merged on the ten columns they share."""
    li = table(spark, sf_dir, "lineitem").withColumns({"y": F.year("l_shipdate"), "m": F.month("l_shipdate"), "d": F.dayofmonth("l_shipdate")})
    on = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate", "y", "m", "d"]
    bands = [li.where("l_quantity > 5").select(*on, F.col("l_quantity").alias("red")), li.where("l_tax > 0.01").select(*on, F.col("l_tax").alias("nir")), li.select(*on, F.col("l_discount").alias("swir"))]
    return J.merged(bands, on).select("l_orderkey", "l_linenumber", "red", "nir", "swir")


@query("""WITH a AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT o_custkey, a.total AS total_old, a.n AS n_old, b.total AS total_new, b.n AS n_new FROM a LEFT JOIN b USING (o_custkey)""")
def compared_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a, b = (o.where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n")) for s in ("F", "O"))
    return J.compared(a, b, ["o_custkey"], ("_old", "_new"))


@query("""WITH f AS (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey, n, c_nationkey, c_mktsegment FROM f JOIN customer USING (c_custkey)""")
def features_with_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return J.merged([f, table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")], ["c_custkey"])


@query("""SELECT o_custkey, 'S1A' AS source, o_totalprice AS v, NULL::VARCHAR AS note FROM orders WHERE year(o_orderdate) = 1996 UNION ALL SELECT o_custkey, 'S1B', o_totalprice, o_orderpriority FROM orders WHERE year(o_orderdate) = 1997""")
def union_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasons one below the other, by name; a column that one lacks is null there."""
    o = table(spark, sf_dir, "orders")
    a = o.where(F.year("o_orderdate") == 1996).select("o_custkey", F.lit("S1A").alias("source"), F.col("o_totalprice").alias("v"))
    b = o.where(F.year("o_orderdate") == 1997).select(F.col("o_orderpriority").alias("note"), F.col("o_totalprice").alias("v"), "o_custkey", F.lit("S1B").alias("source"))
    return J.stacked([a, b])


@query("""WITH a AS (SELECT l_suppkey, round(avg(l_quantity), 4) AS q FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey, round(avg(l_tax), 4) AS t FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), c AS (SELECT s_suppkey AS l_suppkey, s_nationkey FROM supplier)
SELECT l_suppkey, q, t, s_nationkey FROM a FULL JOIN b USING (l_suppkey) FULL JOIN c USING (l_suppkey)""")
def aligned_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames side by side: rows meet on their key, never on their place."""
    li = table(spark, sf_dir, "lineitem")
    a = li.groupBy("l_suppkey").agg(F.round(F.avg("l_quantity"), 4).alias("q"))
    b = li.where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.round(F.avg("l_tax"), 4).alias("t"))
    return J.merged([a, b, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")], ["l_suppkey"], "full")


@query("""WITH y AS (SELECT o_custkey, list_distinct(list(year(o_orderdate)) FILTER (o_orderstatus = 'F')) AS a, list_distinct(list(year(o_orderdate)) FILTER (o_orderstatus = 'O')) AS b FROM orders GROUP BY 1)
SELECT o_custkey, coalesce(len(list_intersect(a, b)), 0) AS n_both, coalesce(len(a), 0) - coalesce(len(list_intersect(a, b)), 0) AS n_only_a FROM y""")
def band_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands that two lists share, and those of the first alone."""
    years = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.year("o_orderdate")))
    y = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(years("F").alias("a"), years("O").alias("b"))
    return y.select("o_custkey", F.size(F.array_intersect("a", "b")).cast("long").alias("n_both"), F.size(F.array_except("a", "b")).cast("long").alias("n_only_a"))


@query("""SELECT l_orderkey, l_linenumber, 'discount' AS measure, l_discount AS v FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'tax', l_tax FROM lineitem""")
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return d.unpivot(["l_orderkey", "l_linenumber"], ["discount", "tax"], "measure", "v")


@query("""SELECT o_custkey AS s1_custkey, CAST(o_orderkey AS VARCHAR) AS s1_orderkey, CAST(o_totalprice AS BIGINT) AS s1_price FROM (SELECT o_orderkey, o_custkey, floor(o_totalprice) AS o_totalprice FROM orders)""")
def renamed_and_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional names, a rename by function, types by dictionary, columns in order of name."""
    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.floor("o_totalprice")).toDF("o_orderkey", "o_custkey", "o_price")
    d = X.cast_all(X.renamed(d, lambda c: "s1_" + c.removeprefix("o_")), {"s1_orderkey": "string", "s1_price": "bigint"})
    return d.select(*sorted(d.columns))


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders) WHERE p = '1-URGENT' OR p IS NULL""")
def category_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").withColumn("p", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")))
    return d.where(X.is_or_null("p", "1-URGENT")).select("o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity * 4, 4) AS square_m, round(l_quantity * 0.0025, 6) AS rai, round(l_quantity * 4 / 1600, 6) AS rai_of_m FROM lineitem""")
def land_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(q * X.WA_TO_SQUARE_M, 4).alias("square_m"), F.round(q * X.WA_TO_RAI, 6).alias("rai"), F.round(q * X.WA_TO_SQUARE_M / X.SQUARE_M_PER_RAI, 6).alias("rai_of_m"))


@query("""WITH d AS (SELECT CASE WHEN l_linenumber = 1 THEN 0 ELSE l_discount * 10 END AS p FROM lineitem) SELECT CASE WHEN p = 0 THEN 0 WHEN p < 0.3 THEN 1 WHEN p <= 0.7 THEN 2 WHEN p > 0.7 THEN 3 END AS bin, count(*) AS n FROM d GROUP BY 1""")
def rice_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").withColumn("p", F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.col("l_discount") * 10))
    return d.groupBy(X.probability_bins("p", 0.3, 0.7).alias("bin")).agg(F.count("*").alias("n"))


@query("""SELECT CAST(l_linenumber % 3 * 3 + l_partkey % 3 AS INTEGER) AS code, CAST(100000 * (l_partkey % 50) + l_suppkey % 50 AS BIGINT) AS pixel, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def pair_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = X.pair_code(F.col("l_linenumber") % 3, F.col("l_partkey") % 3).cast("int")
    return table(spark, sf_dir, "lineitem").groupBy(code.alias("code"), X.grid_key(F.col("l_partkey") % 50, F.col("l_suppkey") % 50).alias("pixel")).agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT l_linenumber % 2 = 0 AS a, l_partkey % 3 = 0 AS b, l_suppkey % 5 < 2 AS c FROM lineitem) SELECT a AND b AND c AS all_three, a = b AS ab, b = c AS bc, a = c AS ac, count(*) AS n FROM d GROUP BY ALL""")
def three_source_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 2 == 0).alias("a"), (F.col("l_partkey") % 3 == 0).alias("b"), (F.col("l_suppkey") % 5 < 2).alias("c"))
    return d.groupBy(*X.agreements(["a", "b", "c"], "all_three")).agg(F.count("*").alias("n"))


@query("""SELECT l_suppkey, round(sum(l_discount - l_tax), 6) AS "d-t", round(sum(l_tax - l_quantity), 4) AS "t-q", count(*) FILTER (isfinite(l_quantity / l_tax)) AS n_finite FROM (SELECT l_suppkey, l_discount, l_tax, l_quantity FROM lineitem) GROUP BY 1""")
def named_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent columns, the older less the newer, under names of both; ratios with infinities made null."""
    d = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_discount").alias("d"), F.col("l_tax").alias("t"), F.col("l_quantity").alias("q"))
    w = d.select("l_suppkey", *X.adjacent_differences(["d", "t", "q"]), X.finite(F.try_divide("q", "t")).alias("f"))
    return w.groupBy("l_suppkey").agg(F.round(F.sum("`d-t`"), 6).alias("d-t"), F.round(F.sum("`t-q`"), 4).alias("t-q"), F.count("f").alias("n_finite"))


@query("""WITH z AS (SELECT l_suppkey % 20 AS zone, CAST(l_quantity AS INTEGER) % 4 AS v FROM lineitem)
SELECT zone, count(*) FILTER (v != 0) AS total, round(count(*) FILTER (v >= 2) / count(*) FILTER (v != 0) + 1e-9, 4) AS normal, round(count(*) FILTER (v = 3) / count(*) FILTER (v != 0) + 1e-9, 4) AS high FROM z GROUP BY 1 HAVING count(*) FILTER (v != 0) > 0""")
def zonal_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("zone"), (F.col("l_quantity").cast("int") % 4).alias("v"))
    s = A.zonal_shares(z, ["zone"], "v", {"normal": F.col("v") >= 2, "high": F.col("v") == 3})
    return s.select("zone", "total", r4("normal", "normal"), r4("high", "high"))


@query(f"""WITH {DB} SELECT t, round(avg(x) + 1e-9, 4) AS mean, round(1.645 * stddev_samp(x) / avg(x) + 1e-9, 4) AS band FROM db GROUP BY 1""")
def normal_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each period over all pixels, and the relative width of its band."""
    d = decibel(spark, sf_dir).select(F.posexplode("ts").alias("t", "x"))
    return d.groupBy(F.col("t").cast("long").alias("t")).agg(r4(F.avg("x"), "mean"), r4(A.relative_spread("x"), "band"))


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment, sum(c_acctbal) / count(*) AS k FROM customer GROUP BY 1, 2) SELECT c_nationkey, round(avg(k) + 1e-9, 4) AS mean, count(*) AS n FROM c GROUP BY 1""")
def mean_of_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "customer").withColumn("one", F.lit(1))
    return A.two_level_mean(d, ["c_nationkey"], ["c_mktsegment"], "c_acctbal", "one", "mean").select("c_nationkey", r4("mean", "mean"), "n")


@query("""SELECT CASE WHEN r BETWEEN 0.75 AND 1.25 THEN 1 WHEN r < 0.75 THEN 2 ELSE 3 END AS tier, count(*) AS n FROM (SELECT o_totalprice / (150000 + o_custkey % 7 * 20000) AS r FROM orders) GROUP BY 1""")
def area_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select(R.ratio_tier(F.col("o_totalprice"), 150000 + F.col("o_custkey") % 7 * 20000).alias("tier"))
    return d.groupBy("tier").agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT user_id % 5 AS image, quantile_cont(value, 0.02) AS a, quantile_cont(value, 0.98) AS b FROM events GROUP BY 1)
SELECT image, CAST(floor(255 * least(greatest((value - a) / (b - a), 0), 1)) AS INTEGER) AS shade, count(*) AS n FROM events JOIN q ON user_id % 5 = image GROUP BY 1, 2""")
def percentile_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("image"), "value")
    return R.stretched(d, ["image"], "value", "shade").groupBy("image", "shade").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT least(CAST(floor(value) AS INTEGER), 255) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT bin, n, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 6) AS share FROM b""")
def histogram_equalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").where("value is not null").select(F.floor("value").cast("int").alias("v"))
    return R.equalized(d, "v").select("bin", "n", F.round("share", 6).alias("share"))


@query("""SELECT o_orderpriority AS province, CAST(mode AS INTEGER) AS zone FROM (SELECT o_orderpriority, z AS mode, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, z) AS k FROM (SELECT o_orderpriority, CAST(floor((95 + o_custkey % 130 / 10.0 + 180) / 6) AS INTEGER) + 1 AS z, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE k = 1""")
def zone_of_province(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone that most centroids of a province lie in; the smallest of ties."""
    d = table(spark, sf_dir, "orders").select("o_orderpriority", G.utm_zone(95 + F.col("o_custkey") % 130 / 10).alias("z"))
    return d.groupBy(F.col("o_orderpriority").alias("province")).agg(A.smallest_mode(F.col("z")).alias("zone"))


@query("""WITH c AS (SELECT l_partkey % 40 AS row, l_suppkey % 40 AS col, l_linenumber AS v FROM lineitem) SELECT row, col, max(v) AS v FROM c GROUP BY 1, 2""")
def burned_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.burn(table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 40).alias("row"), (F.col("l_suppkey") % 40).alias("col"), F.col("l_linenumber").alias("v")), "v")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%9' AND c_acctbal > 0""")
def columns_by_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns picked by a fragment of their name, rows by one of theirs."""
    d = table(spark, sf_dir, "customer")
    return X.with_fragment(d.where(F.col("c_name").endswith("9") & (F.col("c_acctbal") > 0)), ["c_cust", "c_name"])


@query("""SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 != 0""")
def polygons_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "POINT (1 2)").when(F.col("s_suppkey") % 3 == 1, "POLYGON ((0 0, 1 0, 1 1, 0 0))").otherwise("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))").alias("wkt"))
    return s.where(G.is_kind("wkt", "POLYGON", "MULTIPOLYGON")).select("s_suppkey")


# --- samples

@query("""WITH d AS (SELECT o_custkey % 5 AS pat, year(o_orderdate) AS y, CAST(o_orderstatus = 'P' AS INTEGER) AS label, o_custkey AS k FROM orders),
k AS (SELECT DISTINCT pat, y, label, k FROM d), pk AS (SELECT DISTINCT pat, label, k FROM d),
r AS (SELECT pat, count(*) FILTER (label = 1) / nullif(count(*) FILTER (label = 0), 0) AS ratio FROM pk GROUP BY 1), m AS (SELECT min(CASE WHEN ratio = 0 THEN 1 ELSE ratio END) AS least FROM r),
s AS (SELECT pat, y, count(*) FILTER (label = 1) AS loss, count(*) FILTER (label = 0) AS no FROM k GROUP BY 1, 2),
n AS (SELECT s.*, least(no, CAST(ceil(CASE WHEN loss = 0 THEN CASE WHEN ratio = 0 THEN least ELSE ratio END * no ELSE least(loss, no) END) AS BIGINT)) AS take FROM s JOIN r USING (pat), m),
h AS (SELECT pat, y, k, row_number() OVER (PARTITION BY pat, y ORDER BY md5('0:' || k), k) AS h FROM k WHERE label = 0)
SELECT pat, y, 1 AS label, k FROM k WHERE label = 1 UNION ALL SELECT pat, y, 0, k FROM h JOIN n USING (pat, y) WHERE h <= take""")
def ratio_rule_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plots without a loss sampled by district and year: as many as with one, or by the district's ratio where a year has none."""
    o = table(spark, sf_dir, "orders")
    d = o.select((F.col("o_custkey") % 5).alias("pat"), F.year("o_orderdate").cast("long").alias("y"), (F.col("o_orderstatus") == "P").cast("int").alias("label"), F.col("o_custkey").alias("k"))
    return P.by_ratio_rules(d, "pat", "y", "label", "k")


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY md5('11:' || o_orderkey), o_orderkey) AS place FROM orders""")
def shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows in a repeatable random order, numbered without ordering them in one task."""
    d = P.hash_rank(table(spark, sf_dir, "orders").select("o_orderkey"), [], ["o_orderkey"], seed=11)
    return d.select("o_orderkey", F.col("_r").cast("long").alias("place"))


@query("""WITH b AS (SELECT DISTINCT user_id % 5 AS plot, CAST(ts AS DATE) AS day FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY plot ORDER BY md5('2:' || strftime(day, '%Y-%m-%d')), day) AS r, count(*) OVER (PARTITION BY plot) AS n FROM b)
SELECT plot, strftime(day, '%Y-%m-%d') AS day FROM r WHERE r <= ceil(0.25 * n)""")
def quarter_of_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of a strip's bands, in hash order, for the mask of valid pixels."""
    b = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("plot"), F.to_date("ts").cast("string").alias("day")).distinct()
    return P.share_per_class(b, ["plot"], ["day"], 0.25, seed=2)


# --- dates and series

@query(f"""WITH {DAYS}, d AS (SELECT DISTINCT pixel % 5 AS plot, day FROM days WHERE day(day) % 3 != 0), a AS (SELECT plot, day, row_number() OVER (PARTITION BY plot ORDER BY day) AS band FROM d),
b AS (SELECT plot, min(day) - 120 AS lo, max(day) + 120 AS hi FROM d GROUP BY 1), i AS (SELECT plot, CAST(lo + CAST(k * 6 AS INTEGER) AS DATE) AS day FROM b, range(60) r(k) WHERE lo + CAST(k * 6 AS INTEGER) <= hi)
SELECT plot, strftime(i.day, '%Y-%m-%d') AS day, coalesce(band, 0) AS band FROM i LEFT JOIN a USING (plot, day) WHERE i.day BETWEEN DATE '2023-12-01' AND DATE '2024-02-10'""")
def band_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ideal days of a cycle with twenty cycles on each side, those in a window, and the bands there are of them."""
    d = days(spark, sf_dir).where(F.dayofmonth("day") % 3 != 0).select((F.col("pixel") % 5).alias("plot"), "day").distinct()
    w = T.band_window(T.ideal_days(d, ["plot"], "day", 6), d, ["plot"], "day", "2023-12-01", "2024-02-10")
    return w.select("plot", F.col("day").cast("string").alias("day"), F.coalesce("band", F.lit(0)).cast("long").alias("band"))


@query(f"""WITH {DB}, {PLANTED}, p AS (SELECT plot, pixel, date_diff('day', DATE '2024-01-01', plant) AS k FROM planted)
SELECT p.plot, CAST(t - k AS BIGINT) AS t, round(x + 1e-9, 4) AS x FROM p JOIN db ON db.pixel = p.pixel AND t BETWEEN k AND k + 14 WHERE k + 15 <= 30""")
def rebased_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen periods from planting on, exactly, or none."""
    p = planted(spark, sf_dir).join(decibel(spark, sf_dir).select("pixel", "ts"), "pixel").withColumn("first", F.lit("2024-01-01").cast("date"))
    r = T.rebase(p, "ts", "first", "plant", 1, 15).select("plot", F.posexplode("ts").alias("t", "x"))
    return r.select("plot", F.col("t").cast("long").alias("t"), r4("x", "x"))


_STAGES = {"age1": (0, 6), "age2": (7, 14), "age3": (15, 19), "age4": (20, 24)}


def _stage_drops_sql(with_first: bool) -> str:
    names = list(_STAGES)
    drops = ", ".join(f"min(d) FILTER (t BETWEEN {max(1, a)} AND {b}) AS {n}" for n, (a, b) in _STAGES.items())
    used = names if with_first else names[1:]
    first = 1 if with_first else _STAGES["age2"][0] + 1
    period = "CASE " + " ".join(f"WHEN {n} = least({', '.join(used)}) THEN {names.index(n) + 1}" for n in used) + " END"
    return f"""WITH {DB}, d AS (SELECT pixel, t, x, x - lag(x) OVER (PARTITION BY pixel ORDER BY t) AS d FROM db WHERE t <= 24), s AS (SELECT pixel, {drops} FROM d GROUP BY 1),
k AS (SELECT pixel, t AS at_t, row_number() OVER (PARTITION BY pixel ORDER BY d, t) AS k FROM d WHERE t >= {first}), a AS (SELECT pixel, at_t FROM k WHERE k = 1)
SELECT s.pixel, {', '.join(f'round({n} + 1e-9, 4) AS {n}' for n in names)}, {period} AS period, at_t, round(max(x) FILTER (db.t = at_t - 1) + 1e-9, 4) AS before, round(coalesce(max(x) FILTER (db.t = at_t + 5), 0) + 1e-9, 4) AS after
FROM s JOIN a USING (pixel) JOIN db USING (pixel) GROUP BY ALL"""


def _stage_drops(spark: SparkSession, sf_dir: str, with_first: bool) -> DataFrame:
    d = T.stage_drops(decibel(spark, sf_dir), "ts", _STAGES, with_first=with_first)
    return d.select("pixel", *[r4(n, n) for n in _STAGES], "period", F.col("at").cast("long").alias("at_t"), r4(F.col("window")[0], "before"), r4(F.coalesce(F.col("window")[6], F.lit(0.0)), "after"))


@query(_stage_drops_sql(True))
def stage_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sharpest one-period drop of each stage and of all, with seven values around it."""
    return _stage_drops(spark, sf_dir, True)


@query(_stage_drops_sql(False))
def stage_drops_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the first stage."""
    return _stage_drops(spark, sf_dir, False)


@query(f"""WITH {DB}, m AS (SELECT pixel, x, median(x) OVER (PARTITION BY pixel) AS m FROM db WHERE t BETWEEN 7 AND 14) SELECT pixel, round(sum(greatest(m - x, 0)) + 1e-9, 4) AS area, round(any_value(m) - min(x) + 1e-9, 4) AS depth FROM m GROUP BY 1""")
def simple_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decibel(spark, sf_dir).select("pixel", S.stretch("ts", 7, 14).alias("s"))
    return d.select("pixel", r4(S.sum_under_median("s"), "area"), r4(S.series_median("s") - F.array_min("s"), "depth"))


_BUCKETS = f"""{DAYS}, {PLANTED}, b AS (SELECT pixel, CAST(floor(date_diff('day', DATE '2024-01-01', day) / 5) AS INTEGER) AS b, max(CAST(v > 120 AS INTEGER)) AS f FROM days GROUP BY 1, 2),
a AS (SELECT plot, pixel, CAST(floor(date_diff('day', DATE '2024-01-01', plant) / 5) AS INTEGER) AS lo, least(CAST(floor((date_diff('day', DATE '2024-01-01', plant) + 20) / 5) AS INTEGER), 5) AS hi FROM planted),
g AS (SELECT plot, lo + CAST(k AS INTEGER) AS t, pixel FROM a, range(6) r(k) WHERE lo + k <= hi), fl AS (SELECT plot AS pixel, t, '' AS th, coalesce(f, 0) AS f FROM g LEFT JOIN b ON b.pixel = g.pixel AND b.b = g.t),
rx AS (SELECT pixel, t, f, CASE WHEN f = 0 AND lag(f) OVER o = 1 AND lead(f) OVER o = 1 THEN 1 ELSE f END AS g FROM fl WINDOW o AS (PARTITION BY pixel ORDER BY t)),
u AS (SELECT pixel, t, 's' AS th, f FROM rx UNION ALL SELECT pixel, t, 'r', g FROM rx), {runs('f', 'u')},
w AS (SELECT plot, coalesce(max(run) FILTER (th = 's'), 0) AS s, coalesce(max(run) FILTER (th = 'r'), 0) AS r FROM a LEFT JOIN longest ON longest.pixel = plot GROUP BY 1)"""


@query(f"WITH {_BUCKETS} SELECT plot % 50 AS district, count(*) AS n, " + ", ".join(f"round(count(*) FILTER (least({c}, 4) = {k}) / count(*) + 1e-9, 4) AS {m}_{k}" for m, c in (("strict", "s"), ("relax", "r")) for k in range(5)) + " FROM w GROUP BY 1")
def polygon_flood_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-day flood flags of a plot from planting to harvest; shares of a district's plots by longest run, strict and relaxed."""
    bucket = lambda d: J.day_bucket(d, "2024-01-01", 5)
    flags = days(spark, sf_dir).groupBy("pixel", bucket("day").alias("b")).agg(F.max((F.col("v") > 120).cast("int")).alias("f"))
    series = T.to_series(flags, ["pixel"], "b", "f", 6, 0.0)
    plots = planted(spark, sf_dir).join(series, "pixel", "left").withColumn("ts", F.coalesce("ts", F.array_repeat(F.lit(0.0), 6)))
    inside = plots.withColumn("s", T.between_periods("ts", bucket("plant"), bucket(F.date_add("plant", 20))))
    d = T.run_shares(inside.withColumn("district", F.col("plot") % 50), ["district"], "s", (1, 2, 3, 4))
    return d.select("district", "n", *[r4(f"{m}_{k}", f"{m}_{k}") for m in ("strict", "relax") for k in range(5)])


@query(f"""WITH {DAYS}, {PLANTED} SELECT plot, strftime(CAST(plant - 32 AS DATE), '%Y-%m-%d') AS first, strftime(CAST(plant + 176 AS DATE), '%Y-%m-%d') AS last, count(day) AS n FROM planted LEFT JOIN days ON days.pixel = planted.pixel AND day BETWEEN plant - 32 AND plant + 176 GROUP BY 1, 2, 3""")
def image_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen images of sixteen days, two of them before planting, and what was acquired in that window."""
    p = planted(spark, sf_dir)
    p = p.select("*", *[c.alias(n) for n, c in zip(("first", "last"), T.image_window("plant", 16, 14, 2))])
    met = J.interval_join(p, days(spark, sf_dir), ["pixel"], "day", "first", "last").groupBy("plot").agg(F.count("*").alias("n"))
    return p.join(met, "plot", "left").select("plot", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH e AS (SELECT user_id % 5 AS strip, CAST(ts AS DATE) AS day, CASE WHEN user_id % 4 = 0 AND day(ts) > 9 THEN 'S1B' ELSE 'S1A' END AS satellite FROM events), s AS (SELECT strip, min(day) - 6 AS start FROM e WHERE satellite = 'S1B' GROUP BY 1)
SELECT strip, strftime(CAST(start AS DATE), '%Y-%m-%d') AS start, count(*) AS n FROM e JOIN s USING (strip) WHERE day >= start GROUP BY 1, 2""")
def dual_era(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acquisitions since six days before the second satellite's first."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("strip"), F.to_date("ts").alias("day"), F.when((F.col("user_id") % 4 == 0) & (F.dayofmonth("ts") > 9), "S1B").otherwise("S1A").alias("satellite"))
    return T.dual_era(e, ["strip"], "day", F.col("satellite") == "S1B").groupBy("strip", F.col("start").cast("string").alias("start")).agg(F.count("*").alias("n"))


_UNDER, _ABOVE = (5, 10, 15, 20), (80, 85, 90, 95)
_TH = " UNION ALL ".join(f"SELECT '{k}{v}' AS th, {v} AS v, {up} AS up" for k, up, vs in (("u", "false", _UNDER), ("a", "true", _ABOVE)) for v in vs)


@query(f"""WITH {DB}, r AS (SELECT pixel, plot, t, rank() OVER (PARTITION BY plot ORDER BY x) AS r, count(*) OVER (PARTITION BY plot, x) AS p, count(*) OVER (PARTITION BY plot) AS n FROM db),
q AS (SELECT pixel, t, 100 * ((r + (p - 1) / 2) / n) AS pct FROM r), th AS ({_TH}), fl AS (SELECT pixel, t, th, CAST(CASE WHEN up THEN pct > v ELSE pct < v END AS INTEGER) AS f FROM q, th),
rx AS (SELECT pixel, t, th, f, CASE WHEN f = 0 AND lag(f) OVER o = 1 AND lead(f) OVER o = 1 THEN 1 ELSE f END AS g FROM fl WINDOW o AS (PARTITION BY pixel, th ORDER BY t)),
u AS (SELECT pixel, t, th || '_strict' AS th, f FROM rx UNION ALL SELECT pixel, t, th || '_relax', g FROM rx), {runs('f', 'u')}
SELECT db.plot, db.pixel, """ + ", ".join(f"coalesce(max(run) FILTER (th = '{k}{v}_{m}'), 0) AS {k}{v}_{m}" for k, vs in (("u", _UNDER), ("a", _ABOVE)) for v in vs for m in ("strict", "relax")) + " FROM (SELECT DISTINCT plot, pixel FROM db) db LEFT JOIN longest USING (pixel) GROUP BY 1, 2")
def percentile_run_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest runs of a pixel under and above eight percentiles of its plot's values, strict and relaxed."""
    d = decibel(spark, sf_dir).select("pixel", "plot", F.posexplode("ts").alias("t", "x"))
    ranked = T.to_series(V.percent_rank_avg(d, ["plot"], "x"), ["plot", "pixel"], "t", "pct", 30)
    runs_of = T.percentile_runs(F.transform("ts", lambda x: 100 * x), _UNDER, _ABOVE)
    return ranked.select("plot", "pixel", *[c.cast("long").alias(n) for n, c in runs_of.items()])


@query(f"""WITH {DB}, e AS (SELECT plot, pixel, max(x) AS hi, min(x) AS lo, round(median(x), 6) AS med FROM db GROUP BY 1, 2),
r AS (SELECT *, {', '.join(f"(rank() OVER (PARTITION BY plot ORDER BY {c}) + (count(*) OVER (PARTITION BY plot, {c}) - 1) / 2) * 100 / count(*) OVER (PARTITION BY plot) AS pctl_{c}" for c in ('hi', 'lo', 'med'))} FROM e)
SELECT plot, pixel, {', '.join(f"round({c} + 1e-9, 4) AS {c}, round(pctl_{c} + 1e-9, 4) AS pctl_{c}" for c in ('hi', 'lo', 'med'))} FROM r""")
def extreme_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extremes of each series and their percentiles inside the plot."""
    d = decibel(spark, sf_dir).select("plot", "pixel", F.array_max("ts").alias("hi"), F.array_min("ts").alias("lo"), F.round(S.series_median("ts"), 6).alias("med"))
    for c in ("hi", "lo", "med"):
        d = V.percent_rank_avg(d, ["plot"], c, f"pctl_{c}")
    return d.select("plot", "pixel", *[x for c in ("hi", "lo", "med") for x in (r4(c, c), r4(100 * F.col(f"pctl_{c}"), f"pctl_{c}"))])
