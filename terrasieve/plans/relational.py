"""Queries that join on keys, time and intervals, and that window over days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import timeseries as T
from ..operators import windows as V
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acquisitions: a pixel's mean value of a day."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("pixel"), F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("v"))


DAYS = "days AS (SELECT user_id AS pixel, CAST(ts AS DATE) AS day, round(avg(value), 6) AS v FROM events GROUP BY 1, 2)"
#: A plot's planting: a pixel and a date for each order.
PLANTED = "planted AS (SELECT o_orderkey AS plot, o_custkey % 150 AS pixel, CAST(DATE '2024-01-01' + CAST(o_orderkey % 30 AS INTEGER) AS DATE) AS plant FROM orders)"


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 30).cast("int"))
    return o.select(F.col("o_orderkey").alias("plot"), (F.col("o_custkey") % 150).alias("pixel"), day.alias("plant"))


@query("""SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 3 != 0 LEFT JOIN region ON n_regionkey = r_regionkey""")
def lookup_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    kept = n.where("n_nationkey % 3 != 0")
    return c.join(kept, c.c_nationkey == kept.n_nationkey, "left").join(r, F.col("n_regionkey") == r.r_regionkey, "left").select("c_custkey", "n_name", "r_name")


@query("""SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 3 != 0 GROUP BY 1""")
def lookup_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation").where("n_nationkey % 3 != 0")
    return c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)""")
def semi_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_quantity > 49")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left_semi").select("o_orderkey", "o_custkey")


@query("""SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def anti_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return J.not_done(o.select("o_custkey").distinct(), o.where("o_orderstatus = 'P'"), ["o_custkey"])


@query("""WITH v AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')
SELECT l_orderkey, count(*) AS n FROM lineitem JOIN v USING (l_partkey, l_suppkey) GROUP BY 1""")
def shared_pixel_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    on = ("l_partkey", "l_suppkey")
    return J.shared_pixels(li.where("l_returnflag = 'R'").select(*on), li.select(*on, "l_orderkey"), on).groupBy("l_orderkey").agg(F.count("*").alias("n"))


def _asof(cmp: str, agg: str) -> str:
    return f"""WITH {DAYS}, {PLANTED}, a AS (SELECT plot, plant, {agg}(day) AS day FROM planted LEFT JOIN days USING (pixel) WHERE day {cmp} plant GROUP BY 1, 2)
SELECT p.plot, strftime(a.day, '%Y-%m-%d') AS day, d.v FROM planted p LEFT JOIN a USING (plot) LEFT JOIN days d ON d.pixel = p.pixel AND d.day = a.day"""


@query(_asof(">=", "min"))
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = J.asof_forward(planted(spark, sf_dir), days(spark, sf_dir), ["pixel"], "plant", "day", "v")
    return d.select("plot", F.col("asof_day").cast("string").alias("day"), F.col("asof_v").alias("v"))


@query(_asof("<=", "max"))
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = J.asof_backward(planted(spark, sf_dir), days(spark, sf_dir), ["pixel"], "plant", "day", "v")
    return d.select("plot", F.col("asof_day").cast("string").alias("day"), F.col("asof_v").alias("v"))


@query("""SELECT o_orderkey, count(*) AS n, round(sum(l_quantity), 4) AS quantity FROM orders JOIN lineitem ON l_partkey = o_custkey
AND CAST(l_shipdate AS DATE) BETWEEN CAST(o_orderdate AS DATE) AND CAST(o_orderdate AS DATE) + 180 GROUP BY 1""")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), 180).alias("b"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.to_date("l_shipdate").alias("day"), "l_quantity")
    return J.interval_join(o, li, ["k"], "day", "a", "b").groupBy("o_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"))


@query(f"""WITH {DAYS}, {PLANTED}, j AS (SELECT plot, d.day, d.v, row_number() OVER (PARTITION BY plot ORDER BY abs(d.day - plant), d.day) AS k FROM planted JOIN days d USING (pixel)),
k AS (SELECT *, row_number() OVER (PARTITION BY plot ORDER BY day) AS n FROM j WHERE k <= 4) SELECT plot, n, strftime(day, '%Y-%m-%d') AS day, v FROM k""")
def nearest_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = J.nearest(planted(spark, sf_dir), days(spark, sf_dir), ["pixel"], "plant", "day").where("day is not null")  # the SQL doesn't pad
    return d.select("plot", F.col("n").cast("long").alias("n"), F.col("day").cast("string").alias("day"), "v")


@query("""WITH b AS (SELECT CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 5) AS INTEGER) AS b, value FROM events WHERE day(ts) NOT BETWEEN 6 AND 10)
SELECT CAST(dense_rank() OVER (ORDER BY b) - 1 AS INTEGER) AS bucket, count(*) AS n, round(sum(value), 2) AS total FROM b GROUP BY b""")
def bucket_5d(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(~F.dayofmonth("ts").between(6, 10)).select(J.day_bucket(F.to_date("ts"), "2024-01-01", 5).alias("b"), "value")
    n = e.groupBy("b").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return J.renumbered(n, "b", "bucket").select("bucket", "n", "total")


@query("""WITH n AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) AS k FROM n) SELECT l_partkey, l_suppkey, n FROM r WHERE k = 1""")
def best_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.best_source(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_suppkey")


@query(f"""WITH {DAYS}, i AS (SELECT pixel, day AS start, lead(day) OVER (PARTITION BY pixel ORDER BY day) AS stop FROM days), {PLANTED}
SELECT plot, strftime(start, '%Y-%m-%d') AS start, strftime(stop, '%Y-%m-%d') AS stop FROM planted JOIN i USING (pixel) WHERE stop IS NOT NULL AND plant > start AND plant <= stop""")
def report_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = J.to_intervals(days(spark, sf_dir), ["pixel"], "day").withColumn("_first", F.date_add("start", 1))
    d = J.interval_join(i, planted(spark, sf_dir), ["pixel"], "plant", "_first", "stop")
    return d.select("plot", F.col("start").cast("string").alias("start"), F.col("stop").cast("string").alias("stop"))


@query(f"""WITH {DAYS}, g AS (SELECT pixel, day, v, day - lag(day) OVER (PARTITION BY pixel ORDER BY day) AS gap FROM days) SELECT pixel, count(*) FILTER (gap = 1) AS next_day, CAST(max(gap) AS INTEGER) AS widest FROM g GROUP BY 1""")
def acquisition_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = V.gaps(days(spark, sf_dir), ["pixel"], "day")
    return g.groupBy("pixel").agg(F.count_if(F.col("gap") == 1).alias("next_day"), F.max("gap").alias("widest"))


@query(f"""WITH {DAYS}, w AS (SELECT pixel, day, lead(day, 3) OVER (PARTITION BY pixel ORDER BY day) AS last FROM days) SELECT pixel, count(*) AS n FROM w WHERE last - day = 3 GROUP BY 1""")
def four_in_a_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.consecutive(days(spark, sf_dir), ["pixel"], "day", 4, 3).groupBy("pixel").agg(F.count("*").alias("n"))


@query(f"""WITH {DAYS}, f AS (SELECT pixel, day, CAST(v > 150 AS INTEGER) AS flag FROM days)
SELECT pixel, strftime(day, '%Y-%m-%d') AS day, flag, max(flag) OVER (PARTITION BY pixel ORDER BY day RANGE BETWEEN INTERVAL 4 DAY PRECEDING AND INTERVAL 4 DAY FOLLOWING) AS near_flag FROM f""")
def any_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = days(spark, sf_dir).select("pixel", "day", (F.col("v") > 150).cast("int").alias("flag"))
    return V.any_within(f, ["pixel"], "day", "flag", 4).select("pixel", F.col("day").cast("string").alias("day"), "flag", "near_flag")


@query(f"""WITH {DAYS} SELECT pixel, strftime(day, '%Y-%m-%d') AS day, CASE WHEN v > 30 THEN CAST(sum(CAST(v > 30 AS INTEGER)) OVER (PARTITION BY pixel ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) ELSE 0 END AS band FROM days""")
def band_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.band_numbers(days(spark, sf_dir), ["pixel"], "day", F.col("v") > 30).select("pixel", F.col("day").cast("string").alias("day"), F.coalesce("band", F.lit(0)).alias("band"))


@query(f"""WITH {DAYS}, b AS (SELECT pixel, min(day) AS a, max(day) AS z FROM days GROUP BY 1), g AS (SELECT pixel, CAST(a + CAST(i AS INTEGER) AS DATE) AS day FROM b, range(40) r(i) WHERE a + CAST(i AS INTEGER) <= z)
SELECT pixel, strftime(day, '%Y-%m-%d') AS day FROM g WHERE (pixel, day) NOT IN (SELECT pixel, day FROM days)""")
def missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.missing_days(days(spark, sf_dir), ["pixel"], "day", 1).select("pixel", F.col("day").cast("string").alias("day"))


@query("""WITH v AS (SELECT user_id % 5 AS plot, event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events),
r AS (SELECT plot, event_id, v, rank() OVER (PARTITION BY plot, v IS NULL ORDER BY v) AS r, count(*) OVER (PARTITION BY plot, v) AS p, count(v) OVER (PARTITION BY plot) AS n FROM v)
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN (r + (p - 1) / 2) / n END, 6) AS pct FROM r""")
def pct_rank_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pool(spark, sf_dir).select("event_id", F.round("pct", 6).alias("pct"))


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("plot"), "user_id", "event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return V.percent_rank_avg(e, ["plot"], "v")


@query("""WITH v AS (SELECT user_id, user_id % 5 AS plot, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events),
r AS (SELECT user_id, v, rank() OVER (PARTITION BY plot, v IS NULL ORDER BY v) AS r, count(*) OVER (PARTITION BY plot, v) AS p, count(v) OVER (PARTITION BY plot) AS n FROM v),
q AS (SELECT user_id, CASE WHEN v IS NOT NULL THEN (r + (p - 1) / 2) / n END AS pct FROM r)
SELECT user_id, count(pct) AS n, count(*) FILTER (pct BETWEEN 0 AND 0.1) AS n_0, count(*) FILTER (pct > 0.4 AND pct <= 0.5) AS n_4, count(*) FILTER (pct > 0.9 AND pct <= 1) AS n_9,
round(100 * count(*) FILTER (pct > 0.9 AND pct <= 1) / count(pct), 4) AS pct_9 FROM q GROUP BY 1""")
def deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.decile_counts(_pool(spark, sf_dir), ["user_id"], "pct")
    return d.select("user_id", "n", "n_0", "n_4", "n_9", F.round("pct_9", 4).alias("pct_9"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS channel FROM orders) SELECT * FROM r""")
def yearly_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("o_custkey", F.year("o_orderdate")).orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("channel"))


@query("""SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 15""")
def top_fifteen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy(F.desc("total"), "o_custkey").limit(15)
