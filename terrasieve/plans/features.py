"""Queries on features of plots and districts that combine several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import series as S
from ..functions.exprs import digitize
from ..operators import aggregates as A
from ..operators import geometry as G
from ..operators import sampling as P
from ..operators import timeseries as T
from ..operators import windows as V
from ..sources.tables import table
from .evaluation import _RECT, _plots
from .relational import DAYS, PLANTED, days, planted
from .season import DB, decibel, drops, runs

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


@query("""WITH y AS (SELECT o_custkey % 20 AS district, year(o_orderdate) AS y, sum(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS drought, sum(o_totalprice) FILTER (o_orderpriority = '2-HIGH') AS flood, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT district, round(avg(coalesce(drought, 0)) + 1e-9, 4) AS drought, round(avg(coalesce(flood, 0)) + 1e-9, 4) AS flood, count(*) FILTER (flood > 2000000) AS years_with_flood, CAST(sum(n) AS BIGINT) AS n FROM y GROUP BY 1""")
def cause_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_cause = lambda p: F.sum(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice")))
    y = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 20).alias("district"), F.year("o_orderdate").alias("y")).agg(by_cause("1-URGENT").alias("d"), by_cause("2-HIGH").alias("f"), F.count("*").alias("n"))
    zero = F.lit(0.0)
    return y.groupBy("district").agg(r4(F.avg(F.coalesce("d", zero)), "drought"), r4(F.avg(F.coalesce("f", zero)), "flood"), F.count_if(F.col("f") > 2000000).alias("years_with_flood"), F.sum("n").alias("n"))


@query("""WITH m AS (SELECT l_suppkey % 10 AS region, l_suppkey, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY mean DESC, l_suppkey) AS k FROM m) SELECT region, l_suppkey, mean FROM k WHERE k = 1""")
def district_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("region"), "l_suppkey").agg(F.round(F.avg("l_extendedprice"), 4).alias("mean"))
    best = F.min(F.struct((-F.col("mean")).alias("m"), "l_suppkey")).alias("b")
    return m.groupBy("region").agg(best).select("region", "b.l_suppkey", (-F.col("b.m")).alias("mean"))


@query(f"""WITH {DB}, {drops(7, 14, '2 * b.x - a.x')}, p AS (SELECT pixel, plot, max(x) FILTER (db.t = drops.t) AS bc, median(x) FILTER (db.t BETWEEN greatest(0, drops.t - 10) AND drops.t - 2) AS bg FROM db JOIN drops USING (plot) GROUP BY 1, 2)
SELECT plot, round(min(bc) + 1e-9, 4) AS bc_min, round(max(bc) + 1e-9, 4) AS bc_max, round(avg(bc) + 1e-9, 4) AS bc_mean, round(quantile_cont(bc, 0.25) + 1e-9, 4) AS bc_p25, round(quantile_cont(bc, 0.5) + 1e-9, 4) AS bc_p50, round(quantile_cont(bc, 0.75) + 1e-9, 4) AS bc_p75,
round(avg(bg) + 1e-9, 4) AS bg_mean, round(avg(bg - bc) + 1e-9, 4) AS fall_mean, round(quantile_cont(bg - bc, 0.75) + 1e-9, 4) AS fall_p75 FROM p GROUP BY 1""")
def pixel_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decibel(spark, sf_dir)
    at = d.join(T.sharp_drop(d, ["plot"], "ts", 7, 14).select("plot", "t"), "plot")
    p = at.select("plot", F.get("ts", F.col("t")).alias("bc"), S.background("ts", F.col("t"), 10).alias("bg")).withColumn("fall", F.col("bg") - F.col("bc"))
    r = T.rolled_up(p, ["plot"], ["bc", "bg", "fall"])
    return r.select("plot", *[r4(c, c) for c in ("bc_min", "bc_max", "bc_mean", "bc_p25", "bc_p50", "bc_p75", "bg_mean", "fall_mean", "fall_p75")])


@query(f"""WITH {DB}, r AS (SELECT pixel, plot, t, rank() OVER (PARTITION BY plot ORDER BY x) AS r, count(*) OVER (PARTITION BY plot, x) AS p, count(*) OVER (PARTITION BY plot) AS n FROM db),
q AS (SELECT pixel, '' AS th, t, CAST((r + (p - 1) / 2) / n < 0.2 AS INTEGER) AS f FROM r), {runs('f', 'q')} SELECT DISTINCT db.pixel, coalesce(run, 0) AS run FROM db LEFT JOIN longest USING (pixel)""")
def percentile_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decibel(spark, sf_dir).select("pixel", "plot", F.posexplode("ts").alias("t", "x"))
    ranked = V.percent_rank_avg(d, ["plot"], "x").select("pixel", "t", "pct")
    return T.to_series(ranked, ["pixel"], "t", "pct", 30).select("pixel", S.longest_run(S.under("ts", 0.2)).cast("long").alias("run"))


@query(f"""WITH {DB}, {PLANTED}, a AS (SELECT plot AS act, pixel, CAST(date_diff('day', DATE '2024-01-01', plant) AS INTEGER) AS at_t FROM planted)
SELECT act, round(coalesce(max(x) FILTER (t = at_t - 2), 0) + 1e-9, 4) AS w0, round(coalesce(max(x) FILTER (t = at_t), 0) + 1e-9, 4) AS w2, round(coalesce(max(x) FILTER (t = at_t + 1), 0) + 1e-9, 4) AS w3 FROM a LEFT JOIN db ON db.pixel = a.pixel GROUP BY act""")
def attach_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = planted(spark, sf_dir).select(F.col("plot").alias("act"), "pixel", F.datediff("plant", F.lit("2024-01-01")).alias("t"))
    w = T.window_at(decibel(spark, sf_dir).select("pixel", "ts"), a, ["pixel"], "t")
    return w.select("act", *[r4(F.col("window")[i], f"w{i}") for i in (0, 2, 3)])


@query(f"""WITH {DAYS}, {PLANTED}, d AS (SELECT plot, date_diff('day', plant, day) AS d, v FROM planted JOIN days USING (pixel) WHERE day >= plant),
o AS (SELECT plot, min(d) % 7 AS o FROM d GROUP BY 1), i AS (SELECT plot, CAST(round_even((d - o) / 7, 0) AS INTEGER) AS i, v FROM d JOIN o USING (plot))
SELECT plot, i, round(avg(v) + 1e-9, 4) AS v FROM i WHERE i BETWEEN 0 AND 4 GROUP BY 1, 2""")
def day_index_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = planted(spark, sf_dir).join(days(spark, sf_dir), "pixel")
    s = T.by_day_index(p, ["plot"], "day", "plant", "v", 7, 5).select("plot", F.posexplode("ts").alias("i", "v"))
    return s.where("v is not null").select("plot", "i", r4("v", "v"))


@query(f"""WITH {DB}, {drops(7, 14, '2 * b.x - a.x')}, c AS (SELECT plot, db.t - drops.t AS distance, avg(x) AS mean FROM db JOIN drops USING (plot) WHERE abs(db.t - drops.t) <= 5 GROUP BY 1, 2)
SELECT plot, distance, round(mean + 1e-9, 4) AS mean, round(coalesce(mean - lag(mean) OVER (PARTITION BY plot ORDER BY distance), 0) + 1e-9, 4) AS change FROM c""")
def event_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decibel(spark, sf_dir)
    at = d.join(T.sharp_drop(d, ["plot"], "ts", 7, 14).select("plot", "t"), "plot")
    c = T.event_curve(at, ["plot"], "ts", "t", 5)
    return c.select("plot", F.col("distance").cast("long").alias("distance"), r4("mean", "mean"), r4(F.coalesce("change", F.lit(0.0)), "change"))


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type FROM events) SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n, round(avg(user_id % 10) + 1e-9, 4) AS mean FROM d GROUP BY 1""")
def daily_mean_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type").dropDuplicates()
    return d.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), r4(F.avg(F.col("user_id") % 10), "mean"))


@query("""WITH e AS (SELECT quantile_cont(l_extendedprice, 0.1) AS a, quantile_cont(l_extendedprice, 0.9) AS b, quantile_cont(l_extendedprice, 0.95) AS c FROM lineitem),
k AS (SELECT CAST(l_extendedprice >= a AS INTEGER) + CAST(l_extendedprice >= b AS INTEGER) + CAST(l_extendedprice >= c AS INTEGER) AS bucket, l_orderkey FROM lineitem, e), d AS (SELECT DISTINCT bucket, l_orderkey FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('5:' || l_orderkey), l_orderkey) AS r FROM d) SELECT bucket, l_orderkey FROM r WHERE r <= 20""")
def hard_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    found = A.exact_quantiles(li, [], "l_extendedprice", [0.1, 0.9, 0.95]).first()
    edges = found["q"] if found and found["q"][0] is not None else [0.0] * 3
    d = li.select(digitize("l_extendedprice", edges).alias("bucket"), "l_orderkey").distinct()
    return P.cap_per_class(d, ["bucket"], ["l_orderkey"], 20, seed=5)


@query(f"""WITH {DAYS}, {PLANTED}, r AS (SELECT plot, pixel, plant FROM planted), j AS (SELECT plot, max(CAST(v > 120 AS INTEGER)) AS any_flood FROM r JOIN days USING (pixel) WHERE abs(day - plant) <= 3 GROUP BY 1)
SELECT plot % 100 AS district, count(*) AS n, round(avg(any_flood) + 1e-9, 4) AS ratio FROM j GROUP BY 1""")
def predicted_loss_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = planted(spark, sf_dir).select("plot", "pixel", F.col("plant").alias("at"))
    maps = days(spark, sf_dir).select("pixel", "day", (F.col("v") > 120).alias("flag"))
    found = T.any_flood_near(reports, maps, ["pixel"], "at", "day", "flag", 3)
    return found.groupBy((F.col("plot") % 100).alias("district")).agg(F.count("*").alias("n"), r4(F.avg("any_flood"), "ratio"))


@query("""WITH s AS (SELECT o_custkey % 20 AS district, CAST(min(o_orderdate) AS DATE) AS first, CAST(max(o_orderdate) AS DATE) AS last FROM orders GROUP BY 1),
d AS (SELECT district, first, last, unnest(range(0, date_diff('day', first, last) // 6 + 1)) AS i FROM s)
SELECT district, strftime(first + CAST(i * 6 AS INTEGER), '%Y-%m-%d') AS day, CASE WHEN i % 2 = 0 THEN 'A' ELSE 'B' END AS satellite FROM d""")
def two_satellites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days on which two satellites in turn pass over each district, from its first order to its last."""
    o = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 20).alias("district")).agg(F.to_date(F.min("o_orderdate")).alias("first"), F.to_date(F.max("o_orderdate")).alias("last"))
    d = o.select("district", F.inline(T.two_satellites(F.col("first"), F.col("last"))))
    return d.select("district", F.col("day").cast("string").alias("day"), "satellite")


@query(f"""WITH {_RECT}, d AS (SELECT i.i * 8 + j.j AS district, i.i * 300.0 - 0.5 AS dx, j.j * 100.0 - 0.5 AS dy FROM range(7) i(i), range(8) j(j))
SELECT plot, district FROM p JOIN d ON x >= dx AND x + w <= dx + 300 AND y >= dy AND y + h <= dy + 100""")
def polygon_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.related(_plots(spark, sf_dir).select("plot", "wkt"), _districts(spark), "wkt", "area", 128.0, within=True).select("plot", "district")


@query(f"""WITH {_RECT}, d AS (SELECT i.i * 8 + j.j AS district, i.i * 300.0 - 0.5 AS dx, j.j * 100.0 - 0.5 AS dy FROM range(7) i(i), range(8) j(j))
SELECT plot, district FROM p JOIN d ON x < dx + 300 AND x + w > dx AND y < dy + 100 AND y + h > dy""")
def polygon_intersects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.related(_plots(spark, sf_dir).select("plot", "wkt"), _districts(spark), "wkt", "area", 128.0, within=False).select("plot", "district")


def _districts(spark: SparkSession) -> DataFrame:
    """A grid of 7 x 8 rectangles."""
    d = spark.range(56).select(F.col("id").alias("district"), (F.floor(F.col("id") / 8) * 300.0 - 0.5).alias("x"), (F.col("id") % 8 * 100.0 - 0.5).alias("y"))
    corner = [F.expr(e) for e in ("x", "y", "x + 300", "y", "x + 300", "y + 100", "x", "y + 100", "x", "y")]
    return d.select("district", F.format_string("POLYGON ((%s %s, %s %s, %s %s, %s %s, %s %s))", *corner).alias("area"))
