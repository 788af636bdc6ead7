"""Queries on rows, filters and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import aggregates as A
from ..operators import raster as R
from ..operators import sampling as P
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


def r4(c, name: str):
    return F.round(c, 4).alias(name)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS net
FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag = 'R'""")
def scan_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").where(F.col("l_quantity").between(10, 20) & (F.col("l_returnflag") == "R"))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", r4(F.col("l_extendedprice") * (1 - F.col("l_discount")), "net"))


@query("""WITH d AS (SELECT l_orderkey, l_suppkey, l_linenumber, CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_partkey % 5 = 0 THEN 0 ELSE l_discount * l_quantity END AS a,
  CASE WHEN l_partkey % 11 = 0 THEN 0 ELSE l_quantity END AS b FROM lineitem),
r AS (SELECT *, CASE WHEN a IS NULL OR b IS NULL OR (a = 0 AND b = 0) THEN 0 WHEN b = 0 THEN NULL ELSE a / b END AS ratio FROM d)
SELECT l_orderkey, l_suppkey, l_linenumber, round(ratio, 4) AS loss_ratio FROM r WHERE ratio >= 0 AND ratio <= 1 AND NOT (l_linenumber = 1 AND ratio = 0)""")
def safe_loss_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    a = F.when(k % 7 == 0, None).when(k % 5 == 0, 0.0).otherwise(F.col("l_discount") * F.col("l_quantity"))
    b = F.when(k % 11 == 0, 0.0).otherwise(F.col("l_quantity"))
    d = table(spark, sf_dir, "lineitem").withColumn("ratio", X.safe_ratio(a, b)).where(F.col("ratio").between(0, 1))
    kept = d.where(~((F.col("l_linenumber") == 1) & (F.col("ratio") == 0)))
    return kept.select("l_orderkey", "l_suppkey", "l_linenumber", r4("ratio", "loss_ratio"))


@query("""WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS p, o_totalprice FROM orders)
SELECT o_orderkey, CASE WHEN p IN ('1-URGENT') THEN 'Drought' WHEN p IN ('2-HIGH', '3-MEDIUM') THEN 'Flood' WHEN p IS NULL THEN 'Normal' ELSE 'Other' END AS cause,
CAST(o_totalprice != 0 AS INTEGER) AS has_loss FROM d""")
def recode_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").withColumn("p", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")))
    cause = X.recode("p", {"Drought": ["1-URGENT"], "Flood": ["2-HIGH", "3-MEDIUM"]}, "Other", "Normal")
    return d.select("o_orderkey", cause.alias("cause"), (F.col("o_totalprice") != 0).cast("int").alias("has_loss"))


@query("""WITH d AS (SELECT *, CAST(l_quantity >= 10 AS INTEGER) + CAST(l_quantity >= 20 AS INTEGER) + CAST(l_quantity >= 30 AS INTEGER) AS bin FROM lineitem)
SELECT bin, count(*) AS n FROM d GROUP BY bin""")
def digitize_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(X.digitize("l_quantity", (10, 20, 30)).alias("bin")).agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT *, CAST(l_discount * 10 > 0 AS INTEGER) + CAST(l_discount * 10 > 0.25 AS INTEGER) + CAST(l_discount * 10 > 0.5 AS INTEGER) + CAST(l_discount * 10 > 0.75 AS INTEGER) AS bin FROM lineitem)
SELECT bin, count(*) AS n FROM d GROUP BY bin""")
def digitize_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(X.loss_class(F.col("l_discount") * 10).alias("bin")).agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT CAST((l_orderkey * 37 + l_partkey * 11) % 65536 AS INTEGER) AS qa FROM lineitem),
f AS (SELECT qa, (qa >> 4) & 1 AS cloud, (qa >> 5) & 3 AS cloud_confidence, (qa >> 7) & 3 AS shadow, (qa >> 9) & 3 AS snow, (qa >> 11) & 3 AS cirrus FROM d)
SELECT cloud, cloud_confidence, shadow, snow, cirrus, cloud = 1 OR snow = 3 OR shadow = 3 AS masked, count(*) AS n FROM f GROUP BY ALL""")
def bitfield_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    qa = ((F.col("l_orderkey") * 37 + F.col("l_partkey") * 11) % 65536).cast("int")
    d = table(spark, sf_dir, "lineitem").select(qa.alias("qa"))
    fields = [X.bit_field("qa", *v).alias(k) for k, v in X.QA_FIELDS.items()]
    return d.select(*fields, X.cloud_mask("qa").alias("masked")).groupBy(*X.QA_FIELDS, "masked").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT l_suppkey, CASE WHEN l_linenumber = 1 THEN 0 ELSE l_discount END AS nir, CASE WHEN l_linenumber = 1 THEN 0 ELSE l_tax END AS red FROM lineitem)
SELECT l_suppkey, round(avg(CASE WHEN nir + red = 0 THEN 0 ELSE (nir - red) / (nir + red) END), 4) AS index_mean FROM d GROUP BY l_suppkey""")
def norm_diff_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    hide = lambda c: F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.col(c))
    d = table(spark, sf_dir, "lineitem").groupBy("l_suppkey")
    return d.agg(r4(F.avg(X.normalized_difference(hide("l_discount"), hide("l_tax"))), "index_mean"))


@query("""SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders WHERE month(o_orderdate) BETWEEN 5 AND 10 AND year(o_orderdate) IN (1996, 1998) GROUP BY ALL""")
def season_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").where(X.in_season("o_orderdate") & F.year("o_orderdate").isin(1996, 1998))
    return d.groupBy(F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("m")).agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.001) AS lo, quantile_cont(l_extendedprice, 0.999) AS hi FROM lineitem GROUP BY 1)
SELECT l_returnflag, count(*) AS n, round(min(l_extendedprice), 4) AS least, round(max(l_extendedprice), 4) AS greatest FROM lineitem JOIN q USING (l_returnflag)
WHERE l_extendedprice BETWEEN lo AND hi GROUP BY l_returnflag""")
def quantile_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.quantile_trim(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice")
    return d.groupBy("l_returnflag").agg(F.count("*").alias("n"), r4(F.min("l_extendedprice"), "least"), r4(F.max("l_extendedprice"), "greatest"))


@query("""WITH s AS (SELECT l_suppkey, var_pop(l_quantity) AS v, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_suppkey, count(*) AS n FROM lineitem JOIN s USING (l_suppkey) WHERE v > 205 AND s.n >= 10 GROUP BY 1""")
def group_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.group_spread(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity"), ["l_suppkey"], "l_quantity", 205)
    return V.group_size(d, ["l_suppkey"], 10).groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("""SELECT l_returnflag, l_linestatus, round(min(l_quantity), 4) AS q_min, round(max(l_quantity), 4) AS q_max, round(avg(l_quantity), 4) AS q_mean,
round(quantile_cont(l_quantity, 0.05), 4) AS q_p5, round(quantile_cont(l_quantity, 0.1), 4) AS q_p10, round(quantile_cont(l_quantity, 0.25), 4) AS q_p25, round(quantile_cont(l_quantity, 0.5), 4) AS q_p50,
round(quantile_cont(l_quantity, 0.75), 4) AS q_p75, round(quantile_cont(l_quantity, 0.9), 4) AS q_p90, round(quantile_cont(l_quantity, 0.95), 4) AS q_p95, round(count(*) FILTER (l_quantity = 1) / count(*), 4) AS q_ratio
FROM lineitem GROUP BY 1, 2""")
def stat_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("q"))
    s = A.stat_pack(d, ["l_returnflag", "l_linestatus"], ["q"])
    return s.select("l_returnflag", "l_linestatus", *[r4(c, c) for c in s.columns[2:]])


#: 242 features of an order, some of them null, and one that is mostly ones.
_FEATURE = "CASE WHEN (o_orderkey + k) % 11 = 0 THEN NULL WHEN k % 40 = 0 THEN CAST(o_custkey % (k + 2) < 2 AS INTEGER) ELSE CAST((o_orderkey * 37 * (k + 1) + o_custkey * k) % 1009 AS DOUBLE) - 20 END"


@query(f"""WITH d AS (SELECT o_custkey % 20 AS district, k, {_FEATURE} AS v FROM orders, range(242) r(k))
SELECT district, 'x' || k AS feature, round(min(v), 4) AS v_min, round(max(v), 4) AS v_max, round(avg(v), 4) AS v_mean, round(quantile_cont(v, 0.05), 4) AS p5, round(quantile_cont(v, 0.1), 4) AS p10, round(quantile_cont(v, 0.25), 4) AS p25,
round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.75), 4) AS p75, round(quantile_cont(v, 0.9), 4) AS p90, round(quantile_cont(v, 0.95), 4) AS p95, round(count(*) FILTER (v = 1) / count(*), 4) AS ratio FROM d GROUP BY 1, k""")
def district_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics of 242 columns by district, their quantiles selected together."""
    o = table(spark, sf_dir, "orders")
    names = [f"x{k}" for k in range(242)]
    wide = o.select((F.col("o_custkey") % 20).alias("district"), *[F.expr(_FEATURE.replace("(k + 2)", str(k + 2)).replace("(k + 1)", str(k + 1)).replace("k % 40", str(k % 40)).replace("+ k)", f"+ {k})").replace("* k)", f"* {k})")).cast("double").alias(f"x{k}") for k in range(242)])
    s = A.column_stats(wide, ["district"], names)
    return s.select("district", F.col("column").alias("feature"), *[r4(c, f"v_{c}") for c in ("min", "max", "mean")], *[r4(c, c) for c in ("p5", "p10", "p25", "p50", "p75", "p90", "p95", "ratio")])


@query("""WITH o AS (SELECT o_custkey % 20 AS district, year(o_orderdate) AS y, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS a, sum(o_totalprice) AS b FROM orders GROUP BY 1, 2)
SELECT district, round(avg(a / b), 4) AS share, count(a / b) AS n FROM o GROUP BY 1""")
def two_level_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("district"), F.year("o_orderdate").alias("y"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("a"), F.col("o_totalprice").alias("b"))
    return A.two_level_mean(d, ["district"], ["y"], "a", "b", "share").select("district", r4("share", "share"), "n")


@query("""WITH s AS (SELECT n AS size, count(*) AS keys FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1)
SELECT size, keys, round(sum(keys) OVER (ORDER BY size) / sum(keys) OVER (), 4) AS share FROM s""")
def size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.size_histogram(table(spark, sf_dir, "lineitem"), ["l_orderkey"]).select("size", "keys", r4("share", "share"))


@query("""SELECT concat_ws('_', l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR)) AS code, count(*) AS n FROM lineitem GROUP BY 1""")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.concat_ws("_", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("code")).agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT l_returnflag, CAST(CASE WHEN l_extendedprice < 0 THEN 0 WHEN l_extendedprice >= 100000 THEN 51 ELSE floor(l_extendedprice / 2000) + 1 END AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, bin, n, round(sum(n) OVER (PARTITION BY l_returnflag ORDER BY bin) / sum(n) OVER (PARTITION BY l_returnflag), 4) AS share FROM b""")
def ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ecdf(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 0, 100_000, 50).select("l_returnflag", "bin", "n", r4("share", "share"))


@query("""WITH d AS (SELECT o_custkey % 50 AS district, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 5 END AS x FROM orders),
n AS (SELECT district, x, count(*) AS n FROM d WHERE x != 0 GROUP BY 1, 2)
SELECT district, CAST(arg_min(x, (-n) * 1000 + x) AS BIGINT) AS mode_nonzero FROM n GROUP BY 1""")
def mode_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    d = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("district"), F.when(k % 3 == 0, 0).otherwise(k % 5).alias("x"))
    return d.groupBy("district").agg(A.smallest_mode(F.nullif("x", F.lit(0))).cast("long").alias("mode_nonzero"))


@query("""WITH n AS (SELECT user_id % 5 AS plot, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT plot, event_type, n, round(n / sum(n) OVER (PARTITION BY plot), 4) AS share FROM n""")
def class_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("plot"), "event_type")
    return A.class_share(d, ["plot"], "event_type").select("plot", "event_type", "n", r4("share", "share"))


@query("""SELECT user_id, count(*) FILTER (value > 20) AS n_valid, count(*) FILTER (value > 20) > 0.7 * 60 AS valid FROM events GROUP BY 1""")
def valid_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select("user_id", (F.col("value") - 20).alias("v"))
    return A.valid_mask(d, ["user_id"], "v", 60)


@query("""SELECT user_id, CAST(max(CAST(event_type = 'error' AND value > 150 AS INTEGER)) AS INTEGER) AS any_flag FROM events GROUP BY 1""")
def union_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.union_mask(table(spark, sf_dir, "events"), ["user_id"], (F.col("event_type") == "error") & (F.col("value") > 150))


@query("""WITH c AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS qe, abs(corr(l_quantity, l_discount)) AS qd, abs(corr(l_quantity, l_tax)) AS qt, abs(corr(l_extendedprice, l_discount)) AS ed, abs(corr(l_extendedprice, l_tax)) AS et, abs(corr(l_discount, l_tax)) AS dt FROM lineitem)
SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(qe, 4) AS r FROM c UNION ALL SELECT 'l_quantity', 'l_discount', round(qd, 4) FROM c UNION ALL SELECT 'l_quantity', 'l_tax', round(qt, 4) FROM c
UNION ALL SELECT 'l_extendedprice', 'l_discount', round(ed, 4) FROM c UNION ALL SELECT 'l_extendedprice', 'l_tax', round(et, 4) FROM c UNION ALL SELECT 'l_discount', 'l_tax', round(dt, 4) FROM c""")
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).select("a", "b", r4("r", "r"))


_KDE = """{n}s AS (SELECT count(*) AS n, stddev_samp(l_quantity) * pow(count(*), -0.2) AS h FROM lineitem WHERE l_returnflag = '{f}'),
{n}v AS (SELECT l_quantity AS v, count(*) AS w FROM lineitem WHERE l_returnflag = '{f}' GROUP BY 1),
{n} AS (SELECT i, sum(w * exp(-0.5 * pow((51.0 * i / 199 - v) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS d FROM {n}v, {n}s, range(200) r(i) GROUP BY i)"""


@query("WITH " + _KDE.format(n="p", f="A") + ", " + _KDE.format(n="q", f="N") + """,
b AS (SELECT p.i, p.d AS p, q.d AS q FROM p JOIN q USING (i)), m AS (SELECT min(least(p, q)) AS lo, max(greatest(p, q)) AS hi FROM b),
s AS (SELECT 1 + (p - lo) / (hi - lo) AS p, 1 + (q - lo) / (hi - lo) AS q FROM b, m), t AS (SELECT sum(p) AS sp, sum(q) AS sq FROM s)
SELECT round(sum((p / sp) * ln((p / sp) / (q / sq)) + (q / sq) * ln((q / sq) / (p / sp))), 6) AS kl FROM s, t""")
def kde_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    p, q = (A.kde(d.where(F.col("l_returnflag") == f), "l_quantity", 0, 51, 200) for f in ("A", "N"))
    return A.symmetric_kl(p, q).select(F.round("kl", 6).alias("kl"))


@query("""WITH b AS (SELECT user_id % 5 AS plot, floor(value / (300 / 4096.0)) + 1 AS bin, count(*) AS n FROM events WHERE value >= 0 AND value < 300 GROUP BY 1, 2),
x AS (SELECT *, (bin - 0.5) * 300 / 4096.0 AS x FROM b),
s AS (SELECT plot, bin, sum(n) OVER r AS n0, sum(n) OVER w AS nn, sum(n * x) OVER r AS s0, sum(n * x) OVER w AS ss FROM x WINDOW w AS (PARTITION BY plot), r AS (PARTITION BY plot ORDER BY bin)),
v AS (SELECT plot, bin, n0 * (nn - n0) * pow(s0 / n0 - (ss - s0) / nullif(nn - n0, 0), 2) AS v FROM s),
k AS (SELECT plot, bin, row_number() OVER (PARTITION BY plot ORDER BY round(v, 6) DESC, bin) AS k FROM v WHERE v IS NOT NULL)
SELECT plot, round(least(bin * 300 / 4096.0, 200), 4) AS threshold FROM k WHERE k = 1""")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("plot"), "value")
    return A.otsu(d, ["plot"], "value", 0, 300, 4096, 200.0).select("plot", r4("threshold", "threshold"))


@query("""SELECT o_orderkey, o_orderkey % 10 IN (8, 9) AS held_out FROM orders""")
def mod10_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", X.in_split("o_orderkey", (8, 9)).alias("held_out"))


@query("""WITH k AS (SELECT DISTINCT o_orderstatus, o_custkey FROM orders WHERE o_totalprice > 200000), s AS (SELECT o_orderstatus, count(*) AS n FROM k GROUP BY 1), m AS (SELECT min(n) AS least FROM s),
r AS (SELECT o_orderstatus, o_custkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('0:' || o_custkey), o_custkey) AS r FROM k)
SELECT o_orderstatus, o_custkey FROM r, m WHERE r <= least""")
def balanced_sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select("o_orderstatus", "o_custkey")
    return P.balanced(d, "o_orderstatus", ["o_custkey"]).distinct()


@query("""WITH r AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('3:' || o_orderkey), o_orderkey) AS r FROM orders) SELECT o_orderpriority, o_orderkey FROM r WHERE r <= 25""")
def cap_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cap_per_class(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], ["o_orderkey"], 25, seed=3)


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderkey) AS r FROM orders) SELECT o_custkey, o_orderkey, o_orderstatus FROM r WHERE r = 1""")
def priority_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return P.first_by_priority(d, ["o_custkey"], [F.when(F.col("o_orderstatus") == "F", 0).otherwise(1), F.col("o_orderkey")])


_GRID = "g AS (SELECT l_partkey % 60 AS r, l_suppkey % 60 AS c, max(CAST(l_returnflag = 'R' AS INTEGER)) AS v FROM lineitem GROUP BY 1, 2)"


@query("WITH " + _GRID + """, n AS (SELECT a.r, a.c, sum(b.v) AS total FROM g a JOIN g b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY 1, 2)
SELECT r, c, CAST(total > 4 AS INTEGER) AS v FROM n""")
def mode_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mode_filter(_grid(spark, sf_dir), "r", "c", "v")


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 60).alias("r"), (F.col("l_suppkey") % 60).alias("c"))
    return d.agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("v"))


@query("WITH " + _GRID + """ SELECT a.r, a.c, a.v, count(*) AS n, CAST(sum(b.v) AS BIGINT) AS total, round(sum(b.v) / count(*), 4) AS mean FROM g a JOIN g b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY 1, 2, 3""")
def neighbour_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.neighbours(_grid(spark, sf_dir), "r", "c", "v").select("r", "c", "v", "n", "total", r4("mean", "mean"))


@query("WITH " + _GRID + """ SELECT CAST(floor(r / 8) AS INTEGER) AS patch_r, CAST(floor(c / 8) AS INTEGER) AS patch_c, max(v) AS label, count(*) AS n_pixels FROM g GROUP BY 1, 2""")
def label_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.patches(_grid(spark, sf_dir), "r", "c", "v", 8)


@query("WITH " + _GRID + """, t AS (SELECT i.i * 4 AS tile_row, j.j * 4 AS tile_col FROM range(15) i(i), range(15) j(j))
SELECT tile_row, tile_col, count(*) AS n FROM t JOIN g ON v = 1 AND r BETWEEN tile_row AND tile_row + 7 AND c BETWEEN tile_col AND tile_col + 7 GROUP BY 1, 2 HAVING count(*) >= 20""")
def label_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = R.tiles(_grid(spark, sf_dir), "r", "c", "v", 8, 4, 20)
    return t.select(F.col("tile_row").cast("long").alias("tile_row"), F.col("tile_col").cast("long").alias("tile_col"), "n")


@query("""WITH d AS (SELECT (l_discount * 10 + 0.01) / 1.2 AS p, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem)
SELECT y, count(*) AS n, round(avg(-y * ln(p) - (1 - y) * ln(1 - p)), 4) AS loss, round(avg(1 / (1 + exp(-p))), 4) AS sigmoid FROM d GROUP BY y""")
def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(((F.col("l_discount") * 10 + 0.01) / 1.2).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return d.groupBy("y").agg(F.count("*").alias("n"), r4(F.avg(X.cross_entropy("y", "p")), "loss"), r4(F.avg(X.sigmoid("p")), "sigmoid"))


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS plant FROM orders), h AS (SELECT *, make_date(year(plant), 11, 20) AS same FROM d)
SELECT o_orderkey, strftime(CASE WHEN same < plant THEN same + INTERVAL 1 YEAR ELSE same END, '%Y-%m-%d') AS harvest FROM h""")
def harvest_by_daylength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", X.harvest_date(F.to_date("o_orderdate"), F.lit("11-20")).cast("string").alias("harvest"))


@query("""SELECT user_id, event_type, count(*) AS n_rows, count(*) FILTER (value IS NULL OR user_id % 7 = 0) AS n_all_null FROM events GROUP BY 1, 2""")
def stage_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("user_id") % 7 != 0, F.col("value")))
    return A.reconcile(d, ["user_id", "event_type"], ["v", "v"])
