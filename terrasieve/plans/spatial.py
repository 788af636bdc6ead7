"""Queries over polygons that others cover, and over arrays that are gathered by place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import coverage as C
from ..sources.tables import table
from .evaluation import _RECT, _plots
from .relational import DAYS, PLANTED, days, planted

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: A tile for each nation, five by five; tiles of a region often touch, and none overlap.
_TILES = "t AS (SELECT n_nationkey, n_regionkey, n_nationkey % 5 * 400.0 AS tx, n_nationkey // 5 * 150.0 AS ty FROM nation)"
_SHARED = "greatest(0, least(x + w, tx + 400) - greatest(x, tx)) * greatest(0, least(y + h, ty + 150) - greatest(y, ty))"


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", (F.col("n_nationkey") % 5 * 400.0).alias("x"), (F.floor(F.col("n_nationkey") / 5) * 150.0).alias("y"))
    corner = [F.expr(e) for e in ("x", "y", "x + 400", "y", "x + 400", "y + 150", "x", "y + 150", "x", "y")]
    return n.select("n_nationkey", "n_regionkey", F.format_string("POLYGON ((%s %s, %s %s, %s %s, %s %s, %s %s))", *corner).alias("tile"))


@query(f"""WITH {_RECT}, {_TILES}, c AS (SELECT plot, n_regionkey, any_value(w * h) AS area, sum({_SHARED}) AS covered FROM p, t GROUP BY 1, 2)
SELECT plot, n_regionkey, round(covered / area, 4) AS share, covered >= area * (1 - 1e-9) AS is_within FROM c WHERE covered > 0""")
def within_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plots within the union of a region's tiles, though within none of them."""
    c = C.covered_by_union(_plots(spark, sf_dir), _tiles(spark, sf_dir), "plot", "wkt", "n_regionkey", "tile", 128.0)
    return c.select("plot", "n_regionkey", F.round(F.col("covered") / F.col("area"), 4).alias("share"), "is_within")


@query(f"""WITH {_RECT}, {_TILES}, c AS (SELECT plot, n_nationkey, {_SHARED} / (w * h) AS share FROM p, t)
SELECT p.plot, min(n_nationkey) AS n_nationkey FROM p LEFT JOIN c ON c.plot = p.plot AND share >= 1 - 1e-9 GROUP BY 1""")
def containing_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tile that contains each plot, null where none does."""
    return C.best_container(_plots(spark, sf_dir), _tiles(spark, sf_dir), "plot", "n_nationkey", "wkt", "tile", 128.0).select("plot", "n_nationkey")


@query(f"""WITH {_RECT}, {_TILES}, c AS (SELECT plot, n_nationkey, round({_SHARED} / (w * h), 9) AS share FROM p, t)
SELECT p.plot, arg_max(n_nationkey, [share, -n_nationkey]) AS n_nationkey, round(max(share), 4) AS share FROM p LEFT JOIN c ON c.plot = p.plot AND share > 0 GROUP BY 1""")
def largest_share_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tile that covers most of each plot."""
    best = C.best_container(_plots(spark, sf_dir), _tiles(spark, sf_dir), "plot", "n_nationkey", "wkt", "tile", 128.0, whole=False)
    return best.select("plot", "n_nationkey", F.round("share", 4).alias("share"))


@query(f"""WITH {_RECT}, g AS (SELECT l_partkey % 40 AS r, l_suppkey % 60 AS c, round(avg(l_quantity), 4) AS value FROM lineitem GROUP BY 1, 2)
SELECT plot, value FROM p LEFT JOIN g ON g.c = CAST(floor((x + w / 2) / 36) AS BIGINT) AND g.r = CAST(floor((1440 - y - h / 2) / 36) AS BIGINT)""")
def coarse_value_at_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a raster of 36 by 36 pixels, its first row at the top, has at the centroid of each plot."""
    g = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 40).alias("row"), (F.col("l_suppkey") % 60).alias("col")).agg(F.round(F.avg("l_quantity"), 4).alias("value"))
    return C.at_centroid(_plots(spark, sf_dir), "plot", "wkt", g, (0.0, 36.0, 0.0, 1440.0, 0.0, -36.0))


@query(f"""WITH {DAYS}, {PLANTED} SELECT plot, count(v) AS n, round(sum(v) + 1e-9, 4) AS total, round(arg_min(v, day) + 1e-9, 4) AS first_v, round(max(v) FILTER (day = plant) + 1e-9, 4) AS at_plant FROM planted LEFT JOIN days ON days.pixel = planted.pixel GROUP BY 1""")
def block_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each plot's series out of an array of days, rows and columns that is stored in blocks."""
    place = lambda c: [F.floor(F.col(c) / 16).cast("int").alias("row"), (F.col(c) % 16).cast("int").alias("col")]
    cube = days(spark, sf_dir).select(F.unix_date("day").alias("layer"), *place("pixel"), "v")
    asked = planted(spark, sf_dir).select("plot", F.unix_date("plant").alias("plant"), *place("pixel"))
    found = B.gathered(asked, B.as_blocks(cube, "layer", "row", "col", "v", 8), "row", "col", 8)
    known = F.filter("series", lambda s: s["value"].isNotNull())
    total = F.aggregate("known", F.lit(0.0), lambda a, s: a + s["value"])
    at = F.filter("known", lambda s: s["layer"] == F.col("plant"))
    k = found.withColumn("known", F.coalesce(known, F.expr("cast(array() as array<struct<layer: bigint, value: double>>)")))
    r4 = lambda c, name: F.round(c + 1e-9, 4).alias(name)
    return k.select("plot", F.size("known").cast("long").alias("n"), r4(F.when(F.size("known") > 0, total), "total"), r4(F.try_element_at("known", F.lit(1))["value"], "first_v"), r4(F.try_element_at(at, F.lit(1))["value"], "at_plant"))
