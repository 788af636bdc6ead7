"""Long-form rasters: rows of (row, col, value), neighbours and grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import with_quantiles


def to_pixel(x: Column | str, y: Column | str, transform: Sequence[float]) -> tuple[Column, Column]:
    """(row, col) of a map coordinate under a geotransform (x0, dx, rx, y0, ry, dy): the affine inverse, floored."""
    x0, dx, rx, y0, ry, dy = transform
    u, v, det = F.col(x) - x0 if isinstance(x, str) else x - x0, F.col(y) - y0 if isinstance(y, str) else y - y0, dx * dy - rx * ry
    return F.floor((dx * v - ry * u) / det).cast("int"), F.floor((dy * u - rx * v) / det).cast("int")


def bounds(transform: Sequence[float], rows: int, cols: int) -> tuple[float, float, float, float]:
    """xmin, ymin, xmax, ymax."""
    x0, dx, rx, y0, ry, dy = transform
    xs = [x0 + c * dx + r * rx for c in (0, cols) for r in (0, rows)]
    ys = [y0 + c * ry + r * dy for c in (0, cols) for r in (0, rows)]
    return min(xs), min(ys), max(xs), max(ys)


def offsets(k: int) -> Column:
    """The k x k neighbourhood as an array of (dr, dc)."""
    h = k // 2
    return F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in range(-h, h + 1) for b in range(-h, h + 1)])


def neighbours(df: DataFrame, row: str, col: str, value: str, k: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Each pixel with count, sum and mean of the pixels known around it, itself included: each value goes to its neighbours once."""
    sent = df.select(*by, row, col, F.col(value).alias("_v"), F.inline(offsets(k)))
    got = sent.groupBy(*by, (F.col(row) + F.col("dr")).alias(row), (F.col(col) + F.col("dc")).alias(col)).agg(F.count("_v").alias("n"), F.sum("_v").alias("total"), F.max(F.when((F.col("dr") == 0) & (F.col("dc") == 0), F.col("_v"))).alias(value))
    return got.where(F.col(value).isNotNull()).withColumn("mean", F.col("total") / F.col("n"))


def mode_filter(df: DataFrame, row: str, col: str, flag: str, k: int = 3, ratio: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """1 where more than ratio of the other k * k - 1 pixels, itself counted in, are 1."""
    n = neighbours(df, row, col, flag, k, by)
    return n.select(*by, row, col, F.when(F.col("total") > (k * k - 1) * ratio, 1).otherwise(0).alias(flag))


def patches(df: DataFrame, row: str, col: str, flag: str, size: int, by: Sequence[str] = ()) -> DataFrame:
    """Patches of size x size without overlap, labelled 1 if any pixel is; pixels without data don't make one."""
    cell = [F.floor(F.col(c) / size).cast("int").alias(f"patch_{c}") for c in (row, col)]
    return df.where(F.col(flag).isNotNull()).groupBy(*by, *cell).agg(F.max(F.col(flag).cast("int")).alias("label"), F.count("*").alias("n_pixels"))


def tiles(df: DataFrame, row: str, col: str, label: str, size: int, stride: int, least: int) -> DataFrame:
    """Origins of size x size tiles at a stride that hold enough labelled pixels; a pixel names the tiles it lies in."""
    def origins(c: str) -> Column:
        last = F.floor(F.col(c) / stride).cast("int")
        first = F.greatest(F.lit(0), F.ceil((F.col(c) - size + 1) / stride).cast("int"))
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    marked = df.where(F.col(label) == 1).select(F.explode(origins(row)).alias("tile_row"), F.col(col))
    both = marked.select("tile_row", F.explode(origins(col)).alias("tile_col")).select((F.col("tile_row") * stride).alias("tile_row"), (F.col("tile_col") * stride).alias("tile_col"))
    return both.groupBy("tile_row", "tile_col").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def burn(cells: DataFrame, value: str, row: str = "row", col: str = "col") -> DataFrame:
    """Rasterised polygons: where several cover a pixel, the greatest value."""
    return cells.groupBy(row, col).agg(F.max(value).alias(value))


def equalized(df: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """Cumulative share of a value's bin: the look-up table of a histogram equalisation."""
    from .aggregates import cumulative_share

    return cumulative_share(df.groupBy(F.least(F.col(value), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n")), [], "bin", "n")


def defects(df: DataFrame, image: str, value: str) -> DataFrame:
    """Images without any value above zero."""
    return df.groupBy(image).agg(F.coalesce(F.max(value), F.lit(0)).alias("greatest")).where("greatest = 0").select(image)


def ratio_tier(a: Column, b: Column, low: float = 0.75, high: float = 1.25) -> Column:
    """1 where two areas agree, 2 below, 3 above."""
    r = F.try_divide(a, b)
    return F.when(r.between(low, high), 1).when(r < low, 2).when(r > high, 3)


def stretched(df: DataFrame, by: Sequence[str], value: str, name: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Values as shades 0 to 255 between two percentiles of their image."""
    x = (F.col(value) - F.col("_q")[0]) / F.nullif(F.col("_q")[1] - F.col("_q")[0], F.lit(0.0))
    return with_quantiles(df, by, value, [low, high], "_q").withColumn(name, F.floor(255 * F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))).cast("int")).drop("_q")
