"""Readers and writers of tables, and catalogues of files by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import with_quantiles
from ..operators.joins import not_done


#: What Spark decodes without a switch.
PLAIN_CHARSETS = ("us-ascii", "iso-8859-1", "utf-8", "utf-16be", "utf-16le", "utf-16", "utf-32")


def parquet(spark: SparkSession, path: str, *, glob: str | None = None) -> DataFrame:
    """Parquet files, or those whose name fits a pattern."""
    return (spark.read.option("pathGlobFilter", glob) if glob else spark.read).parquet(path)


def csv(spark: SparkSession, path: str, schema: str, *, encoding: str = "UTF-8", drop_first: bool = False) -> DataFrame:
    """CSV with a header in any encoding, e.g. windows-874; an unnamed index column can be dropped.

    Encodings beyond Spark's short list need its switch for Java charsets, which stays on for the session.
    """
    if encoding.lower() not in PLAIN_CHARSETS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    df = spark.read.option("header", True).option("encoding", encoding).schema(schema).csv(path)
    return df.select(df.columns[1:]) if drop_first else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_catalog(spark: SparkSession, path: str, pattern: str, names: Sequence[str], *, glob: str = "*") -> DataFrame:
    """Files below a folder with what a pattern finds in their paths; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length", "modificationTime")
    parts = [F.nullif(F.regexp_extract("path", pattern, i + 1), F.lit("")).alias(n) for i, n in enumerate(names)]
    return files.select("path", "length", "modificationTime", *parts).where(" and ".join(f"{n} is not null" for n in names))


def by_satellite(catalog: DataFrame, strip: str, satellite: str, both: str = "S1AB") -> DataFrame:
    """A strip's files of one satellite, or of both."""
    found = catalog.where(F.col("strip_id") == strip)
    return found if satellite == both else found.where(F.col("satellite") == satellite)


def band_day(name: Column | str) -> Column:
    """The first eight digits of a band name as a date."""
    return F.to_date(F.nullif(F.regexp_extract(F.col(name) if isinstance(name, str) else name, r"(\d{8})", 1), F.lit("")), "yyyyMMdd")


def small_files(catalog: DataFrame, by: Sequence[str], share: float = 0.025) -> DataFrame:
    """Files below a size quantile of their group."""
    return with_quantiles(catalog, by, "length", [share], "_low").where(F.col("length") < F.col("_low")[0]).drop("_low")


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """One folder a group; rows of a group meet first, split where a group is large."""
    df.hint("rebalance", *[F.col(c) for c in by]).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_missing(df: DataFrame, path: str, on: Sequence[str]) -> None:
    """Appends only keys that aren't there yet."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    (not_done(df, spark.read.parquet(path), on) if exists else df).write.mode("append").parquet(path)


def write_outcomes(df: DataFrame, path: str, outcome: Column) -> None:
    """One folder each for TP, TN, FP and FN."""
    write_partitioned(df.withColumn("outcome", outcome), path, ["outcome"])


def geojson(df: DataFrame, wkt: str, properties: Sequence[str]) -> DataFrame:
    """A feature a row as text, the outer rings of its polygon as they stand."""
    points = F.transform(F.split(F.regexp_extract(wkt, r"\(\(([^()]*)\)", 1), r"\s*,\s*"), lambda p: F.transform(F.split(F.trim(p), r"\s+"), lambda x: x.cast("double")))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), shape.alias("geometry"))).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; files as the partitions are."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A result a line as JSON."""
    df.write.mode("overwrite").json(path)


def stack_view(spark: SparkSession, frames: Sequence[DataFrame], name: str) -> DataFrame:
    """Rasters of a stack as one view by name; nothing is read or copied."""
    from ..operators.joins import stacked

    stacked(frames).createOrReplaceTempView(name)
    return spark.table(name)


def materialized(df: DataFrame, path: str) -> DataFrame:
    """A view written out and read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_year(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """Files of several years in the long layout, one below the other with their year."""
    from ..operators.joins import stacked

    return stacked([spark.read.parquet(p).withColumn("year", F.lit(y)) for y, p in sorted(paths.items())])
