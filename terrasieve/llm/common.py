"""What the text operators share: tables, the shared work folder, byte-level words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, every other byte as it is.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share; only a local master may go without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:  # unset in tests and in local mode only
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            import tempfile

            _own.append("file://" + tempfile.mkdtemp(prefix="terrasieve-"))
        base = _own[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors.

    The shuffle files of the write are let go at its end, where Spark can do that.
    """
    spark, done = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = work_path(spark, name), spark.conf.get(done, None)
    try:
        if before is not None:
            spark.conf.set(done, "true")
        df.write.options(**{"compression": "zstd"} | options).parquet(path)
    finally:
        if before is not None:
            spark.conf.set(done, before)
    return spark.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, found by exact name first, whatever else the table has."""
    names = df.columns
    lower = [x.lower() for x in names]
    at = [names.index(c) if c in names else lower.index(c.lower()) for c in columns]
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"c{i}").alias(c) for i, c in zip(at, columns)])


def shielded(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """docs with all but the needed columns renamed, so that none clashes with an operator's own, and what gives the names back.

    Columns that an operator adds come last and take the place of any of the same name.
    """
    names = docs.columns
    plain = [c if c in needed else f"_kept{i}" for i, c in enumerate(names)]

    def restore(df: DataFrame, *added: str) -> DataFrame:
        taken = {a.lower() for a in added}
        return df.select(*[F.col(p).alias(c) for p, c in zip(plain, names) if c.lower() not in taken], *added)

    return docs.toDF(*plain), restore


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes | None]:
    """The UTF-8 bytes of each text, one Python object at a time."""
    x = batch.column(column)
    for y in x.cast(pa.large_binary() if pa.types.is_large_string(x.type) else pa.binary()):
        yield y.as_py()


def crc_mod(column: str, n: int) -> Column:
    """crc32 of a column as text, modulo n; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
