"""Plans of loops are cut by checkpoints, which other executors can read when one is lost; what is read often is kept as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

_own: list[str] = []


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the folder of ``spark.checkpoint.dir`` and read back, so that Spark knows their size; only a local master may go without one."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            import tempfile

            _own.append("file://" + tempfile.mkdtemp(prefix="terrasieve-"))
        base = _own[0]
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """The rows so far, in the folder of ``spark.checkpoint.dir``; only a local master may go without one."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            import tempfile

            base = "file://" + tempfile.mkdtemp(prefix="terrasieve-")
        sc.setCheckpointDir(base)
    return df.checkpoint(eager=True)
