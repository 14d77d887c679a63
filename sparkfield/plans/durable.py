"""Lineage cuts for iterative plans, in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

#: A saved table of more rows is never broadcast, however small its files are.
BROADCAST_ROWS = 20_000


def folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder stands in on a single machine (tests); on a
    cluster executors would not see it, so that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = sc.getConf().get("spark.checkpoint.dir")
        if not path and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="sparkfield-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """A checkpoint in ``folder``."""
    folder(df.sparkSession)
    return df.checkpoint()


def saved(df: DataFrame, instead: DataFrame | None = None) -> DataFrame:
    """``df`` as Parquet in ``folder``, for loops of many rounds; the table that it replaces is deleted.

    A checkpoint hands on what the optimiser estimated: sizes of joins are products, so their
    digits double with each round, and planning soon takes longer than the work. A table read
    again is as large as its files. Files of repeated values are far smaller than their rows in
    memory, though, so rows are counted on the way, and long tables are joined by sorting.
    """
    path = f"{folder(df.sparkSession)}/saved-{uuid.uuid4().hex}"
    written = Observation()
    df.observe(written, F.count(F.lit(1)).alias("n")).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if written.get["n"] > BROADCAST_ROWS:
        out = out.hint("merge")
    out._saved_at = path
    if instead is not None:
        discard(instead)
    return out


def discard(df: DataFrame) -> None:
    """Delete a saved table that nothing will read any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._saved_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
