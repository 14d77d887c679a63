"""Bitmap sink: frames written by the tasks that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_frames(frames: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ``frames(..., bytes)`` as Parquet with one bitmap per row, through Spark's own file system layer."""
    frames.write.mode(mode).parquet(path)
