"""Large matrices as tiles: a row is a square block of numbers, not one number.

``tiles(i, j, at, v)``: the block of rows ``i * size`` and columns ``j * size`` on, as the places
``at`` (row by row within the block) and values of its entries; what is missing is zero, so a
block costs what it holds. Blocks meet in an equi-join and are multiplied in Arrow batches,
which also add up what falls on one place of the product before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Pairs of entries that a task multiplies at a time: four dense pairs of blocks.
PAIRS = 1 << 20


def tiled(entries: DataFrame, size: int = 64, row: str = "row", column: str = "col", value: str = "v") -> DataFrame:
    """Tiles of a matrix given as entries; entries of one place are added."""
    at = (F.col(row) % size) * size + F.col(column) % size
    one = entries.select(F.floor(F.col(row) / size).cast("long").alias("i"), F.floor(F.col(column) / size).cast("long").alias("j"), at.cast("int").alias("at"), F.col(value).cast("double").alias("v"))
    return _gathered(one)


def _gathered(places: DataFrame) -> DataFrame:
    """Tiles from (i, j, at, v)."""
    one = places.groupBy("i", "j", "at").agg(F.sum("v").alias("v")).where("v is not null")
    # at most size * size numbers a block
    return one.groupBy("i", "j").agg(F.collect_list(F.struct("at", "v")).alias("e")).select("i", "j", F.col("e.at").alias("at"), F.col("e.v").alias("v"))


def entries(tiles: DataFrame, size: int = 64) -> DataFrame:
    """(row, col, v) of the numbers that are not zero."""
    flat = tiles.select("i", "j", F.explode(F.arrays_zip("at", "v")).alias("e")).select("i", "j", "e.*").where("v <> 0")
    return flat.select((F.col("i") * size + F.floor(F.col("at") / size)).alias("row"), (F.col("j") * size + F.col("at") % size).alias("col"), "v")


def transposed(tiles: DataFrame, size: int = 64) -> DataFrame:
    turned = F.transform("at", lambda a: ((a % size) * size + F.floor(a / size)).cast("int"))
    return tiles.select(F.col("j").alias("i"), F.col("i").alias("j"), turned.alias("at"), "v")


def _list(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which row each element of a list column is from, and the elements."""
    return pc.list_parent_indices(column).to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)


def _multiplied(batches: Iterator[pa.RecordBatch], size: int, most: int) -> Iterator[pa.RecordBatch]:
    """Products of joined blocks (i, j, a_at, a_v, b_at, b_v) as (i, j, at, v), added up by place for as many as come at a time."""
    for batch in batches:
        for start in range(0, len(batch), most):
            part = batch.slice(start, most)
            i, j = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
            (own, at), (_, av) = _list(part.column(2)), _list(part.column(3))
            (other, bt), (_, bv) = _list(part.column(4)), _list(part.column(5))
            # an entry of a in column k meets the entries of b in row k
            key = other * size + bt // size
            order = np.argsort(key, kind="stable")
            key, bt, bv = key[order], bt[order], bv[order]
            want = own * size + at % size
            first = np.searchsorted(key, want, "left")
            count = np.searchsorted(key, want, "right") - first
            for cut in np.split(np.arange(len(own)), np.flatnonzero(np.diff(np.cumsum(count) // PAIRS)) + 1):
                n = count[cut]
                a = np.repeat(cut, n)
                if not len(a):
                    continue
                b = np.repeat(first[cut], n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
                place = (at[a] // size) * size + bt[b] % size
                made = pd.DataFrame({"i": i[own[a]], "j": j[own[a]], "at": place.astype(np.int32), "v": av[a] * bv[b]})
                made = made.groupby(["i", "j", "at"], as_index=False, sort=False)["v"].sum()
                yield pa.RecordBatch.from_pandas(made, preserve_index=False)


def matmul(a: DataFrame, b: DataFrame, size: int = 64, most: int = 512) -> DataFrame:
    """Tiles of the product. A task multiplies at most ``most`` pairs of blocks at a time."""
    a = a.select("i", F.col("j").alias("k"), F.col("at").alias("a_at"), F.col("v").alias("a_v"))
    b = b.select(F.col("i").alias("k"), "j", F.col("at").alias("b_at"), F.col("v").alias("b_v"))
    met = a.join(b, "k").select("i", "j", "a_at", "a_v", "b_at", "b_v")
    return _gathered(met.mapInArrow(lambda it: _multiplied(it, size, most), "i long, j long, at int, v double"))
