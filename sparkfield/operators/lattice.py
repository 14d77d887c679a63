"""Grids of any number of axes, on one linear index.

A cell is its place in row-major order; a neighbour along an axis is a stride away. Stencils
are shifted equi-joins in the form of sums: every cell hands its value to the places that need
it, once, so that one shuffle serves all axes, whatever their number.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Lattice:
    """``shape`` points a side with ``spacing`` between them, from ``origin`` (zero by default)."""

    shape: tuple[int, ...]
    spacing: tuple[float, ...]
    origin: tuple[float, ...] | None = None

    def __post_init__(self):
        if not self.shape or len(self.shape) != len(self.spacing) or min(self.shape) < 1:
            raise ValueError("a grid needs as many spacings as axes, and points along each")

    @property
    def total(self) -> int:
        return prod(self.shape)

    @property
    def strides(self) -> tuple[int, ...]:
        return tuple(prod(self.shape[a + 1 :]) for a in range(len(self.shape)))

    def place(self, index: Sequence[Column]) -> Column:
        """The linear index; null outside of the grid."""
        inside, out = F.lit(True), F.lit(0).cast("long")
        for i, n, s in zip(index, self.shape, self.strides, strict=True):
            inside, out = inside & i.between(0, n - 1), out + i * F.lit(s)
        return F.when(inside, out.cast("long"))

    def index(self, place: Column) -> list[Column]:
        return [F.pmod(F.floor(place / F.lit(s)), F.lit(n)).cast("int") for n, s in zip(self.shape, self.strides, strict=True)]

    def coords(self, place: Column) -> list[Column]:
        start = self.origin or (0.0,) * len(self.shape)
        return [o + i * h for o, i, h in zip(start, self.index(place), self.spacing, strict=True)]

    def nearest(self, coords: Sequence[Column]) -> Column:
        """The place nearest to a point, null if that is outside; halves go up."""
        start = self.origin or (0.0,) * len(self.shape)
        return self.place([F.floor((c - o) / h + 0.5) for c, o, h in zip(coords, start, self.spacing, strict=True)])

    def is_edge(self, place: Column) -> Column:
        out = F.lit(False)
        for i, n in zip(self.index(place), self.shape, strict=True):
            out = out | (i == 0) | (i == n - 1)
        return out

    def cells(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.total).select(F.col("id").alias("pos"))

    def densify(self, some: DataFrame, value: str = "u", fill: float = 0.0) -> DataFrame:
        """All cells, with ``fill`` where ``some(pos, value)`` has none."""
        return self.cells(some.sparkSession).join(some.select("pos", value), "pos", "left").select("pos", F.coalesce(value, F.lit(fill)).alias(value))

    def _handed(self, field: DataFrame, value: str, parts: list[Column]) -> DataFrame:
        given = field.select("pos", F.col(value).alias("_v")).select(F.explode(F.array_compact(F.array(*parts))).alias("_p")).select("_p.*")
        return given.groupBy("pos")

    def laplacian(self, field: DataFrame, value: str = "u", out: str = "lap") -> DataFrame:
        """(pos, out): the sum of second differences; an axis on whose open face a cell lies adds nothing."""
        index, parts = self.index(F.col("pos")), []
        part = lambda ok, at, w: F.when(ok, F.struct(at.alias("pos"), (F.col("_v") * w).alias("_w")))
        own = F.lit(0.0)
        for i, n, s, h in zip(index, self.shape, self.strides, self.spacing, strict=True):
            parts += [part(i < n - 2, F.col("pos") + s, 1 / h**2), part(i > 1, F.col("pos") - s, 1 / h**2)]
            own = own + F.when((i > 0) & (i < n - 1), F.lit(-2 / h**2)).otherwise(0.0)
        parts.append(F.struct(F.col("pos"), (F.col("_v") * own).alias("_w")))
        return self._handed(field, value, parts).agg(F.sum("_w").alias(out))

    def gradient(self, field: DataFrame, value: str = "u") -> DataFrame:
        """(pos, d0, d1, ...): first differences, central inside and one-sided at the faces."""
        index, parts, names = self.index(F.col("pos")), [], [f"d{a}" for a in range(len(self.shape))]

        def part(ok: Column, at: Column, axis: int, w: Column) -> Column:
            return F.when(ok, F.struct(at.alias("pos"), F.lit(axis).alias("_a"), (F.col("_v") * w).alias("_w")))

        for a, (i, n, s, h) in enumerate(zip(index, self.shape, self.strides, self.spacing, strict=True)):
            if n < 2:
                continue
            # what a cell is to the one after it, the one before it, and itself
            parts += [
                part(i < n - 1, F.col("pos") + s, a, F.when(i == n - 2, F.lit(-1 / h)).otherwise(-0.5 / h)),
                part(i > 0, F.col("pos") - s, a, F.when(i == 1, F.lit(1 / h)).otherwise(0.5 / h)),
                part((i == 0) | (i == n - 1), F.col("pos"), a, F.when(i == 0, F.lit(-1 / h)).otherwise(1 / h)),
            ]
        sums = [F.coalesce(F.sum(F.when(F.col("_a") == a, F.col("_w"))), F.lit(0.0)).alias(d) for a, d in enumerate(names)]
        return self._handed(field, value, parts).agg(*sums)
