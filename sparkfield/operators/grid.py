"""Uniform grids: metadata, addressing and fields.

A grid is plan-time metadata; a field is a column of a long table with one row per point and
index columns i, j, k (as many as the grid has axes). Rows of many fields can share a table:
``by`` names the columns that tell them apart.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .boundary import Barrier, Boundary

INDEX = ("i", "j", "k")
# The names of a grid's axes in expressions, in order.
AXES = ("x", "y", "z", "w", "r", "s", "t", "u", "v", "a", "b", "c", "d", "e", "f", "g", "h", "i", "j", "k", "l", "m", "n", "o", "p", "q")


def axis_name(axis: int) -> str | None:
    return AXES[axis] if 0 <= axis < len(AXES) else None


def axis_from_name(name: str) -> int | None:
    return AXES.index(name) if name in AXES else None


@dataclass(frozen=True)
class Grid:
    dims: tuple[int, ...]
    spacing: tuple[float, ...]
    origin: tuple[float, ...] = ()
    boundaries: tuple[Boundary, ...] = ()  # face 2 * axis + side; OPEN where missing
    barriers: tuple[Barrier, ...] = ()
    by: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if not 1 <= len(self.dims) <= len(INDEX) or len(self.spacing) != len(self.dims):
            raise ValueError("a grid has one to three axes, each with a spacing")
        object.__setattr__(self, "origin", tuple(self.origin) or (0.0,) * len(self.dims))
        faces = list(self.boundaries) + [Boundary("OPEN")] * (2 * len(self.dims) - len(self.boundaries))
        object.__setattr__(self, "boundaries", tuple(faces))

    @property
    def index(self) -> tuple[str, ...]:
        return INDEX[: len(self.dims)]

    @property
    def total_points(self) -> int:
        return prod(self.dims)

    @property
    def extent(self) -> tuple[float, ...]:
        """dims * spacing, one cell more than the points span."""
        return tuple(n * h for n, h in zip(self.dims, self.spacing, strict=True))

    # --- boundary configuration
    def with_boundary(self, axis: int, side: int, boundary: Boundary) -> Grid:
        """Set one face; a function is only for DIRICHLET and NEUMANN, an OPEN order is at least 1."""
        if not 0 <= axis < len(self.dims) or side not in (0, 1):
            raise ValueError("no such face")
        if boundary.func is not None and boundary.kind not in ("DIRICHLET", "NEUMANN"):
            raise ValueError("only Dirichlet and Neumann boundaries take a function")
        faces = list(self.boundaries)
        faces[2 * axis + side] = boundary
        return replace(self, boundaries=tuple(faces))

    def with_barrier(self, normal: Sequence[float], point: Sequence[float], low=None, high=None, kind: str = "REFLECT", value: float = 0.0, func=None) -> Grid:
        """Add an interior hyperplane, bounded if ``low`` and ``high`` are given."""
        box = (self.origin, tuple(o + e for o, e in zip(self.origin, self.extent, strict=True)))
        barrier = Barrier.make(tuple(normal), tuple(point), low, high, kind, value, func, box)
        return replace(self, barriers=(*self.barriers, barrier))

    def at_time(self, t: float) -> Grid:
        """The same boundaries at another time."""
        return replace(self, boundaries=tuple(replace(b, time=t) for b in self.boundaries), barriers=tuple(replace(b, time=t) for b in self.barriers))

    # --- addressing, as columns
    def linear(self, *index: Column) -> Column:
        """Row-major position."""
        out = F.lit(0)
        for c, n in zip(index or map(F.col, self.index), self.dims, strict=True):
            out = out * n + c
        return out

    def from_linear(self, position: Column) -> dict[str, Column]:
        out, rest = {}, position
        for name, n in reversed(list(zip(self.index, self.dims, strict=True))):
            out[name] = (rest % n).cast("int")
            rest = F.floor(rest / n)
        return dict(reversed(out.items()))

    def coord(self, axis: int, shift: int = 0) -> Column:
        return F.lit(self.origin[axis]) + (F.col(self.index[axis]) + shift) * F.lit(float(self.spacing[axis]))

    def coords(self) -> list[Column]:
        return [self.coord(a) for a in range(len(self.dims))]

    def nearest(self, *coords: Column) -> dict[str, Column]:
        """Index of the nearest point; null outside the extent. Halves round away from zero; the last cell belongs to the last point."""
        inside = F.lit(True)
        out = {}
        for name, c, o, h, n, e in zip(self.index, coords, self.origin, self.spacing, self.dims, self.extent, strict=True):
            rel = c - o
            inside = inside & (rel >= 0) & (rel <= e)
            out[name] = F.least(F.round(rel / h), F.lit(float(n - 1))).cast("int")
        return {k: F.when(inside, v) for k, v in out.items()}

    def is_boundary(self) -> Column:
        out = F.lit(False)
        for name, n in zip(self.index, self.dims, strict=True):
            if n > 1:
                out = out | F.col(name).isin(0, n - 1)
        return out

    # --- fields
    def points(self, spark: SparkSession) -> DataFrame:
        """One row per point."""
        return spark.range(self.total_points).select(*(c.alias(k) for k, c in self.from_linear(F.col("id")).items()))

    def zeros(self, spark: SparkSession, name: str = "u") -> DataFrame:
        return self.fill(spark, 0.0, name)

    def fill(self, spark: SparkSession, value: float, name: str = "u") -> DataFrame:
        return self.points(spark).withColumn(name, F.lit(float(value)))

    def init(self, spark: SparkSession, f: Callable[..., Column], name: str = "u") -> DataFrame:
        """The field f(x, y, ...) of coordinate columns."""
        return self.points(spark).withColumn(name, f(*self.coords()))

    def densify(self, sparse: DataFrame, name: str = "u") -> DataFrame:
        """A row for every point, 0 where ``sparse`` has none; the points are fixed by the grid."""
        return self.points(sparse.sparkSession).join(sparse, list(self.index), "left").withColumn(name, F.coalesce(F.col(name).cast("double"), F.lit(0.0)))

    def matches(self, shape: Sequence[int]) -> bool:
        """Whether a tensor of that shape is a field of this grid: leading axes equal, the rest 1."""
        return tuple(shape) == tuple(self.dims) + (1,) * (len(shape) - len(self.dims))

    def sample(self, field_df: DataFrame, points: DataFrame, coords: Sequence[str], name: str = "u") -> DataFrame:
        """Nearest-neighbour values at ``points``; null outside."""
        at = self.nearest(*(F.col(c) for c in coords))
        at = points.withColumns({f"_{k}": c for k, c in at.items()})
        other = field_df.select(*(F.col(k).alias(f"_{k}") for k in self.index), F.col(name))
        return at.join(other, [f"_{k}" for k in self.index], "left").drop(*(f"_{k}" for k in self.index))


def get(field_df: DataFrame, grid: Grid, index: Sequence[int]) -> DataFrame:
    """The row of one point; none if out of range."""
    for name, v in zip(grid.index, index, strict=True):
        field_df = field_df.where(F.col(name) == v)
    return field_df


def set_value(field_df: DataFrame, grid: Grid, index: Sequence[int], value: float, name: str = "u") -> DataFrame:
    here = F.lit(True)
    for k, v in zip(grid.index, index, strict=True):
        here = here & (F.col(k) == v)
    return field_df.withColumn(name, F.when(here, F.lit(float(value))).otherwise(F.col(name)))


def add(a: DataFrame, b: DataFrame, grid: Grid, name: str = "u") -> DataFrame:
    return _combine(a, b, grid, name, lambda x, y: x + y)


def multiply(a: DataFrame, b: DataFrame, grid: Grid, name: str = "u") -> DataFrame:
    return _combine(a, b, grid, name, lambda x, y: x * y)


def _combine(a, b, grid, name, f):
    keys = [*grid.by, *grid.index]
    b = b.select(*keys, F.col(name).alias("_b"))
    return a.join(b, keys).withColumn(name, f(F.col(name), F.col("_b"))).drop("_b")


def scale(a: DataFrame, s: float, name: str = "u") -> DataFrame:
    return a.withColumn(name, F.col(name) * F.lit(float(s)))


def norm(name: str = "u") -> Column:
    """Aggregate: the L2 norm of a field, without a volume weight."""
    return F.sqrt(F.sum(F.col(name) * F.col(name)))
