"""Boundary conditions on faces and on interior hyperplanes (barriers)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import product
from math import sqrt

from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("DIRICHLET", "NEUMANN", "ROBIN", "PERIODIC", "OPEN", "REFLECT")


@dataclass(frozen=True)
class Boundary:
    """A face's condition. NEUMANN's value is stored but stencils take it as zero; ROBIN and
    PERIODIC are stored and act as NEUMANN; an OPEN order is stored."""

    kind: str
    value: float = 0.0
    func: Callable[..., Column] | None = None  # (coordinate columns..., time) -> column
    time: float = 0.0
    alpha: float = 0.0
    beta: float = 0.0
    gamma: float = 0.0
    order: int = 1

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown boundary {self.kind!r}")
        if self.order < 1:
            raise ValueError("an extrapolation order is at least 1")

    def at(self, coords: Sequence[Column]) -> Column:
        return self.func(*coords, F.lit(float(self.time))) if self.func else F.lit(float(self.value))


def basis(normal: Sequence[float], strict_parity: bool = False) -> list[tuple[float, ...]]:
    """Orthonormal directions within a hyperplane, by Gram-Schmidt from the standard basis.

    Standard vectors that lie along the normal or in the span so far are passed over. With
    ``strict_parity`` each direction starts from its own standard vector or the one after,
    which gives a zero direction for a normal along the first axis in space.
    """
    n = len(normal)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out: list[tuple[float, ...]] = []

    def orthogonal(k):
        v = [float(d == k) for d in range(n)]
        for u in (normal, *out):
            c = dot(v, u)
            v = [a - c * b for a, b in zip(v, u, strict=True)]
        size = sqrt(dot(v, v))
        return tuple(a / size for a in v) if size > 1e-10 else tuple(v)

    if strict_parity:
        for i in range(n - 1):
            out.append(orthogonal((i + 1) % n if abs(normal[i]) > 0.9 else i))
        return out
    for k in sorted(range(n), key=lambda k: (abs(normal[k]) > 0.9, k)):
        v = orthogonal(k)
        if len(out) < n - 1 and dot(v, v) > 0.5:
            out.append(v)
    return out


@dataclass(frozen=True)
class Barrier:
    normal: tuple[float, ...]
    point: tuple[float, ...]
    low: tuple[float, ...] | None
    high: tuple[float, ...] | None
    box: tuple[tuple[float, ...], tuple[float, ...]]
    directions: tuple[tuple[float, ...], ...]
    kind: str = "REFLECT"
    value: float = 0.0
    func: Callable[..., Column] | None = None
    active: bool = True
    time: float = 0.0

    @staticmethod
    def make(normal, point, low, high, kind="REFLECT", value=0.0, func=None, grid_box=None, strict_parity=False) -> Barrier:
        """Normalise, and find the world box: of the corners if bounded, else the grid's."""
        size = sqrt(sum(v * v for v in normal))
        if not size:
            raise ValueError("a normal cannot be zero")
        normal = tuple(v / size for v in normal)
        directions = tuple(basis(normal, strict_parity))
        if low is None or high is None:
            return Barrier(normal, tuple(map(float, point)), None, None, grid_box, directions, kind, value, func)
        corners = [tuple(map(float, point))]
        for c in product(*zip(low, high, strict=True)):
            corners.append(tuple(p + sum(t * d[a] for t, d in zip(c, directions, strict=True)) for a, p in enumerate(point)))
        box = tuple(tuple(f(c[a] for c in corners) for a in range(len(point))) for f in (min, max))
        return Barrier(normal, tuple(map(float, point)), tuple(map(float, low)), tuple(map(float, high)), box, directions, kind, value, func)

    def distance(self, coords: Sequence[Column]) -> Column:
        """Signed distance to the plane."""
        out = F.lit(0.0)
        for n, c, p in zip(self.normal, coords, self.point, strict=True):
            out = out + F.lit(n) * (c - F.lit(p))
        return out

    def in_box(self, coords: Sequence[Column], tolerance: float) -> Column:
        out = F.lit(True)
        for c, lo, hi in zip(coords, *self.box, strict=True):
            out = out & (c >= F.lit(lo - tolerance)) & (c <= F.lit(hi + tolerance))
        return out

    def holds(self, coords: Sequence[Column], tolerance: float) -> Column:
        """On the plane and within its bounds; the bounds themselves have no tolerance."""
        out = F.abs(self.distance(coords)) <= tolerance
        if self.low is None:
            return out
        out = out & self.in_box(coords, tolerance)
        for d, lo, hi in zip(self.directions, self.low, self.high, strict=True):
            t = F.lit(0.0)
            for c, p, v in zip(coords, self.point, d, strict=True):
                t = t + (c - F.lit(p)) * F.lit(v)
            out = out & (t >= F.lit(lo)) & (t <= F.lit(hi))
        return out


def near_boundary(barriers: Sequence[Barrier], coords: Sequence[Column], tolerance: float = 1e-10) -> Column:
    """Number (from 1) of the first active barrier that holds the point, else 0."""
    out = F.lit(0)
    for n, b in reversed(list(enumerate(barriers, 1))):
        if b.active:
            out = F.when(b.holds(coords, tolerance), F.lit(n)).otherwise(out)
    return out


def segments_to_barriers(points: DataFrame, order: str = "ord", right: bool = False) -> DataFrame:
    """Consecutive pairs of end points (x, y) as segment rows: normal, midpoint, half length.

    The normal points to the left of the way from the first end to the second, or to its
    ``right``. Segments shorter than 1e-6 are dropped.
    """
    side = -1 if right else 1
    pairs = points.groupBy(F.floor(F.col(order) / 2).alias("bid")).agg(
        F.min_by("x", order).alias("x0"), F.min_by("y", order).alias("y0"), F.max_by("x", order).alias("x1"), F.max_by("y", order).alias("y1"), F.count(F.lit(1)).alias("ends")
    )
    length = F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)
    pairs = pairs.where("ends = 2").withColumn("len", length).where("len >= 1e-6")
    return pairs.select(
        "bid",
        (-side * (F.col("y1") - F.col("y0")) / F.col("len")).alias("nx"),
        (side * (F.col("x1") - F.col("x0")) / F.col("len")).alias("ny"),
        ((F.col("x0") + F.col("x1")) / 2).alias("px"),
        ((F.col("y0") + F.col("y1")) / 2).alias("py"),
        (F.col("len") / 2).alias("half"),
    )
