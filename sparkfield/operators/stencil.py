"""Finite differences on grid fields as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from .grid import Grid


def _along(grid: Grid, axis: int):
    others = [*grid.by, *(c for a, c in enumerate(grid.index) if a != axis)]
    return W.partitionBy(*others).orderBy(grid.index[axis])


def _shifted(coords: list[Column], grid: Grid, axis: int, shift: int) -> list[Column]:
    return [grid.coord(a, shift) if a == axis else c for a, c in enumerate(coords)]


def derivative(grid: Grid, axis: int, order: int, name: str = "u") -> Column:
    """First or second difference of a field column along an axis, boundaries and barriers included."""
    if order not in (1, 2):
        raise ValueError("only first and second derivatives are defined")
    n, h = grid.dims[axis], float(grid.spacing[axis])
    if n < 3:
        raise ValueError("a derivative needs three points along its axis")
    w = _along(grid, axis)
    f0 = F.col(name)
    low, high = F.lag(f0, 1).over(w), F.lead(f0, 1).over(w)
    at, coords = F.col(grid.index[axis]), grid.coords()
    first, last = grid.boundaries[2 * axis], grid.boundaries[2 * axis + 1]

    if order == 1:
        inner = (high - low) / (2 * h)
        edge = {
            "DIRICHLET": ((high - first.at(coords)) / (2 * h), (last.at(coords) - low) / (2 * h)),
            "REFLECT": (F.lit(0.0), F.lit(0.0)),
        }
        open_ = ((high - f0) / h, (f0 - low) / h)
    else:
        second_low, second_high = F.lag(f0, 2).over(w), F.lead(f0, 2).over(w)
        inner = _across_barriers(grid, axis, coords, (low - 2 * f0 + high) / (h * h), (second_high - 2 * high + f0) / (h * h), (f0 - 2 * low + second_low) / (h * h))
        one_sided = ((second_high - 2 * high + f0) / (h * h), (f0 - 2 * low + second_low) / (h * h))
        edge = {
            "DIRICHLET": ((first.at(coords) - 2 * f0 + high) / (h * h), (low - 2 * f0 + last.at(coords)) / (h * h)),
            "OPEN": (F.lit(0.0), F.lit(0.0)),
        }
        open_ = one_sided
    out = F.when(at == 0, edge.get(first.kind, open_)[0]).when(at == n - 1, edge.get(last.kind, open_)[1]).otherwise(inner)
    blocked = F.lit(False)
    for b in grid.barriers:
        if b.active and abs(b.normal[axis]) > {"REFLECT": 0.01, "NEUMANN": 0.01, "DIRICHLET": 0.1}.get(b.kind, 2.0):
            blocked = blocked | (b.in_box(coords, h) & b.holds(coords, h))
    return F.when(blocked, F.lit(0.0)).otherwise(out) if grid.barriers else out


def _across_barriers(grid: Grid, axis: int, coords: list[Column], central: Column, forward: Column, backward: Column) -> Column:
    """Second difference where the three-point stencil straddles a reflecting barrier: one-sided, away from it."""
    h, n, at = float(grid.spacing[axis]), grid.dims[axis], F.col(grid.index[axis])
    minus, plus = _shifted(coords, grid, axis, -1), _shifted(coords, grid, axis, 1)
    out = None
    for b in grid.barriers:
        if not b.active:
            continue
        here, below, above = b.distance(coords), b.distance(minus), b.distance(plus)
        straddles = (below * above < 0) | (here * below < 0) | (here * above < 0)
        reaches = b.holds(coords, h) | b.holds(minus, h) | b.holds(plus, h)
        if b.kind == "REFLECT":
            ahead = F.when(at + 2 < n, forward).otherwise(0.0)
            behind = F.when(at >= 2, backward).otherwise(0.0)
            value = F.when(F.abs(here) < h, F.lit(0.0)).when((here > 0) & (below < 0), ahead).when((here <= 0) & (above > 0), behind).otherwise(central)
        else:
            value = central
        out = (F if out is None else out).when(straddles & reaches, value)
    return central if out is None else out.otherwise(central)


#: How a second difference is taken at a point: by its two neighbours, by the next two, by the two before, or not at all.
CENTRAL, FORWARD, BACKWARD, NONE = range(4)


def second_difference_case(grid: Grid, axis: int) -> tuple[Column, Column]:
    """(case, value beyond a DIRICHLET face) of a grid's points along an axis, from their indices alone.

    For steps in arrays, where ``derivative``'s windows are not at hand.
    """
    n, h, at, coords = grid.dims[axis], float(grid.spacing[axis]), F.col(grid.index[axis]), grid.coords()
    if n < 3:
        return F.lit(NONE), F.lit(0.0)
    inner = None
    minus, plus = _shifted(coords, grid, axis, -1), _shifted(coords, grid, axis, 1)
    for b in grid.barriers:
        if not b.active:
            continue
        here, below, above = b.distance(coords), b.distance(minus), b.distance(plus)
        met = ((below * above < 0) | (here * below < 0) | (here * above < 0)) & (b.holds(coords, h) | b.holds(minus, h) | b.holds(plus, h))
        case = F.lit(CENTRAL)
        if b.kind == "REFLECT":
            ahead, behind = F.when(at + 2 < n, FORWARD).otherwise(NONE), F.when(at >= 2, BACKWARD).otherwise(NONE)
            case = F.when(F.abs(here) < h, NONE).when((here > 0) & (below < 0), ahead).when((here <= 0) & (above > 0), behind).otherwise(CENTRAL)
        inner = (F if inner is None else inner).when(met, case)
    inner = F.lit(CENTRAL) if inner is None else inner.otherwise(CENTRAL)
    first, last = grid.boundaries[2 * axis], grid.boundaries[2 * axis + 1]
    edge = {"DIRICHLET": (CENTRAL, CENTRAL), "OPEN": (NONE, NONE)}
    out = F.when(at == 0, edge.get(first.kind, (FORWARD,))[0]).when(at == n - 1, edge.get(last.kind, (0, BACKWARD))[1]).otherwise(inner)
    for b in grid.barriers:
        if b.active and abs(b.normal[axis]) > {"REFLECT": 0.01, "NEUMANN": 0.01, "DIRICHLET": 0.1}.get(b.kind, 2.0):
            out = F.when(b.in_box(coords, h) & b.holds(coords, h), NONE).otherwise(out)
    beyond = F.lit(0.0)
    for face, k in ((first, 0), (last, n - 1)):
        if face.kind == "DIRICHLET":
            beyond = F.when(at == k, face.at(coords)).otherwise(beyond)
    return out, beyond


def laplacian(grid: Grid, name: str = "u") -> Column:
    """Sum of second differences over the axes of three points or more."""
    out = F.lit(0.0)
    for axis, n in enumerate(grid.dims):
        if n >= 3:
            out = out + derivative(grid, axis, 2, name)
    return out


def gradient(grid: Grid, name: str = "u") -> dict[str, Column]:
    """First differences by axis index name; every axis must have three points."""
    return {f"d{grid.index[a]}": derivative(grid, a, 1, name) for a in range(len(grid.dims))}


def derivative_by_shift(field: DataFrame, grid: Grid, order: int, name: str = "u", out: str = "du") -> DataFrame:
    """Difference on a one-dimensional grid as equi-joins with the shifted field.

    A window without other axes to partition by would put the whole line into one task; this
    keeps it spread over tasks by index.
    """
    if len(grid.dims) != 1 or grid.barriers:
        raise ValueError("for lines without barriers")
    i, keys = grid.index[0], [*grid.by, grid.index[0]]
    moved = field
    for s in (-2, -1, 1, 2):
        other = field.select(*grid.by, (F.col(i) - s).alias(i), F.col(name).alias(f"_p{s}" if s > 0 else f"_m{-s}"))
        moved = moved.join(other, keys, "left")
    h, n, f0 = float(grid.spacing[0]), grid.dims[0], F.col(name)
    low, high, low2, high2 = F.col("_m1"), F.col("_p1"), F.col("_m2"), F.col("_p2")
    first, last = grid.boundaries
    coords = grid.coords()
    if order == 1:
        edges = {"DIRICHLET": ((high - first.at(coords)) / (2 * h), (last.at(coords) - low) / (2 * h)), "REFLECT": (F.lit(0.0),) * 2}
        other, inner = ((high - f0) / h, (f0 - low) / h), (high - low) / (2 * h)
    else:
        edges = {"DIRICHLET": ((first.at(coords) - 2 * f0 + high) / (h * h), (low - 2 * f0 + last.at(coords)) / (h * h)), "OPEN": (F.lit(0.0),) * 2}
        other, inner = ((high2 - 2 * high + f0) / (h * h), (f0 - 2 * low + low2) / (h * h)), (low - 2 * f0 + high) / (h * h)
    value = F.when(F.col(i) == 0, edges.get(first.kind, other)[0]).when(F.col(i) == n - 1, edges.get(last.kind, other)[1]).otherwise(inner)
    return moved.withColumn(out, value).drop("_m1", "_m2", "_p1", "_p2")
