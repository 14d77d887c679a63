"""Two-dimensional waves on grid fields: sources, barriers, absorbing layers, stepping, energy.

State is a table (sim..., i, j, u_curr, u_prev). A few steps run as plans of window
expressions; long runs as one fused task per simulation, or, for grids too large for a task,
as tiles with halos that exchange rows once every few steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from sparkfield.plans.durable import durable

from . import stencil
from .grid import Grid

# The absorbing layer's strength, its width as a share of the visible size and at least.
SIGMA_MAX = 10.0
SPONGE_SHARE = 0.5
SPONGE_LEAST = 10
MAX_SOURCES = 32


@dataclass(frozen=True)
class Domain:
    """A visible region with an absorbing layer around it; lengths are of the visible region."""

    nx: int
    ny: int
    lx: float = 1.0
    ly: float = 1.0
    sponge: int | None = None
    dt: float = 0.004
    c: float = 1.0

    @property
    def width(self) -> int:
        return self.sponge if self.sponge is not None else max(SPONGE_LEAST, int(SPONGE_SHARE * (self.nx + self.ny) / 2))

    @property
    def dx(self) -> float:
        return self.lx / (self.nx - 1)

    @property
    def dy(self) -> float:
        return self.ly / (self.ny - 1)

    @property
    def dims(self) -> tuple[int, int]:
        return self.nx + 2 * self.width, self.ny + 2 * self.width

    def grid(self, by: tuple[str, ...] = ()) -> Grid:
        return Grid(self.dims, (self.dx, self.dy), by=by)

    @property
    def cfl(self) -> float:
        return cfl(self.c, self.dt, self.dx, self.dy)

    def visible(self, i: Column | None = None, j: Column | None = None) -> Column:
        w, (nx, ny) = self.width, self.dims
        i, j = F.col("i") if i is None else i, F.col("j") if j is None else j
        return (i >= w) & (i < nx - w) & (j >= w) & (j < ny - w)


def cfl(c: float, dt: float, dx: float, dy: float) -> float:
    """Courant number; above 0.7 a run is not stable."""
    return c * dt / min(dx, dy)


# --- initial fields, as columns of the coordinates
def gaussian(x: Column, y: Column, cx: float, cy: float, amplitude: float = 1.0, sigma: float = 0.1) -> Column:
    r2 = (x - cx) * (x - cx) + (y - cy) * (y - cy)
    return amplitude * F.exp(-r2 / (2 * sigma * sigma))


def plane_wave(x: Column, y: Column) -> Column:
    return 0.5 * F.sin(10.0 * (x + y))


def add_wave(state: DataFrame, grid: Grid, cx: float, cy: float, amplitude: float, sigma: float) -> DataFrame:
    """An impulse on the current field; the previous one stays, so it moves at once."""
    x, y = grid.coords()
    return state.withColumn("u_curr", F.col("u_curr") + gaussian(x, y, cx, cy, amplitude, sigma))


def reset(grid: Grid, spark: SparkSession) -> DataFrame:
    return grid.points(spark).withColumns({"u_curr": F.lit(0.0), "u_prev": F.lit(0.0)})


# --- one step
def sources_overlay(state: DataFrame, grid: Grid, sources: DataFrame, time: float, by: Sequence[str] = ()) -> DataFrame:
    """Within an active source's radius the current field is its oscillation; of overlapping sources the last in ``ord`` wins.

    Sources meet cells over the rectangle of cells around each, so the join is by equality.
    """
    hx, hy = grid.spacing
    cells = F.ceil(F.col("radius") / min(hx, hy)).cast("int") + 1
    ix, iy = F.round(F.col("x") / hx).cast("int"), F.round(F.col("y") / hy).cast("int")
    around = lambda c, n: F.sequence(F.greatest(F.lit(0), c - cells), F.least(F.lit(n - 1), c + cells))
    near = (ix + cells >= 0) & (ix - cells <= grid.dims[0] - 1) & (iy + cells >= 0) & (iy - cells <= grid.dims[1] - 1)
    hit = sources.where(F.col("active") & near).withColumn("i", F.explode(around(ix, grid.dims[0]))).withColumn("j", F.explode(around(iy, grid.dims[1])))
    dx, dy = F.col("i") * hx - F.col("x"), F.col("j") * hy - F.col("y")
    value = F.col("amplitude") * F.sin(F.lit(2 * math.pi) * F.col("frequency") * F.lit(float(time)) + F.col("phase"))
    hit = hit.where(dx * dx + dy * dy <= F.col("radius") * F.col("radius"))
    hit = hit.groupBy(*by, "i", "j").agg(F.max_by(value, "ord").alias("_s"))
    return state.join(hit, [*by, "i", "j"], "left").withColumn("u_curr", F.coalesce("_s", "u_curr")).drop("_s")


def leapfrog(grid: Grid, c2dt2: float, current: str = "u_curr", previous: str = "u_prev") -> Column:
    """u+ = 2 u - u- + c^2 dt^2 laplacian(u)."""
    return 2.0 * F.col(current) - F.col(previous) + F.lit(float(c2dt2)) * stencil.laplacian(grid, current)


def edge_distance(grid: Grid, faces: str = "all") -> Column:
    """Cells to the nearest face: of all, or with ``open`` of the OPEN ones (the grid's size if there is none)."""
    (nx, ny), (i, j) = grid.dims, (F.col("i"), F.col("j"))
    distances = [i, F.lit(nx - 1) - i, j, F.lit(ny - 1) - j]
    if faces == "open":
        distances = [d for d, b in zip(distances, grid.boundaries, strict=True) if b.kind == "OPEN"]
    return F.least(F.lit(nx), *distances) if distances else F.lit(nx)


def sponge(grid: Grid, width: int, dt: float, after: Column, faces: str = "all", sigma_max: float = SIGMA_MAX) -> Column:
    """The next field damped in the layer, whose strength rises quadratically towards the faces."""
    d = edge_distance(grid, faces)
    u, before = F.col("u_curr"), F.col("u_prev")
    share = 1.0 - d / F.lit(float(width))
    sigma = F.lit(sigma_max) * share * share
    damped = (2.0 - sigma * dt) * u - (1.0 - sigma * dt) * before + (after - 2.0 * u + before)
    return F.when(d < width, damped).otherwise(after)


def step(state: DataFrame, grid: Grid, c2dt2: float, width: int = 0, dt: float = 0.0, faces: str = "all") -> DataFrame:
    """One leapfrog step with damping; current becomes previous."""
    rest = [c for c in state.columns if c not in ("u_curr", "u_prev")]
    out = state.withColumn("_next", leapfrog(grid, c2dt2))
    if width:
        out = out.withColumn("_next", sponge(grid, width, dt, F.col("_next"), faces))
    return out.select(*rest, F.col("_next").alias("u_curr"), F.col("u_curr").alias("u_prev"))


def run(state: DataFrame, grid: Grid, c2dt2: float, steps: int, width: int = 0, dt: float = 0.0, cut_every: int = 5) -> DataFrame:
    """Some steps as window plans, the lineage cut every few of them."""
    for n in range(1, steps + 1):
        state = step(state, grid, c2dt2, width, dt)
        if n % cut_every == 0 and n < steps:
            state = durable(state)
    return state


#: How points are differenced along the two axes, and what lies beyond their faces.
CASES = ("_case0", "_case1", "_beyond0", "_beyond1")


def _with_cases(state: DataFrame, grid: Grid) -> DataFrame:
    """``state`` with CASES, so that arrays honour faces and barriers as windows do."""
    (c0, g0), (c1, g1) = (stencil.second_difference_case(grid, a) for a in (0, 1))
    return state.withColumns(dict(zip(CASES, (c0.cast("int"), c1.cast("int"), g0.cast("double"), g1.cast("double")), strict=True)))


class _Cells:
    """A rectangle of a grid from its cell ``lo`` on, as arrays."""

    def __init__(self, pdf: pd.DataFrame, grid: Grid, lo: tuple[int, int], shape: tuple[int, int], width: int, dt: float):
        self.grid, self.lo, self.place = grid, lo, (pdf.i.to_numpy() - lo[0], pdf.j.to_numpy() - lo[1])
        fill = lambda c, kind=float: self.put(np.zeros(shape, kind), pdf[c].to_numpy())
        self.u, self.p = fill("u_curr"), fill("u_prev")
        self.case, self.beyond = [fill(c, np.int8) for c in CASES[:2]], [fill(c) for c in CASES[2:]]
        # per axis, the places of one-sided differences and of none: they are the same in each step
        cases = [np.moveaxis(c, axis, 0) for axis, c in enumerate(self.case)]
        self.sided = [[(at, s) for kind, s in ((stencil.FORWARD, 1), (stencil.BACKWARD, -1)) if len((at := np.nonzero(c == kind))[0])] for c in cases]
        self.none = [np.nonzero(c == stencil.NONE) for c in cases]
        i, j = np.arange(shape[0])[:, None] + lo[0], np.arange(shape[1])[None, :] + lo[1]
        d = np.minimum(np.minimum(i, grid.dims[0] - 1 - i), np.minimum(j, grid.dims[1] - 1 - j))
        self.sigma = np.where(d < width, SIGMA_MAX * (1.0 - d / max(width, 1)) ** 2, 0.0) * dt if width else None

    def put(self, field: np.ndarray, values) -> np.ndarray:
        field[self.place] = values
        return field

    def _second_difference(self, axis: int) -> np.ndarray:
        u, beyond = (np.moveaxis(x, axis, 0) for x in (self.u, self.beyond[axis]))
        n, h = len(u), float(self.grid.spacing[axis])
        out = np.empty_like(u)
        out[1:] = u[:-1]
        out[0] = beyond[0] if self.lo[axis] == 0 else 0.0
        out -= 2.0 * u
        out[:-1] += u[1:]
        if self.lo[axis] + n == self.grid.dims[axis]:
            out[-1] += beyond[-1]
        if self.sided[axis]:
            wide = np.zeros((n + 4, u.shape[1]))
            wide[2:-2] = u
            for at, s in self.sided[axis]:
                k = at[0] + 2
                far, near, f0 = wide[np.clip(k + 2 * s, 0, n + 3), at[1]], wide[k + s, at[1]], u[at]
                out[at] = far - 2.0 * near + f0 if s > 0 else f0 - 2.0 * near + far
        out /= h * h
        out[self.none[axis]] = 0.0
        return np.moveaxis(out, 0, axis)

    def step(self, c2dt2: float) -> None:
        u, p = self.u, self.p
        after = 2.0 * u - p + c2dt2 * (self._second_difference(0) + self._second_difference(1))
        if self.sigma is not None:
            after = np.where(self.sigma > 0, (2.0 - self.sigma) * u - (1.0 - self.sigma) * p + (after - 2.0 * u + p), after)
        self.u, self.p = after, u

    def frame(self) -> pd.DataFrame:
        i, j = np.indices(self.u.shape)
        return pd.DataFrame({"i": (i + self.lo[0]).ravel().astype(np.int32), "j": (j + self.lo[1]).ravel().astype(np.int32), "u_curr": self.u.ravel(), "u_prev": self.p.ravel()})


def run_fused(state: DataFrame, grid: Grid, c2dt2: float, steps: int, by: Sequence[str], width: int = 0, dt: float = 0.0, every: int | None = None) -> DataFrame:
    """Many steps of each simulation in one task, faces and barriers included; rows of every ``every``-th step, or of the last one."""
    kinds = {f.name: f.dataType.simpleString() for f in state.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", step int, i int, j int, u_curr double, u_prev double"

    def simulate(key, pdf: pd.DataFrame) -> pd.DataFrame:
        cells, frames = _Cells(pdf, grid, (0, 0), grid.dims, width, dt), []
        for n in range(1, steps + 1):
            cells.step(c2dt2)
            if n == steps or (every and n % every == 0):
                frames.append(cells.frame().assign(step=np.int32(n), **dict(zip(by, key, strict=True)))[[*by, "step", "i", "j", "u_curr", "u_prev"]])
        return pd.concat(frames)

    return _with_cases(state.select(*by, "i", "j", "u_curr", "u_prev"), grid).groupBy(*by).applyInPandas(simulate, schema)


def run_tiled(state: DataFrame, grid: Grid, c2dt2: float, steps: int, tile: int = 64, block: int = 8, by: Sequence[str] = (), width: int = 0, dt: float = 0.0) -> DataFrame:
    """Steps on grids too large for one task: tiles with a halo advance ``block`` steps between exchanges.

    Near a halo's cut edge cells go wrong by one cell a step, by two where one-sided
    differences at faces or barriers reach that far; the halo is that much wider than a tile.
    """
    (nx, ny), by = grid.dims, list(by)
    speed = 2 if grid.barriers or any(b.kind not in ("OPEN", "DIRICHLET") for b in grid.boundaries) else 1
    kinds = {f.name: f.dataType.simpleString() for f in state.schema.fields}
    schema = "".join(f"`{c}` {kinds[c]}, " for c in by) + "i int, j int, u_curr double, u_prev double"

    def advance(n: int):
        def f(key, pdf: pd.DataFrame) -> pd.DataFrame:
            (ti, tj), r = key[-2:], n * speed
            lo, hi = (max(0, ti * tile - r), max(0, tj * tile - r)), (min(nx, (ti + 1) * tile + r), min(ny, (tj + 1) * tile + r))
            cells = _Cells(pdf, grid, lo, (hi[0] - lo[0], hi[1] - lo[1]), width, dt)
            for _ in range(n):
                cells.step(c2dt2)
            out = cells.frame()
            out = out[(out.i // tile == ti) & (out.j // tile == tj)]
            return out.assign(**dict(zip(by, key[:-2], strict=True)))[[*by, "i", "j", "u_curr", "u_prev"]]

        return f

    def tiles(c: Column, size: int, r: int) -> Column:
        """All tiles whose halo holds a cell."""
        return F.explode(F.sequence(F.floor(F.greatest(c - r, F.lit(0)) / tile), F.floor(F.least(c + r, F.lit(size - 1)) / tile)))

    while steps:
        n = min(block, steps)
        dealt = _with_cases(state.select(*by, "i", "j", "u_curr", "u_prev"), grid)
        dealt = dealt.withColumn("_ti", tiles(F.col("i"), nx, n * speed)).withColumn("_tj", tiles(F.col("j"), ny, n * speed))
        state = dealt.groupBy(*by, "_ti", "_tj").applyInPandas(advance(n), schema)
        steps -= n
        if steps:
            state = durable(state)
    return state


# --- energy
def _slopes(grid: Grid, visible: DataFrame, by: Sequence[str]) -> DataFrame:
    """Differences within the visible region, one-sided at its edges."""
    hx, hy = grid.spacing
    for axis, other, h in (("i", "j", hx), ("j", "i", hy)):
        w = W.partitionBy(*by, other).orderBy(axis)
        low, high, u = F.lag("u_curr").over(w), F.lead("u_curr").over(w), F.col("u_curr")
        visible = visible.withColumn(f"g{axis}", F.when(low.isNull(), (high - u) / h).when(high.isNull(), (u - low) / h).otherwise((high - low) / (2 * h)))
    return visible


def total_energy(state: DataFrame, grid: Grid, dt: float, c: float, visible: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Kinetic and potential energy over the visible region."""
    rows = _slopes(grid, state if visible is None else state.where(visible), by)
    v = (F.col("u_curr") - F.col("u_prev")) / dt
    density = 0.5 * v * v + 0.5 * c * c * (F.col("gi") * F.col("gi") + F.col("gj") * F.col("gj"))
    return rows.groupBy(*by).agg(F.sum(density * (grid.spacing[0] * grid.spacing[1])).alias("energy"))


def interaction_energy(state: DataFrame, grid: Grid, cx: float, cy: float, amplitude: float, sigma: float, c: float, visible: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Energy between the field and a Gaussian that would be added at (cx, cy), in full-grid coordinates."""
    rows = _slopes(grid, state if visible is None else state.where(visible), by)
    x, y = grid.coords()
    bell = F.exp(-((x - cx) * (x - cx) + (y - cy) * (y - cy)) / (2 * sigma * sigma)) * (-amplitude / (sigma * sigma))
    inner = F.col("gi") * bell * (x - cx) + F.col("gj") * bell * (y - cy)
    return rows.groupBy(*by).agg((F.lit(c * c) * F.sum(inner * (grid.spacing[0] * grid.spacing[1]))).alias("energy"))


def self_energy(c: float, amplitude: float) -> float:
    """Of a Gaussian pulse, whatever its width."""
    return math.pi / 2 * c * c * amplitude * amplitude


def energy_error(energy: Column, baseline: Column) -> Column:
    return F.when(baseline > 0, (energy - baseline) / baseline).otherwise(0.0)


# --- picking and moving
def nearest_barrier_point(points: DataFrame, barriers: DataFrame, tolerance: float, keys: Sequence[str]) -> DataFrame:
    """For each point the nearest barrier point within ``tolerance``; of equals the last.

    Points of one place have one answer, and of barrier points of one place only the last can be
    it, so places are compared: a crowd in a cell costs no product.
    """
    d2 = (F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("by")) ** 2
    cell = lambda c: F.floor(F.col(c) / tolerance)
    # points within the tolerance lie in neighbouring cells, so the join is by equality
    around = points.select("x", "y").distinct().withColumn("_cx", F.explode(F.array(*(cell("x") + d for d in (-1, 0, 1))))).withColumn("_cy", F.explode(F.array(*(cell("y") + d for d in (-1, 0, 1)))))
    last = barriers.groupBy("bx", "by").agg(F.max("bord").alias("bord"))
    both = around.join(last.withColumns({"_cx": cell("bx"), "_cy": cell("by")}), ["_cx", "_cy"])
    best = F.min_by(F.struct("_d2", "bord"), F.struct("_d2", -F.col("bord"))).alias("_best")
    found = both.withColumn("_d2", d2).where(F.col("_d2") <= tolerance * tolerance).groupBy("x", "y").agg(best)
    return points.join(found, ["x", "y"]).select(*keys, "_best.*").groupBy(*keys).agg(F.min_by("bord", F.struct("_d2", -F.col("bord"))).alias("bord"))


def nearest_source(points: DataFrame, sources: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    """For each point the nearest active source in whose own radius it lies; of equals the first.

    ``cell`` is the size of the buckets over which the two meet. Only different places of
    points, and the first source of a place and radius, are compared.
    """
    sources = sources.where("active").groupBy("x", "y", "radius").agg(F.min("ord").alias("ord"))
    reach = lambda c: F.sequence(F.floor((F.col(c) - F.col("radius")) / cell), F.floor((F.col(c) + F.col("radius")) / cell))
    spread = sources.select("ord", F.col("x").alias("sx"), F.col("y").alias("sy"), "radius", F.explode(reach("x")).alias("_cx"), F.lit(0).alias("_z"), "y").withColumn("_cy", F.explode(reach("y"))).drop("y", "_z")
    own = points.select("x", "y").distinct().withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)})
    d2 = (F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2
    both = own.join(spread, ["_cx", "_cy"]).withColumn("_d2", d2).where("_d2 <= radius * radius")
    found = both.groupBy("x", "y").agg(F.min(F.struct("_d2", "ord")).alias("_best"))
    return points.join(found, ["x", "y"]).groupBy(*keys).agg(F.min("_best").alias("_best")).select(*keys, "_best.ord")


def boundary_of_point(index: Column, count: Column) -> Column:
    """The barrier of the index-th end point, if its pair is complete."""
    pair = F.floor(index / 2)
    return F.when(pair * 2 + 1 < count, pair)


def snap(value: Column, h: float, n: int) -> Column:
    """The coordinate of the nearest cell."""
    return F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), F.round(value / h))) * h


def to_physical(mx: Column, my: Column, w: float, h: float, lx: float, ly: float) -> tuple[Column, Column]:
    """Screen to physical coordinates; the screen's y runs downwards."""
    return mx / w * lx, (1.0 - my / h) * ly


def slider_value(t: Column, low: float, high: float) -> Column:
    """The value at a share of a slider's bar, clamped to it."""
    return low + F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) * (high - low)


def add_source(sources: DataFrame, row: dict, grid: Grid) -> DataFrame:
    """Append a source snapped to a cell; beyond MAX_SOURCES nothing is added."""
    if sources.count() >= MAX_SOURCES:
        return sources
    (hx, hy), (nx, ny) = grid.spacing, grid.dims
    near = lambda v, h, n: max(0, min(n - 1, math.floor(v / h + 0.5))) * h
    row = {**row, "x": near(row["x"], hx, nx), "y": near(row["y"], hy, ny)}
    return sources.unionByName(sources.sparkSession.createDataFrame([row], sources.schema))


def move_source(sources: DataFrame, ord_: int, x: float, y: float) -> DataFrame:
    here = F.col("ord") == ord_
    return sources.withColumns({"x": F.when(here, x).otherwise(F.col("x")), "y": F.when(here, y).otherwise(F.col("y"))})


def delete_source(sources: DataFrame, ord_: int) -> DataFrame:
    """Deleted sources stay as inactive rows."""
    return sources.withColumn("active", F.col("active") & (F.col("ord") != ord_))


def clear_sources(sources: DataFrame) -> DataFrame:
    return sources.withColumn("active", F.lit(False))


def frame_interval(steps: int, frames: int) -> int:
    return max(1, steps // (frames - 1)) if frames > 1 else steps


def frames(df: DataFrame, steps: int, count: int, step_col: str = "step") -> DataFrame:
    return df.where(F.col(step_col) % frame_interval(steps, count) == 0)


def paint(path: Iterable[tuple[float, float]], least: float = 0.1) -> list[tuple[float, float]]:
    """Of a pointer's path, the points at least so far from the last one taken."""
    out: list[tuple[float, float]] = []
    for x, y in path:
        if not out or math.hypot(x - out[-1][0], y - out[-1][1]) >= least:
            out.append((x, y))
    return out


def painted(points: DataFrame, by: Sequence[str], order: str, least: float = 0.1) -> DataFrame:
    """``paint`` for many paths at once, each an ordered fold within its row."""
    path = F.array_sort(F.collect_list(F.struct(order, "x", "y")))
    last = lambda a: F.element_at(a, -1)
    far = lambda a, p: (p["x"] - last(a)["x"]) ** 2 + (p["y"] - last(a)["y"]) ** 2 >= least * least
    rows = points.groupBy(*by).agg(path.alias("_path"))
    kind = rows.schema["_path"].dataType.simpleString()
    taken = F.aggregate("_path", F.array().cast(kind), lambda a, p: F.when((F.size(a) == 0) | far(a, p), F.concat(a, F.array(p))).otherwise(a))
    return rows.select(*by, F.explode(taken).alias("_p")).select(*by, "_p.*")


def speed(domain: Domain, c: float) -> Domain:
    """Another wave speed; stepping takes the coefficient from the domain, so it follows."""
    return replace(domain, c=c)
