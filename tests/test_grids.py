"""Grids, stencils and barriers."""

import pytest
from pyspark.sql import functions as F

from sparkfield.operators import boundary, stencil
from sparkfield.operators import grid as grids
from sparkfield.operators.boundary import Barrier, Boundary
from sparkfield.operators.grid import Grid


def row(df, *index):
    for name, v in zip("ijk", index):
        df = df.where(F.col(name) == v)
    return df.first()


def test_metadata_and_addressing(spark):
    g = Grid((10, 20, 1), (0.1, 0.2, 1.0))
    assert g.total_points == 200 and g.extent == pytest.approx((1.0, 4.0, 1.0))
    g = Grid((5, 4, 3), (1.0, 1.0, 1.0))
    p = g.points(spark).withColumn("p", g.linear())
    assert p.agg(F.count_distinct("p"), F.max("p")).first()[:] == (60, 59)
    assert row(p, 2, 1, 2).p == 2 * 12 + 1 * 3 + 2
    g = Grid((10, 10), (0.1, 0.1), (-0.5, -0.5))
    at = g.nearest(F.lit(0.15), F.lit(-0.2))
    assert spark.range(1).select(at["i"], at["j"]).first()[:] == (7, 3) or spark.range(1).select(at["i"], at["j"]).first()[:] == (6, 3)
    out = g.nearest(F.lit(0.7), F.lit(0.0))["i"]
    assert spark.range(1).select(out).first()[0] is None
    assert grids.axis_from_name("y") == 1 and grids.axis_name(0) == "x" and grids.axis_from_name("?") is None


def test_fields(spark):
    g = Grid((5, 5), (1.0, 1.0))
    u = g.init(spark, lambda x, y: x * x + y * y)
    assert [row(u, *p).u for p in ((2, 2), (0, 0), (4, 0))] == [8, 0, 16]
    assert row(grids.add(u, g.fill(spark, 1.0), g), 2, 2).u == 9 and row(grids.multiply(u, u, g), 2, 2).u == 64
    assert g.fill(spark, 1.2).agg(grids.norm()).first()[0] == pytest.approx(6)
    assert u.where(g.is_boundary()).count() == 16
    points = spark.createDataFrame([(1, 1.6, 2.4), (2, 9.0, 9.0)], "pid int, x double, y double")
    assert {r.pid: r.u for r in g.sample(u, points, ["x", "y"]).collect()} == {1: 8.0, 2: None}


@pytest.mark.parametrize("kind", boundary.KINDS)
def test_edges(spark, kind):
    g = Grid((6, 6), (0.5, 0.5))
    for axis in (0, 1):
        for side in (0, 1):
            g = g.with_boundary(axis, side, Boundary(kind, 4.0))
    u = g.init(spark, lambda x, y: x * x)
    d = u.select("i", "j", stencil.derivative(g, 0, 1).alias("d1"), stencil.derivative(g, 0, 2).alias("d2"))
    first, last = row(d, 0, 3), row(d, 5, 3)
    want = {"DIRICHLET": (-3.75, (4.0 - 0 + 0.25) / 0.25, 0.0, (4 - 2 * 6.25 + 4) / 0.25), "REFLECT": (0, 2, 0, 2), "OPEN": (0.5, 0, 4.5, 0)}.get(kind, (0.5, 2, 4.5, 2))
    assert (first.d1, first.d2, last.d1, last.d2) == pytest.approx(want)
    assert row(d, 2, 0).d1 == pytest.approx(2.0) and row(d, 2, 0).d2 == pytest.approx(2.0)
    assert row(u.select("i", "j", stencil.laplacian(Grid((6, 6), (0.5, 0.5))).alias("v")), 2, 2).v == pytest.approx(2.0)


def test_line_by_shift_equals_window(spark):
    for kind in boundary.KINDS:
        g = Grid((9,), (0.5,), boundaries=(Boundary(kind, 1.0), Boundary(kind, 2.0)))
        u = g.init(spark, lambda x: x * x * x)
        for order in (1, 2):
            a = {r.i: r.d for r in u.select("i", stencil.derivative(g, 0, order).alias("d")).collect()}
            b = {r.i: r.du for r in stencil.derivative_by_shift(u, g, order).collect()}
            assert a == pytest.approx(b)


def test_derivative_errors():
    for bad in (lambda: stencil.derivative(Grid((2, 5), (1.0, 1.0)), 0, 1), lambda: stencil.derivative(Grid((5,), (1.0,)), 0, 3), lambda: Boundary("NONE"), lambda: Grid((5,), (1.0,)).with_boundary(0, 0, Boundary("OPEN", func=lambda x, t: x))):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize(
    ("normal", "point", "low", "high", "inside", "outside"),
    [
        ((0, 1), (4.5, 5), (-2.5,), (2.5,), [(4.5, 5), (2, 5), (7, 5)], [(1, 5), (8, 5), (4.5, 6)]),
        ((1, 0), (4, 3.5), (-1.5,), (1.5,), [(4, 3.5), (4, 2), (4, 5)], [(4, 1), (4, 6), (5, 3.5)]),
        ((1, 1), (4.5, 4.5), (-2.0,), (2.0,), [(4.5, 4.5), (4, 5)], [(8, 1), (5, 5)]),
        ((0, 0, 1), (4.5, 5.5, 5), (-1.5, -2.5), (1.5, 2.5), [(4.5, 5.5, 5), (3, 3, 5)], [(4.5, 5.5, 6), (2, 5.5, 5)]),
        ((1, 0, 0), (2, 2, 2), (-1.0, -1.0), (1.0, 1.0), [(2, 2, 2), (2, 3, 1)], [(2, 4, 2), (2, 2, 4)]),
        ((0, 1), (0, 3), None, None, [(0, 3), (100, 3)], [(0, 4)]),
    ],
)
def test_bounded_hyperplanes(spark, normal, point, low, high, inside, outside):
    b = Barrier.make(normal, point, low, high, grid_box=((0.0,) * len(normal), (9.0,) * len(normal)))
    rows = [(list(map(float, p)), True) for p in inside] + [(list(map(float, p)), False) for p in outside]
    df = spark.createDataFrame(rows, "c array<double>, want boolean")
    coords = [F.col("c")[k] for k in range(len(normal))]
    bad = df.where(b.holds(coords, 1e-10) != F.col("want")).collect()
    assert not bad


def test_parity_basis_collapses_and_fixed_one_does_not():
    assert boundary.basis((1.0, 0.0, 0.0), strict_parity=True)[1] == (0.0, 0.0, 0.0)
    assert boundary.basis((1.0, 0.0, 0.0)) == [(0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]


def test_reflecting_barrier(spark):
    g = Grid((11, 11), (1.0, 1.0)).with_barrier((1.0, 0.0), (5.0, 5.0), (-2.0,), (2.0,))
    u = g.init(spark, lambda x, y: x * x)
    d = u.select("i", "j", stencil.derivative(g, 0, 1).alias("d1"), stencil.derivative(g, 0, 2).alias("d2"))
    assert row(d, 5, 5).d1 == 0 and row(d, 5, 5).d2 == 0 and row(d, 5, 9).d1 == 10 and row(d, 8, 5).d2 == 2
