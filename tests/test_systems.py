"""Solvers, graphs, environments and waves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfield.functions.expr import scalar, var
from sparkfield.operators import env, graph, render, solvers, wave
from sparkfield.operators.boundary import Boundary
from sparkfield.operators.grid import Grid
from sparkfield.operators.systems import System
from sparkfield.streaming import control

x, y, z = var("x"), var("y"), var("z")


def solve(spark, method, equations, names, guess=None, **kw):
    rows = spark.createDataFrame([(1, 0.0)], "id long, none double")
    return method(rows, System(tuple(equations), tuple(names), **kw), ["id"], guess).first()


@pytest.mark.parametrize(
    ("equations", "names", "guess", "want"),
    [
        ([x + y - 7.0, x - y - 3.0], "xy", {}, [5, 2]),
        ([2.0 * x + y - 5.0, x + 3.0 * y - 8.0], "xy", {}, [1.4, 2.2]),
        ([2.0 * x + y - 5.0, x + 3.0 * y - 5.0], "xy", {}, [2, 1]),
        ([x + y + z - 6.0, 2.0 * x - y + z - 5.0, x + 2.0 * y - z - 6.0], "xyz", {}, [3, 2, 1]),
        ([x * x + y * y - 25.0, x + y - 7.0], "xy", {"x": 4.5, "y": 2.5}, [4, 3]),
        ([x * x - 4.0, y - 2.0 * x], "xy", {"x": 2.5, "y": 5.0}, [2, 4]),
        ([x * x - 4.0], "x", {"x": -3.0}, [-2]),
    ],
)
@pytest.mark.parametrize("method", [solvers.newton, solvers.newton_krylov])
def test_newton(spark, method, equations, names, guess, want):
    r = solve(spark, method, equations, names, guess)
    assert r.status == "SUCCESS"
    assert [r[n] for n in names] == pytest.approx(want, abs=1e-4)


def test_failures(spark):
    assert solve(spark, solvers.newton, [x + y - 1.0, x + y - 1.0], "xy").message == "Singular Jacobian matrix"
    assert solve(spark, solvers.newton, [x - 1.0, x - 2.0], "x").status == "INVALID_SYSTEM"
    assert solve(spark, solvers.fixed_point, [x * 100.0 + 1.0], "x").status == "DIVERGED"
    assert solve(spark, solvers.newton, [x * x + 1.0], "x", {"x": 0.5}, max_iterations=20).status in ("MAX_ITER", "DIVERGED")
    assert solve(spark, solvers.sor, [x - 1.0], "x").message == "SOR not yet implemented"
    r = solvers.sor(spark.range(1).select(F.col("id")), System((4.0 * x + y - 6.0, x + 3.0 * y - 7.0), ("x", "y")), ["id"], omega=1.1).first()
    assert (r.x, r.y) == pytest.approx((1, 2), abs=1e-5)
    assert solve(spark, solvers.newton, [2.0 * x - 10.0], "x").iterations == 2


def test_gmres_and_elimination():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(6, 6)) + 6 * np.eye(6), rng.normal(size=6)
    got, ok = solvers.gmres(lambda v: a @ v, b)
    assert ok and a @ got == pytest.approx(b)
    assert solvers.gmres(lambda v: v, np.zeros(3)) == (pytest.approx(np.zeros(3)), True)
    s, fine = solvers.eliminate(np.stack([a, np.zeros((6, 6))]), np.stack([b, b]))
    assert fine.tolist() == [True, False] and a @ s[0] == pytest.approx(b)


def names(df):
    return sorted(r.var for r in df.collect())


def test_graph(spark):
    chain = graph.from_definitions(spark, {"a": var("b") + var("c"), "b": var("c") * 2.0, "c": scalar(1)})
    assert graph.detect_cycles(*chain) == "ACYCLIC" and graph.depends_on(chain[1], "a", "c") and not graph.depends_on(chain[1], "c", "a")
    levels, fine = graph.topological_levels(*chain)
    assert fine and {r.var: r.level for r in levels.collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r.var: r.level for r in graph.topological_levels(*chain, "evaluation")[0].collect()} == {"c": 0, "b": 1, "a": 2}
    assert {r.var: r.depth for r in graph.depth(*chain).collect()} == {"a": 2, "b": 1, "c": 0}
    assert names(graph.dependents(chain[1], "c")) == ["a", "b"]
    ring = graph.from_definitions(spark, {"x": x + y, "y": y + z, "z": x + z, "t": x + 1.0})
    assert graph.detect_cycles(*ring) == "SELF_REFERENTIAL" and graph.detect_cycles(ring[0], ring[1].where("var <> dep")) == "HAS_CYCLES"
    assert {r.var: r.scc for r in graph.components(*ring).collect()} == {"x": 0, "y": 0, "z": 0, "t": 3}
    assert graph.structure(*ring).first().sizes == [1, 3]
    assert {r.var: r.depth for r in graph.depth(*graph.from_definitions(spark, {"a": var("missing") + 1.0, "b": var("a")})).collect()} == {"a": 1, "b": 2}
    assert System((x + y, y - 1.0), ("x", "y")).solve_order(spark) == ["x", "y"]


def test_env(spark):
    old, new = (spark.createDataFrame(r, "name string, v double") for r in ([("a", 1.0), ("b", 2.0)], [("b", 3.0), ("c", 4.0)]))
    as_dict = lambda df: {r.name: r.v for r in df.collect()}
    assert as_dict(env.set_all(old, new, ["name"])) == as_dict(env.merge(old, new, ["name"])) == {"a": 1, "b": 3, "c": 4}
    assert as_dict(env.remove(old, new, ["name"])) == {"a": 1} and env.has(old, new, ["name"]).count() == 1


def test_wave_paths_agree(spark):
    g = Grid((20, 17), (0.5, 0.5))
    u = g.init(spark, lambda a, b: wave.gaussian(a, b, 5.0, 4.0, 1.0, 1.0), "u_curr").withColumn("u_prev", F.col("u_curr"))
    frame = lambda df: {(r.i, r.j): (round(r.u_curr, 9), round(r.u_prev, 9)) for r in df.collect()}
    plain = frame(wave.run(u, g, 0.0625, 5, cut_every=2))
    assert plain == frame(wave.run_tiled(u, g, 0.0625, 5, tile=6, block=2))
    assert plain == frame(wave.run_fused(u.withColumn("s", F.lit(1)), g, 0.0625, 5, ["s"]))
    damped = frame(wave.run(u, g, 0.0625, 3, 4, 0.1))
    assert damped == frame(wave.run_fused(u.withColumn("s", F.lit(1)), g, 0.0625, 3, ["s"], 4, 0.1))
    assert wave.self_energy(2.0, 1.0) == pytest.approx(2 * np.pi)


def test_wave_paths_agree_at_walls(spark):
    frame = lambda df: {(r.i, r.j): (round(r.u_curr, 9), round(r.u_prev, 9)) for r in df.collect()}
    faces = (Boundary("DIRICHLET", 0.3), Boundary("REFLECT"), Boundary("OPEN"), Boundary("NEUMANN"))
    walled = Grid((18, 14), (0.5, 0.5), boundaries=faces)
    barred = Grid((18, 14), (0.5, 0.5)).with_barrier((1.0, 1.0), (4.0, 3.0), (-3.0,), (3.0,)).with_barrier((0.0, 1.0), (2.0, 5.0), (-1.5,), (1.5,), "DIRICHLET")
    for g in (walled, barred):
        u = g.init(spark, lambda a, b: wave.gaussian(a, b, 4.0, 3.0, 1.0, 1.0), "u_curr").withColumn("u_prev", F.col("u_curr"))
        plain = frame(wave.run(u, g, 0.0625, 3))
        assert plain == frame(wave.run_fused(u.withColumn("s", F.lit(1)), g, 0.0625, 3, ["s"]))
        assert plain == frame(wave.run_tiled(u.withColumn("s", F.lit(1)), g, 0.0625, 3, tile=4, block=3, by=["s"]).drop("s"))
    u = u.withColumn("s", F.lit(1))
    assert frame(wave.run_fused(u, g, 0.0625, 3, ["s"], 4, 0.1)) == frame(wave.run_tiled(u, g, 0.0625, 3, tile=2, block=3, width=4, dt=0.1))


def test_sources_and_paint(spark):
    s = spark.createDataFrame([(0, 1.0, 1.0, 1.0, True)], "ord int, x double, y double, radius double, active boolean")
    assert wave.delete_source(s, 0).where("active").count() == 0 and wave.clear_sources(s).where("active").count() == 0
    assert wave.move_source(s, 0, 2.0, 3.0).first().x == 2.0
    g = Grid((10, 10), (0.5, 0.5))
    assert wave.add_source(s, {"ord": 1, "x": 1.3, "y": 9.9, "radius": 1.0, "active": True}, g).where("ord = 1").first()[1:3] == (1.5, 4.5)
    path = [(0.0, 0.0), (0.05, 0.0), (0.1, 0.0), (0.15, 0.0), (0.25, 0.0)]
    assert wave.paint(path) == [(0.0, 0.0), (0.1, 0.0), (0.25, 0.0)]


def test_bmp():
    data = render.bmp_bytes(np.zeros((2, 3, 3), np.uint8))
    assert data[:2] == b"BM" and len(data) == 54 + 2 * 12 and int.from_bytes(data[18:22], "little") == 3


def test_control_stream(spark, tmp_path):
    g = Grid((8, 8), (0.5, 0.5))
    state = {0: g.points(spark).select(F.lit(7).cast("long").alias("sim"), "i", "j", F.lit(0.0).alias("u_curr"), F.lit(0.0).alias("u_prev"))}
    spark.createDataFrame([(7, 1, "wave", 2.0, 2.0, 1.0, 0.5)], control.EVENTS).write.parquet(str(tmp_path / "in"))

    def save(df, n):
        df.write.parquet(str(tmp_path / f"s{n}"))
        state[n + 1] = spark.read.parquet(str(tmp_path / f"s{n}"))

    events = spark.readStream.schema(control.EVENTS).parquet(str(tmp_path / "in"))
    q = control.run(events, lambda n: state[n], save, g, 0.0625, 2, str(tmp_path / "c"))
    q.awaitTermination(60)
    want = control.apply_events(state[0], spark.read.parquet(str(tmp_path / "in")), g)
    want = {(r.i, r.j): round(r.u_curr, 9) for r in wave.run(want, g, 0.0625, 2).collect()}
    assert {(r.i, r.j): round(r.u_curr, 9) for r in state[1].collect()} == want
