"""Solvers, graphs, barriers, expressions, grids and matrices that live in tables, against small brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfield.operators import barriers, boundary, forest, graph, krylov, lattice, tiles


def table(spark, edges, n):
    nodes = spark.createDataFrame([(f"v{i}", i) for i in range(n)], "var string, ord int")
    return nodes, spark.createDataFrame([(f"v{a}", f"v{b}") for a, b in edges], "var string, dep string")


def levels_of(edges, n):
    """Longest path to each node along its dependencies; None on or above a cycle."""
    deps = {i: {b for a, b in edges if a == i} for i in range(n)}
    level, left = {}, set(range(n))
    while True:
        free = [i for i in left if all(d in level for d in deps[i])]
        if not free:
            return [level.get(i) for i in range(n)]
        for i in free:
            level[i] = max((level[d] + 1 for d in deps[i]), default=0)
        left -= set(free)


def reach(edges, n):
    r = np.eye(n, dtype=bool)
    for a, b in edges:
        r[a, b] = True
    for k in range(n):
        r |= r[:, k : k + 1] & r[k]
    return r


@pytest.mark.parametrize("seed", [1, 2])
def test_graphs_against_brute_force(spark, seed):
    r = random.Random(seed)
    n = 24
    edges = list({(a, b) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(26)) if a != b})
    acyclic = list({(max(e), min(e)) for e in edges})
    nodes, e = table(spark, acyclic, n)
    got = {x.var: x.level for x in graph.topological_levels(nodes, e, "evaluation")[0].collect()}
    assert [got.get(f"v{i}") for i in range(n)] == levels_of(acyclic, n)
    nodes, e = table(spark, edges, n)
    assert {x.var: x.depth for x in graph.depth(nodes, e).collect()} == {f"v{i}": d for i, d in enumerate(levels_of(edges, n))}
    both = reach(edges, n)
    want = {f"v{i}": int(np.flatnonzero(both[i] & both[:, i])[0]) for i in range(n)}
    assert {x.var: x.scc for x in graph.components(nodes, e).collect()} == want
    path = {}
    for x in graph.cycles(nodes, e).collect():
        path.setdefault(x.cycle, {})[x.pos] = int(x.var[1:])
        assert x.length >= 2
    for c, at in path.items():
        ring = [at[k] for k in range(len(at))]
        assert ring[0] == c == min(ring) and all((a, b) in edges for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
    cyclic = any(d is None for d in levels_of(edges, n))
    assert bool(path) == cyclic and graph.cycle_path(nodes, e).count() == cyclic


def test_a_deep_chain_and_a_long_ring_take_few_rounds(spark, monkeypatch):
    n, jobs = 1000, []
    old = graph.saved
    monkeypatch.setattr(graph, "saved", lambda *a: jobs.append(1) or old(*a))
    nodes, chain = table(spark, [(i + 1, i) for i in range(n - 1)], n)
    levels, fine = graph.topological_levels(nodes, chain, "evaluation")
    assert fine and levels.agg(F.max("level")).first()[0] == n - 1 and len(jobs) <= 16
    nodes, loop = table(spark, [(0, 0), (1, 0), (2, 3), (3, 2)], 4)
    row = graph.cycle_path(nodes, loop).first()
    assert (row.path, row.length) == (["v0"], 1)


def test_krylov_against_numpy(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(7, 7)) + 7 * np.eye(7)
    b = rng.normal(size=7)
    entries = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(7) for j in range(7)], "r int, c int, a double")
    right = spark.createDataFrame([(i, float(b[i])) for i in range(7)], "r int, b double")
    x, reached = krylov.gmres(right, ["r"], krylov.matrix_product(entries, ["r"], ["c"]), steps=10, tolerance=1e-9)
    assert reached and [v.x for v in x.orderBy("r").collect()] == pytest.approx(np.linalg.solve(a, b))
    assert krylov.gmres(right.withColumn("b", F.lit(0.0)), ["r"], None)[1]
    few = krylov.gmres(right, ["r"], krylov.matrix_product(entries, ["r"], ["c"]), steps=2, tolerance=1e-9)
    assert not few[1]
    # x^2 = b^2 + 1, cell by cell
    start = right.select("r", F.lit(2.0).alias("x"))
    solved = krylov.newton_krylov(start, ["r"], lambda t: t.join(right, "r").select("r", (F.col("x") ** 2 - F.col("b") ** 2 - 1).alias("f")), tolerance=1e-7)
    assert solved.status == "SUCCESS" and [v.x for v in solved.table.orderBy("r").collect()] == pytest.approx(np.sqrt(b**2 + 1))


def test_red_black_sweeps(spark):
    cells = spark.range(25).select((F.col("id") / 5).cast("int").alias("i"), (F.col("id") % 5).cast("int").alias("j"), F.lit(1.0).alias("f"), F.lit(0.0).alias("x"))
    out = krylov.sor(cells, [], ["i", "j"], omega=1.3, tolerance=1e-8)
    a = np.zeros((25, 25))
    for k in range(25):
        a[k, k] = 4
        for d, ok in ((-5, k >= 5), (5, k < 20), (-1, k % 5 > 0), (1, k % 5 < 4)):
            if ok:
                a[k, k + d] = -1
    assert out.status == "SUCCESS" and [v.x for v in out.table.orderBy("i", "j").collect()] == pytest.approx(np.linalg.solve(a, np.ones(25)))
    assert krylov.sor(cells, [], ["i", "j"], omega=1.3, sweeps=2).status == "MAX_ITER"


def test_barrier_table_is_the_case_chain(spark):
    r = random.Random(6)
    planes = [([0.0, 1.0], [3.0, 2.0], [-1.0], [2.0]), ([1.0, 1.0], [2.0, 2.0], [-3.0], [3.0]), ([1.0, -1.0], [4.0, 4.0], [-9.0], [1.0]), ([2.0, 0.0], [0.5, 1.0], [-1.0], [1.0])]
    points = [(k, r.randrange(-4, 18) * 0.5, r.randrange(-4, 18) * 0.5) for k in range(400)]
    df = spark.createDataFrame(points, "id int, x double, y double")
    chain = boundary.near_boundary([boundary.Barrier.make(*p) for p in planes], [F.col("x"), F.col("y")])
    want = {v.id: v.bid or None for v in df.select("id", chain.alias("bid")).collect()}
    data = spark.createDataFrame([(k + 1, *p, True) for k, p in enumerate(planes)] + [(0, *planes[0], False)], "bid int, normal array<double>, point array<double>, low array<double>, high array<double>, active boolean")
    assert len(set(want.values())) == 5
    for size in (0.7, 3.0):
        assert {v.id: v.bid for v in barriers.near_barriers(df, "id", ["x", "y"], data, size).collect()} == want


def test_expression_hashes(spark):
    # (a + b) * 2, 2 * (b + a), (a @ b), (b @ a), a lone leaf, and a broken tree
    nodes = [(e, k, op, label) for e in (1, 2) for k, op, label in ((1, "var", "a"), (2, "var", "b"), (3, "+", None), (4, "lit", "2"), (5, "*", None))]
    nodes += [(e, k, op, label) for e in (3, 4) for k, op, label in ((1, "var", "a"), (2, "var", "b"), (3, "@", None))] + [(5, 1, "var", "a"), (6, 1, "+", None)]
    edges = [(1, 3, 0, 1), (1, 3, 1, 2), (1, 5, 0, 3), (1, 5, 1, 4), (2, 3, 0, 2), (2, 3, 1, 1), (2, 5, 0, 4), (2, 5, 1, 3), (3, 3, 0, 1), (3, 3, 1, 2), (4, 3, 0, 2), (4, 3, 1, 1), (6, 1, 0, 7)]
    nodes = spark.createDataFrame(nodes, "expr int, node int, op string, label string")
    edges = spark.createDataFrame(edges, "expr int, parent int, pos int, child int")
    top = forest.hashes(nodes, edges).join(forest.roots(nodes, edges), ["expr", "node"])
    got = {x.expr: x for x in top.collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[1].hash == got[2].hash and got[3].hash != got[4].hash and got[1].size == 5
    assert got[5].hash == hashlib.sha256(b"var|a|").hexdigest()
    assert {x.expr: x.is_new for x in forest.registered(top).collect()} == {1: True, 2: False, 3: True, 4: True, 5: True}
    assert {(x.expr, x.name): x.n for x in forest.variable_counts(nodes).collect()}[1, "a"] == 1


@pytest.mark.parametrize("shape", [(5,), (4, 3), (3, 4, 2, 3, 3)])
def test_lattices_against_numpy(spark, shape):
    rng = np.random.default_rng(1)
    u = rng.integers(0, 9, shape).astype(float)
    g = lattice.Lattice(shape, (0.5,) * len(shape))
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(u.ravel())], "pos long, u double")
    want = np.zeros(shape)
    for a in range(len(shape)):
        if shape[a] > 2:
            mid = np.diff(u, 2, axis=a) / 0.25
            want[tuple(slice(1, -1) if b == a else slice(None) for b in range(len(shape)))] += mid
    assert [r.lap for r in g.laplacian(df).orderBy("pos").collect()] == pytest.approx(want.ravel())
    slopes = [np.gradient(u, 0.5, axis=a) for a in range(len(shape))]
    for r in g.gradient(df).collect():
        assert [r[f"d{a}"] for a in range(len(shape))] == pytest.approx([s.ravel()[r.pos] for s in slopes])
    assert g.total == u.size and g.densify(df.where("pos < 2")).where("u = 0").count() >= u.size - 2
    with pytest.raises(ValueError):
        lattice.Lattice((2, 2), (1.0,))


def test_tiles_against_numpy(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 3, (13, 10)), rng.integers(-2, 3, (10, 7))
    entries = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "row int, col int, v double")
    got = {(r.row, r.col): r.v for r in tiles.entries(tiles.matmul(tiles.tiled(entries(a), 4), tiles.tiled(entries(b), 4), 4, most=2), 4).collect()}
    assert got == {(i, j): v for (i, j), v in np.ndenumerate(a @ b) if v}
    turned = {(r.row, r.col): r.v for r in tiles.entries(tiles.transposed(tiles.tiled(entries(a), 4), 4), 4).collect()}
    assert turned == {(j, i): v for (i, j), v in np.ndenumerate(a) if v}
