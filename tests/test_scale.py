"""Crowds, sparse blocks and long tables: cases whose work used to grow with a product."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfield.functions.expr import var
from sparkfield.operators import barriers, blocks, boundary, forest, graph, krylov, solvers, systems, tiles, wave
from sparkfield.plans import queries_tables
from sparkfield.plans.durable import BROADCAST_ROWS, saved

from .conftest import SF

CROWD = 100_000


def test_nearest_in_a_crowd(spark):
    at = spark.range(CROWD)
    points = at.select("id", F.lit(1.0).alias("x"), (F.col("id") % 2).cast("double").alias("y"))
    sources = at.select(F.col("id").alias("ord"), F.lit(1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(2.0).alias("radius"), (F.col("id") > 6).alias("active"))
    got = wave.nearest_source(points, sources, ["id"], 2.0)
    assert got.columns == ["id", "ord"] and got.count() == CROWD and got.where("ord <> 7").isEmpty()
    last = wave.nearest_barrier_point(points, sources.select(F.col("ord").alias("bord"), F.col("x").alias("bx"), F.col("y").alias("by")), 1.5, ["id"])
    assert last.count() == CROWD and last.where(F.col("bord") != CROWD - 1).isEmpty()


def test_planes_in_a_crowd(spark):
    at = spark.range(CROWD)
    planes = at.select(F.col("id").alias("bid"), F.array(F.lit(0.0), F.lit(1.0)).alias("normal"), F.array(F.lit(0.0), F.lit(0.0)).alias("point"), F.array(F.lit(-1.0)).alias("low"), F.array(F.lit(1.0)).alias("high"), (F.col("id") > 4).alias("active"))
    points = at.select("id", F.lit(0.5).alias("x"), (F.col("id") % 2).cast("double").alias("y"))
    got = barriers.near_barriers(points, "id", ["x", "y"], planes, 2.0)
    assert got.count() == CROWD and {(r.y, r.bid) for r in got.groupBy((F.col("id") % 2).alias("y"), "bid").count().collect()} == {(0, 5), (1, None)}


@pytest.mark.parametrize("dims", [1, 2, 3, 4])
def test_batches_of_planes_are_single_planes(dims):
    r = np.random.default_rng(dims)
    n = np.concatenate([r.integers(-1, 2, (60, dims)), r.normal(size=(60, dims))])
    n = n[np.abs(n).sum(1) > 0]
    p, low, high = r.normal(size=(len(n), dims)), -r.random((len(n), dims - 1)), r.random((len(n), dims - 1))
    normal, directions, box_low, box_high = barriers._framed(n, p, low, high)
    for k, b in enumerate(boundary.Barrier.make(*v) for v in zip(n, p, low, high, strict=True)):
        assert (tuple(normal[k]), tuple(map(tuple, directions[k])), (tuple(box_low[k]), tuple(box_high[k]))) == (b.normal, b.directions, b.box)


def test_blocks_cost_what_they_hold(spark):
    n = 20_000
    entries = spark.range(n).select((F.col("id") * 64).alias("row"), (F.col("id") * 64 + 1).alias("col"), F.lit(2.0).alias("v"))
    a = tiles.tiled(entries)
    assert a.agg(F.max(F.size("at"))).first()[0] == 1  # a dense block is 32 KB
    got = tiles.entries(tiles.matmul(a, tiles.transposed(a)))
    assert got.count() == n and got.where("row <> col or v <> 4").isEmpty()


@pytest.mark.parametrize("small", [0, 5, 256])
def test_hashes_within_rows_are_those_by_levels(spark, small):
    nodes = [(e, k, "lit" if k < e else "+" if k % 2 else "-", str(k % 3) if k < e else None) for e in range(1, 8) for k in range(2 * e - 1)] + [(9, 0, "+", None), (9, 1, "-", None), (9, 2, "var", "x")]
    edges = [(e, k, p, c) for e in range(1, 8) for k in range(e, 2 * e - 1) for p, c in ((1, k - e), (0, k - 1))] + [(9, 0, 0, 1), (9, 1, 0, 0), (9, 1, 1, 2)]
    nodes, edges = spark.createDataFrame(nodes, "expr int, node int, op string, label string"), spark.createDataFrame(edges, "expr int, parent int, pos int, child int")
    rows = lambda df: sorted(map(tuple, df.select("expr", "node", "hash", "size").collect()))
    want = rows(forest._by_levels(nodes, edges, forest.COMMUTATIVE))
    assert rows(forest.hashes(nodes, edges, small=small)) == want and len(want) == 50
    tops = {(r.expr, r.node) for r in forest.roots(nodes, edges).collect()}
    assert rows(forest.hashes(nodes, edges, roots_only=True, small=small)) == [r for r in want if r[:2] in tops]


@pytest.mark.parametrize("batch", [1, 7, 100_000])
@pytest.mark.parametrize("small", [0, 5, 256])
def test_streamed_terms_are_hashed_as_by_levels(spark, monkeypatch, batch, small):
    """Expressions cut by the ends of batches, children in one place or in none, a cycle, a missing child, an edge of no node, a shared child."""
    monkeypatch.setattr(forest, "BATCH", batch)
    nodes = [(e, k, "+" if k % 3 == 2 else "f" if k < 6 else "g", None if k % 2 else str(k % 4)) for e in range(12) for k in range(e + 1)] + [(20, 0, "f", None), (21, 0, "f", None), (21, 1, "g", None), (22, 0, "f", None)]
    edges = [(e, k, [None, 0, 0, 1][(k + j) % 4], k - j) for e in range(12) for k in range(e + 1) for j in (1, 2) if k >= j] + [(20, 0, 0, 9), (21, 0, 0, 1), (21, 1, 0, 0), (22, 7, 0, 0)]
    nodes, edges = spark.createDataFrame(nodes, "expr int, node int, op string, label string"), spark.createDataFrame(edges, "expr int, parent int, pos int, child int")
    want = sorted(map(tuple, forest._by_levels(nodes, edges, forest.COMMUTATIVE).select("expr", "node", "hash", "size").collect()))
    terms = forest.terms(nodes, edges).repartition(1).sortWithinPartitions("expr").toArrow().combine_chunks().to_batches(max_chunksize=3)
    for roots_only in (False, True):
        got = [r for b in forest._hashed(iter(terms), frozenset(forest.COMMUTATIVE), roots_only, small) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        large = {e for e, n, *_ in got if n is None}
        n = {e: sum(v.count() for v in (nodes.where(F.col("expr") == e), edges.where(F.col("expr") == e))) for e in (1, 2, 5, 22)} if batch == 1 else {}
        assert all((e in large) == (k > small) for e, k in n.items())
        tops = {(e, e) for e in range(12)}
        assert sorted(r for r in got if r[1] is not None) == [r for r in want if r[0] not in large and (not roots_only or r[:2] in tops)]


@pytest.mark.parametrize("small", [5, 256])
def test_hashes_of_terms_in_one_pass(spark, small):
    edges = spark.range(1, 30).select((F.col("id") % 3).alias("expr"), F.expr("id div 3").alias("child")).where("child > 0 and child < 3 + 3 * expr").select("expr", (F.col("child") - 1).alias("parent"), F.lit(0).alias("pos"), "child")
    nodes = spark.range(30).select((F.col("id") % 3).alias("expr"), F.expr("id div 3").alias("node"), F.lit("f").alias("op"), F.lit("a").alias("label"))
    rows = lambda df: sorted(map(tuple, df.select("expr", "node", "hash", "size").collect()))
    for roots_only in (False, True):
        got = forest.hashes_of_terms(forest.terms(nodes, edges), roots_only=roots_only, small=small)
        assert rows(got) == rows(forest.hashes(nodes, edges, roots_only=roots_only, small=small))
    assert "MapInArrow" not in got._jdf.queryExecution().toString()  # hashed once, however often it is read


def test_orders_are_dealt_and_sorted_once(spark):
    """Lines meet by order for their numbers; their terms are neither shuffled nor sorted again."""
    plan = forest._in_tasks(queries_tables._order_terms(spark, SF), forest.COMMUTATIVE, True, 256)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1, plan


def test_tails_are_not_doubled(spark, monkeypatch):
    """A ring of 8 with 3,000 nodes behind it: pointers are doubled on the ring only."""
    rounds, old = [], graph._rounds
    monkeypatch.setattr(graph, "_rounds", lambda n: rounds.append(n) or old(n))
    nodes = spark.range(3008).select(F.col("id").cast("string").alias("var"), F.col("id").alias("ord"))
    edges = nodes.select("var", F.when(F.col("ord") < 8, (F.col("ord") + 1) % 8).otherwise(F.col("ord") % 8).cast("string").alias("dep"))
    assert {(r.pos, r.var, r.length) for r in graph.cycles(nodes, edges).collect()} == {(k, str(k), 8) for k in range(8)}
    assert max(rounds) == 8
    rounds.clear()
    got = {r.var: r.scc for r in graph.components(nodes, edges).collect()}
    assert got == {str(k): 0 if k < 8 else k for k in range(3008)} and max(rounds) == 8


def test_long_tables_of_few_bytes_are_not_broadcast(spark):
    long = saved(spark.range(BROADCAST_ROWS + 1).select("id", F.lit(0.0).alias("x")))
    plan = long.join(long.withColumnRenamed("x", "y"), "id")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_saved_texts_of_some_megabytes_are_not_broadcast(spark):
    """90,000 texts as keys were 21 MB when broadcast, and a graph's rounds broadcast about a hundred tables."""
    names = saved(spark.range(60_000).select(F.concat(F.lit("o"), "id").alias("var"), "id"))
    joined = names.join(names.withColumnRenamed("id", "other"), "var")
    assert joined.where("id = other").count() == 60_000
    plan = joined._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.fixture
def grids(spark, monkeypatch):
    """Two grids with a hole, each in four blocks: cells, loads and neighbours' matrix."""
    monkeypatch.setattr(blocks, "CELLS", 49)
    at = [(i, j) for i in range(7) for j in range(9) if (i, j) != (3, 4)]
    a = np.array([[float(abs(i - k) + abs(j - m) == 1) for k, m in at] for i, j in at])
    loads = np.random.default_rng(7).random(len(at))
    df = spark.createDataFrame([(g, i - 5, j, float(f) * g, 2.0) for g in (1, 2) for (i, j), f in zip(at, loads, strict=True)], "g int, i int, j int, f double, x double")
    return df, loads, a


def test_sweeps_in_blocks(grids, monkeypatch):
    df, loads, a = grids
    tables, old = [], krylov.saved
    monkeypatch.setattr(krylov, "saved", lambda *a: tables.append(1) or old(*a))
    out = krylov.sor(df, ["g"], ["i", "j"], omega=1.4, tolerance=1e-6)
    want = np.linalg.solve(4.0 * np.eye(len(a)) - a, loads)
    assert out.status == "SUCCESS" and [r.x for r in out.table.orderBy("g", "i", "j").collect()] == pytest.approx(np.concatenate([want, 2 * want]), abs=1e-6)
    assert len(tables) <= out.iterations / 2  # a table for each colour before


def test_krylov_in_blocks(grids):
    """Not linear, and the neighbours matter."""
    df, loads, a = grids
    sides = ((-1, 0), (1, 0), (0, -1), (0, 1))
    out = krylov.newton_krylov_blocks(df, ["g"], ["i", "j"], ["f"], lambda near, own: 9 * near((0, 0)) + 0.1 * near((0, 0)) ** 2 - sum(near(s) for s in sides) * 0.1 - own["f"], tolerance=1e-3)
    x = np.array([r.x for r in out.table.orderBy("g", "i", "j").collect()]).reshape(2, -1)
    assert out.status == "SUCCESS" and x.min() > 0.001
    assert 9 * x + 0.1 * x**2 - 0.1 * x @ a == pytest.approx(np.stack([loads, 2 * loads]), abs=1e-3)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_batches_of_krylov_spaces_are_single_ones(n):
    r = np.random.default_rng(n)
    a, b = r.normal(size=(50, n, n)), r.normal(size=(50, n))
    a[:5] = np.diag(np.arange(n))  # singular
    a[5:9], b[9] = np.eye(n), 0.0
    calls = []
    x, reached = solvers.gmres_rows(lambda v: calls.append(1) or np.einsum("kij,kj->ki", a, v), b)
    assert len(calls) <= n  # one product for all rows in a step
    for k in range(50):
        want, fine = solvers.gmres(lambda v, k=k: a[k] @ v, b[k])
        assert reached[k] == fine and x[k] == pytest.approx(want, rel=1e-5, abs=1e-8)


def test_krylov_of_hard_rows(spark):
    """A row that is solved, one that cannot be, and one without a finite residual, beside each other."""
    x = var("x")
    df = spark.createDataFrame([(0, 4.0), (1, -1.0), (2, float("nan"))], "id int, s double")
    out = {r.id: r for r in solvers.newton_krylov(df.coalesce(1), systems.System((x * x - var("s"),), ("x",), max_iterations=30), ["id"], {"x": 1.0}).collect()}
    assert (out[0].status, round(out[0].x, 5), out[1].status, out[1].iterations, out[2].status) == ("SUCCESS", 2.0, "MAX_ITER", 30, "DIVERGED")


def test_depths_by_two_ways_take_few_tables(spark, monkeypatch):
    """Each key depends on its half and its third: a round is a table of terms, a state and jumps."""
    tables, old = [], graph.saved
    monkeypatch.setattr(graph, "saved", lambda *a: tables.append(1) or old(*a))
    n = 40
    nodes = spark.range(1, n).select(F.col("id").cast("string").alias("var"), F.col("id").alias("ord"))
    edges = spark.createDataFrame([(str(k), str(d)) for k in range(1, n) for d in {k // 2, k // 3} if 0 < d < k], "var string, dep string")
    want = {0: -1}
    for k in range(1, n):
        want[k] = 1 + max(want[k // 2], want[k // 3])
    assert {int(r.var): r.depth for r in graph.depth(nodes, edges).collect()} == {k: want[k] for k in range(1, n)}
    assert len(tables) <= 20, len(tables)
