"""The engine's registered queries over the star-schema tables, each with its oracle SQL.

Values are whole numbers or dyadic fractions where possible, so that sums do not depend on
their order; elsewhere both sides round to six decimals.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sparkfield.functions import calculus
from sparkfield.functions.expr import derivative_of, einsum, laplacian_of, scalar, substitute, var, variables
from sparkfield.functions.hashing import canonical_hash, register
from sparkfield.operators import boundary, env, graph, render, solvers, stencil, systems, tensor, wave
from sparkfield.operators import grid as grids
from sparkfield.operators.boundary import Boundary
from sparkfield.operators.grid import Grid
from sparkfield.sources import lenses
from sparkfield.sources.lenses import table

from . import compile as plans

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def ints(df, *names):
    return df.withColumns({n: F.col(n).cast("int") for n in names})


def six(c):
    """Six decimals, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


# --- SQL fragments
GRID = """c AS (SELECT CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS i, CAST(l_quantity AS INTEGER) - 1 AS j, CAST(count(*) AS DOUBLE) AS u FROM lineitem GROUP BY 1, 2),
g AS (SELECT CAST(a.i AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, coalesce(c.u, 0.0) AS u FROM (SELECT unnest(range(84)) AS i) a CROSS JOIN (SELECT unnest(range(50)) AS j) b LEFT JOIN c ON c.i = a.i AND c.j = b.j)"""
LINE = """c AS (SELECT CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600) AS INTEGER) AS i, CAST(count(*) AS DOUBLE) AS u FROM events GROUP BY 1),
g AS (SELECT CAST(a.i AS INTEGER) AS i, coalesce(c.u, 0.0) AS u FROM (SELECT unnest(range(744)) AS i) a LEFT JOIN c ON c.i = a.i)"""
MATRIX = """m AS (SELECT vec_id, CAST((p - 1) // 8 AS INTEGER) AS j, CAST((p - 1) % 8 AS INTEGER) AS k, round(CAST(x AS DOUBLE) * 1000) AS v FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings))"""
VECTOR = """m AS (SELECT vec_id, CAST(p - 1 AS INTEGER) AS k, round(CAST(x AS DOUBLE) * 1000) AS v FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings))"""
W_I, W_J, W_L = "(PARTITION BY j ORDER BY i)", "(PARTITION BY i ORDER BY j)", "(ORDER BY i)"


def sql_edges(order: int, kind: str, w: str, side: int, value: str = "0.0", h: str = "0.5", u: str = "u") -> str:
    """The difference at one end of an axis."""
    go = "lead" if side == 0 else "lag"
    n1, n2 = f"{go}({u}, 1) OVER {w}", f"{go}({u}, 2) OVER {w}"
    if order == 1:
        if kind == "REFLECT":
            return "0.0"
        if kind == "DIRICHLET":
            return f"({n1} - ({value})) / (2 * {h})" if side == 0 else f"(({value}) - {n1}) / (2 * {h})"
        return f"({n1} - {u}) / {h}" if side == 0 else f"({u} - {n1}) / {h}"
    if kind == "OPEN":
        return "0.0"
    if kind == "DIRICHLET":
        return f"(({value}) - 2 * {u} + {n1}) / ({h} * {h})"
    return f"({n2} - 2 * {n1} + {u}) / ({h} * {h})"


def sql_difference(order: int, axis: str, n: int, w: str, low=("OPEN", "0.0"), high=("OPEN", "0.0"), u: str = "u") -> str:
    lag, lead = f"lag({u}, 1) OVER {w}", f"lead({u}, 1) OVER {w}"
    inner = f"({lead} - {lag}) / (2 * 0.5)" if order == 1 else f"({lag} - 2 * {u} + {lead}) / (0.5 * 0.5)"
    return f"CASE WHEN {axis} = 0 THEN {sql_edges(order, low[0], w, 0, low[1], u=u)} WHEN {axis} = {n - 1} THEN {sql_edges(order, high[0], w, 1, high[1], u=u)} ELSE {inner} END"


def sql_laplacian(u: str = "u") -> str:
    return f"(0.0 + {sql_difference(2, 'i', 84, W_I, u=u)} + {sql_difference(2, 'j', 50, W_J, u=u)})"


# --- grids and stencils
@query(f"WITH {GRID} SELECT i, j, {sql_laplacian()} AS lap FROM g")
def grid_laplacian_open(spark, sf_dir):
    g = lenses.months_grid()
    return lenses.months(spark, sf_dir).select("i", "j", stencil.laplacian(g).alias("lap"))


def _stencils():
    for order in (1, 2):
        for kind, value in (("OPEN", 0.0), ("DIRICHLET", 2.0), ("NEUMANN", 3.0), ("REFLECT", 1.0), ("ROBIN", 0.0), ("PERIODIC", 0.0)):
            for axis, name, n, w in ((0, "i", 84, W_I), (1, "j", 50, W_J)):

                def f(spark, sf_dir, order=order, kind=kind, value=value, axis=axis):
                    g = lenses.months_grid()
                    for side in (0, 1):
                        g = g.with_boundary(axis, side, Boundary(kind, value))
                    return lenses.months(spark, sf_dir).select("i", "j", stencil.derivative(g, axis, order).alias("d"))

                q = f"d{order}_{kind.lower()}_{'xy'[axis]}"
                QUERIES[q] = f
                ORACLES[q] = f"WITH {GRID} SELECT i, j, {sql_difference(order, name, n, w, (kind, str(value)), (kind, str(value)))} AS d FROM g"


_stencils()


@query(f"WITH {GRID} SELECT i, j, {sql_difference(1, 'i', 84, W_I, ('DIRICHLET', '1 + 0.5 * (0.5 * j) + 2.0'), ('OPEN', '0'))} AS d FROM g")
def d1_function_boundary(spark, sf_dir):
    g = lenses.months_grid().with_boundary(0, 0, Boundary("DIRICHLET", func=lambda x, y, t: 1 + 0.5 * y + t)).at_time(2.0)
    return lenses.months(spark, sf_dir).select("i", "j", stencil.derivative(g, 0, 1).alias("d"))


@query(f"WITH {GRID} SELECT i, j, {sql_difference(1, 'i', 84, W_I)} AS di, {sql_difference(1, 'j', 50, W_J)} AS dj FROM g")
def grid_gradient(spark, sf_dir):
    g = lenses.months_grid()
    return lenses.months(spark, sf_dir).select("i", "j", *(c.alias(k) for k, c in stencil.gradient(g).items()))


@query(f"WITH {LINE}, d AS (SELECT i, {sql_difference(1, 'i', 744, W_L, ('DIRICHLET', '1.0'), ('OPEN', '0'))} AS d1, {sql_difference(2, 'i', 744, W_L, ('DIRICHLET', '1.0'), ('OPEN', '0'))} AS d2 FROM g) SELECT i, d1, d2 FROM d")
def line_differences(spark, sf_dir):
    g = lenses.hours_grid(Boundary("DIRICHLET", 1.0), Boundary("OPEN"))
    line = lenses.hours(spark, sf_dir)
    first = stencil.derivative_by_shift(line, g, 1, out="d1")
    return ints(stencil.derivative_by_shift(first, g, 2, out="d2").select("i", "d1", "d2"), "i")


@query(f"WITH {GRID}, a AS (SELECT i, j, u, {sql_difference(1, 'i', 84, W_I)} AS e FROM g), b AS (SELECT i, j, u, {sql_difference(1, 'i', 84, W_I, u='e')} AS dd FROM a) SELECT i, j, dd * u + 3.0 AS v FROM b")
def grid_nested_derivative(spark, sf_dir):
    u = var("u")
    e = derivative_of(derivative_of(u, "x"), "x") * u + 3.0
    return plans.on_grid(lenses.months(spark, sf_dir), e, lenses.months_grid(), "v").select("i", "j", "v")


@query(f"WITH {GRID} SELECT i, j, 2.0 * u + (-(0.25 * {sql_laplacian()})) AS v FROM g")
def grid_expression(spark, sf_dir):
    u = var("u")
    e = 2.0 * u + (-(var("c") * laplacian_of(u)))
    return plans.on_grid(lenses.months(spark, sf_dir), e, lenses.months_grid(), "v", {"c": 0.25}).select("i", "j", "v")


@query(f"WITH {GRID} SELECT i, j, CAST(i * 50 + j AS INTEGER) AS pos, CAST(0.5 * i AS DOUBLE) AS x, CAST(0.5 * j AS DOUBLE) AS y, (i IN (0, 83) OR j IN (0, 49)) AS edge FROM g")
def grid_addressing(spark, sf_dir):
    g = lenses.months_grid()
    rows = lenses.months(spark, sf_dir).withColumn("pos", g.linear().cast("int"))
    back = g.from_linear(F.col("pos"))
    return rows.select(back["i"].alias("i"), back["j"].alias("j"), "pos", g.coord(0).alias("x"), g.coord(1).alias("y"), g.is_boundary().alias("edge"))


_NEAR = "CASE WHEN {x} >= 0 AND {x} <= 42 AND {y} >= 0 AND {y} <= 25 THEN CAST(least(round({x} / 0.5), 83) AS INTEGER) END AS i, CASE WHEN {x} >= 0 AND {x} <= 42 AND {y} >= 0 AND {y} <= 25 THEN CAST(least(round({y} / 0.5), 49) AS INTEGER) END AS j"


@query(f"SELECT c_custkey, coalesce(i, -1) AS i, coalesce(j, -1) AS j FROM (SELECT c_custkey, {_NEAR.format(x='(c_acctbal / 128)', y='(c_nationkey * 1.25)')} FROM customer)")
def coord_to_index(spark, sf_dir):
    at = lenses.months_grid().nearest(F.col("c_acctbal") / 128, F.col("c_nationkey") * 1.25)
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(at["i"], F.lit(-1)).alias("i"), F.coalesce(at["j"], F.lit(-1)).alias("j"))


@query(f"WITH {GRID}, p AS (SELECT p_partkey, {_NEAR.format(x='(0.875 * p_size)', y='(0.5 * floor(p_retailprice / 100))')} FROM part) SELECT p_partkey, u FROM p LEFT JOIN g USING (i, j)")
def nearest_sample(spark, sf_dir):
    points = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 0.875).alias("x"), (F.floor(F.col("p_retailprice") / 100) * 0.5).alias("y"))
    return lenses.months_grid().sample(lenses.months(spark, sf_dir), points, ["x", "y"]).select("p_partkey", "u")


@query(f"WITH {GRID} SELECT round(sqrt(sum(u * u)), 6) AS norm FROM g")
def field_norm(spark, sf_dir):
    return lenses.months(spark, sf_dir).agg(six(grids.norm()).alias("norm"))


@query(f"WITH {GRID} SELECT i, j, u + (0.5 * i) * (0.5 * i) + (0.5 * j) * (0.5 * j) AS s, (u * 2.5) * (CASE WHEN i = 3 AND j = 4 THEN 7.0 ELSE 1.5 END) AS m FROM g")
def field_arithmetic(spark, sf_dir):
    g = lenses.months_grid()
    u = lenses.months(spark, sf_dir)
    s = grids.add(u, g.init(spark, lambda x, y: x * x + y * y), g).withColumnRenamed("u", "s")
    m = grids.multiply(grids.scale(u, 2.5), grids.set_value(g.fill(spark, 1.5), g, (3, 4), 7.0), g).withColumnRenamed("u", "m")
    return s.join(m, ["i", "j"]).select("i", "j", "s", "m")


@query(f"WITH {GRID} SELECT i, j, u FROM g WHERE i = 10 AND j = 20")
def field_get(spark, sf_dir):
    return grids.get(lenses.months(spark, sf_dir), lenses.months_grid(), (10, 20)).select("i", "j", "u")


# --- barriers
def _barred(kind="REFLECT") -> Grid:
    g = lenses.months_grid()
    g = g.with_barrier((0.0, 1.0), (20.0, 12.0), (-8.0,), (8.0,), kind)
    return g.with_barrier((1.0, 0.0), (30.25, 10.0), (-6.0,), (6.0,), "REFLECT")


_POINT = """CASE WHEN abs(y - 12.0) <= 1e-10 AND x BETWEEN 12.0 - 1e-10 AND 28.0 + 1e-10 AND x - 20.0 BETWEEN -8.0 AND 8.0 THEN 1
WHEN abs(x - 30.25) <= 1e-10 AND y BETWEEN 4.0 - 1e-10 AND 16.0 + 1e-10 AND y - 10.0 BETWEEN -6.0 AND 6.0 THEN 2 ELSE 0 END"""


@query(f"SELECT p_partkey, CAST({_POINT} AS INTEGER) AS bid FROM (SELECT p_partkey, 0.5 * p_size AS x, 0.5 * floor(p_retailprice / 64) AS y FROM part)")
def points_near_barrier(spark, sf_dir):
    points = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 0.5).alias("x"), (F.floor(F.col("p_retailprice") / 64) * 0.5).alias("y"))
    return points.select("p_partkey", boundary.near_boundary(_barred().barriers, [F.col("x"), F.col("y")]).cast("int").alias("bid"))


_B1 = "(abs({y} - 12.0) <= 0.5 AND {x} BETWEEN 11.5 AND 28.5 AND {x} - 20.0 BETWEEN -8.0 AND 8.0)"
_B2 = "(abs({x} - 30.25) <= 0.5 AND {y} BETWEEN 3.5 AND 16.5 AND {y} - 10.0 BETWEEN -6.0 AND 6.0)"
_XY = {"x": "(0.5 * i)", "y": "(0.5 * j)"}


@query(f"WITH {GRID} SELECT i, j, CASE WHEN {_B2.format(**_XY)} THEN 0.0 ELSE {sql_difference(1, 'i', 84, W_I)} END AS dx, CASE WHEN {_B1.format(**_XY)} THEN 0.0 ELSE {sql_difference(1, 'j', 50, W_J)} END AS dy FROM g")
def d1_with_barrier(spark, sf_dir):
    g = _barred()
    return lenses.months(spark, sf_dir).select("i", "j", stencil.derivative(g, 0, 1).alias("dx"), stencil.derivative(g, 1, 1).alias("dy"))


def _sql_d2_barrier(axis: str, n: int, w: str, other: str, own: str, d: str) -> str:
    """Zero at the barrier across the axis; beside it, one-sided where the stencil straddles it."""
    at = lambda s: {"x": f"(0.5 * (i + {s}))", "y": "(0.5 * j)"} if axis == "i" else {"x": "(0.5 * i)", "y": f"(0.5 * (j + {s}))"}
    here, below, above = (d.format(**at(s)) for s in ("0", "-1", "1"))
    lag, lead = f"lag(u, 1) OVER {w}", f"lead(u, 1) OVER {w}"
    ahead = f"CASE WHEN {axis} + 2 < {n} THEN (lead(u, 2) OVER {w} - 2 * {lead} + u) / 0.25 ELSE 0.0 END"
    behind = f"CASE WHEN {axis} >= 2 THEN (u - 2 * {lag} + lag(u, 2) OVER {w}) / 0.25 ELSE 0.0 END"
    central = f"({lag} - 2 * u + {lead}) / 0.25"
    reach = " OR ".join(own.format(**at(s)) for s in ("0", "-1", "1"))
    crossed = f"CASE WHEN (({below}) * ({above}) < 0 OR ({here}) * ({below}) < 0 OR ({here}) * ({above}) < 0) AND ({reach}) THEN CASE WHEN abs({here}) < 0.5 THEN 0.0 WHEN {here} > 0 AND {below} < 0 THEN {ahead} WHEN {here} <= 0 AND {above} > 0 THEN {behind} ELSE {central} END ELSE {central} END"
    return f"CASE WHEN {own.format(**_XY)} THEN 0.0 WHEN {axis} IN (0, {n - 1}) THEN 0.0 ELSE {crossed} END"


@query(f"WITH {GRID} SELECT i, j, {_sql_d2_barrier('i', 84, W_I, 'j', _B2, '({x} - 30.25)')} AS dxx, {_sql_d2_barrier('j', 50, W_J, 'i', _B1, '({y} - 12.0)')} AS dyy FROM g")
def d2_with_barrier(spark, sf_dir):
    g = _barred()
    return lenses.months(spark, sf_dir).select("i", "j", stencil.derivative(g, 0, 2).alias("dxx"), stencil.derivative(g, 1, 2).alias("dyy"))


@query(f"WITH {GRID} SELECT i, j, 0.0 + {_sql_d2_barrier('i', 84, W_I, 'j', _B2, '({x} - 30.25)')} + {_sql_d2_barrier('j', 50, W_J, 'i', _B1, '({y} - 12.0)')} AS lap FROM g")
def laplacian_with_barrier(spark, sf_dir):
    return lenses.months(spark, sf_dir).select("i", "j", stencil.laplacian(_barred()).alias("lap"))


@query("""WITH p AS (SELECT c_custkey // 2 AS bid, c_custkey % 2 AS e, CAST(c_nationkey AS DOUBLE) AS x, CAST(c_custkey % 7 AS DOUBLE) AS y FROM customer),
s AS (SELECT bid, max(CASE WHEN e = 0 THEN x END) AS x0, max(CASE WHEN e = 0 THEN y END) AS y0, max(CASE WHEN e = 1 THEN x END) AS x1, max(CASE WHEN e = 1 THEN y END) AS y1, count(*) AS n FROM p GROUP BY bid),
t AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM s WHERE n = 2)
SELECT bid, round(-(y1 - y0) / len, 6) + 0.0 AS nx, round((x1 - x0) / len, 6) + 0.0 AS ny, (x0 + x1) / 2 AS px, (y0 + y1) / 2 AS py, round(len / 2, 6) AS half FROM t WHERE len >= 1e-6""")
def barrier_segments(spark, sf_dir):
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_nationkey").cast("double").alias("x"), (F.col("c_custkey") % 7).cast("double").alias("y"))
    s = boundary.segments_to_barriers(points)
    return s.select("bid", six(F.col("nx")).alias("nx"), six(F.col("ny")).alias("ny"), "px", "py", six(F.col("half")).alias("half"))


# --- tensors
_PAIR = "FROM m a JOIN m b ON b.vec_id = a.vec_id + 1"


def _next(spark, sf_dir):
    m = lenses.matrices(spark, sf_dir)
    return m.like(m.df.withColumn("vec_id", F.col("vec_id") - 1))


def _out(t, *drop):
    return ints(t.df, *(a for a in ("i", "j", "k"))).drop(*drop)


@query(f"WITH {MATRIX} SELECT a.vec_id, a.j, b.k, sum(a.v * b.v) AS v {_PAIR} AND a.k = b.j GROUP BY 1, 2, 3")
def tensor_matmul(spark, sf_dir):
    return _out(tensor.matmul(lenses.matrices(spark, sf_dir), _next(spark, sf_dir)), "i")


@query(f"WITH {MATRIX} SELECT vec_id, k AS j, j AS k, v FROM m")
def tensor_transpose(spark, sf_dir):
    return _out(tensor.transpose(lenses.matrices(spark, sf_dir)), "i")


@query(f"WITH {MATRIX} SELECT vec_id, sum(v) AS v FROM m WHERE j = k GROUP BY 1")
def tensor_trace(spark, sf_dir):
    return _out(tensor.einsum("ii->", lenses.matrices(spark, sf_dir)), "i", "j", "k")


@query(f"WITH {MATRIX} SELECT a.vec_id, sum(a.v * b.v) AS v {_PAIR} AND a.j = b.j AND a.k = b.k GROUP BY 1")
def tensor_dot(spark, sf_dir):
    return tensor.dot(lenses.matrices(spark, sf_dir), _next(spark, sf_dir)).select("vec_id", "v")


@query(f"WITH {VECTOR} SELECT a.vec_id, sum(a.v * b.v) AS v {_PAIR} AND a.k = b.k GROUP BY 1")
def tensor_einsum_dot(spark, sf_dir):
    return _out(tensor.einsum("i,i->", lenses.vectors(spark, sf_dir), lenses.vectors(spark, sf_dir, 1)), "i", "j", "k")


@query(f"WITH {MATRIX}, r AS (SELECT vec_id, j, sum(v) AS v FROM m GROUP BY 1, 2) SELECT a.vec_id, a.j, b.j AS k, a.v * b.v AS v FROM r a JOIN r b ON b.vec_id = a.vec_id + 1")
def tensor_outer(spark, sf_dir):
    a = tensor.einsum("ij->i", lenses.matrices(spark, sf_dir))
    return _out(tensor.einsum("i,j->ij", a, a.like(a.df.withColumn("vec_id", F.col("vec_id") - 1))), "i")


@query(f"WITH {MATRIX} SELECT a.vec_id, a.j, a.k, a.v * b.v AS v {_PAIR} AND a.j = b.j AND a.k = b.k")
def tensor_hadamard(spark, sf_dir):
    return _out(tensor.einsum("ij,ij->ij", lenses.matrices(spark, sf_dir), _next(spark, sf_dir)), "i")


@query(f"WITH {MATRIX}, r AS (SELECT vec_id, k, sum(v) AS v FROM m GROUP BY 1, 2) SELECT m.vec_id, m.j, m.k, m.v + r.v AS s, m.v - r.v AS d, m.v * r.v AS p FROM m JOIN r ON r.vec_id = m.vec_id AND r.k = m.k")
def tensor_broadcast(spark, sf_dir):
    m = lenses.matrices(spark, sf_dir)
    r = tensor.einsum("ij->j", m)
    named = [_out(t, "i").withColumnRenamed("v", n) for n, t in (("s", tensor.add(m, r)), ("d", tensor.subtract(m, r)), ("p", tensor.multiply(m, r)))]
    return named[0].join(named[1], ["vec_id", "j", "k"]).join(named[2], ["vec_id", "j", "k"])


@query(f"WITH {MATRIX} SELECT vec_id, j, k, -(v * 2.5) AS v FROM m")
def tensor_scale_negate(spark, sf_dir):
    return _out(tensor.negate(tensor.scale(lenses.matrices(spark, sf_dir), 2.5)), "i")


@query(f"WITH {MATRIX} SELECT vec_id, round(sqrt(sum(v * v)), 6) AS norm FROM m GROUP BY 1")
def tensor_norm(spark, sf_dir):
    return tensor.norm(lenses.matrices(spark, sf_dir)).select("vec_id", six(F.col("norm")).alias("norm"))


@query(f"WITH {MATRIX}, r AS (SELECT vec_id, k, sum(v) AS v FROM m GROUP BY 1, 2) SELECT m.vec_id, m.j, sum(m.v * r.v) AS v FROM m JOIN r ON r.vec_id = m.vec_id AND r.k = m.k GROUP BY 1, 2")
def tensor_matvec(spark, sf_dir):
    m = lenses.matrices(spark, sf_dir)
    t = tensor.einsum("ij,j->i", m, tensor.einsum("ij->j", m))
    return _out(t, "i", "j").withColumnRenamed("k", "j")


@query(f"WITH {MATRIX} SELECT vec_id, max(CASE WHEN j = 2 AND k = 3 THEN v END) AS before, CAST(7.0 AS DOUBLE) AS after FROM m GROUP BY 1")
def tensor_get_set(spark, sf_dir):
    m = lenses.matrices(spark, sf_dir)
    before = tensor.get(m, (0, 2, 3)).withColumnRenamed("v", "before")
    return before.join(tensor.get(tensor.set_value(m, (0, 2, 3), 7.0), (0, 2, 3)).withColumnRenamed("v", "after"), "vec_id").select("vec_id", "before", "after")


@query(f"WITH {MATRIX} SELECT vec_id, 64 AS n, sum(v * v) AS dot, round(sqrt(sum(v * v)), 6) AS norm, sum(CASE WHEN j = 0 AND k = 5 THEN v END) AS v5, false AS zero FROM m GROUP BY 1")
def tensor_packed(spark, sf_dir):
    t = F.col("t")
    rows = tensor.to_packed(lenses.matrices(spark, sf_dir))
    return rows.select("vec_id", tensor.total_elements(t).cast("int").alias("n"), tensor.packed_dot(t, t).alias("dot"), six(tensor.packed_norm(t)).alias("norm"), tensor.packed_get(t, 5).alias("v5"), tensor.is_zero(t).alias("zero"))


@query("SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, CAST(1.5 AS DOUBLE) AS v FROM (SELECT unnest(range(2)) AS i), (SELECT unnest(range(3)) AS j), (SELECT unnest(range(4)) AS k)")
def tensor_create(spark, sf_dir):
    return _out(tensor.create(spark, (2, 3, 4), 1.5))


@query(f"WITH {MATRIX}, p AS (SELECT a.vec_id, a.j, b.k, sum(a.v * b.v) AS v {_PAIR} AND a.k = b.j GROUP BY 1, 2, 3) SELECT p.vec_id, p.j, p.k, 2 * p.v + (-m.v) AS v FROM p JOIN m ON m.vec_id = p.vec_id AND m.j = p.k AND m.k = p.j")
def tensor_expression(spark, sf_dir):
    a = lenses.matrices(spark, sf_dir)
    b = _next(spark, sf_dir)
    a = a.like(a.df.join(b.df.select("vec_id").distinct(), "vec_id", "left_semi"))
    b = b.like(b.df.join(a.df.select("vec_id").distinct(), "vec_id", "left_semi"))
    e = 2.0 * einsum(var("a"), "ij", "ik", var("b"), "jk") + (-var("a").T)
    return _out(plans.tensors(e, {"a": a, "b": b}, spark), "i")


# --- environments
def _envs(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.select(F.col("c_custkey").alias("name"), F.col("c_nationkey").cast("double").alias("v"))
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").cast("double").alias("v"), F.col("o_orderkey").alias("seq"))
    return old, new


_ENV = "WITH e AS (SELECT c_custkey AS name, CAST(c_nationkey AS DOUBLE) AS v FROM customer), n AS (SELECT o_custkey AS name, max(CAST(o_orderkey AS DOUBLE)) AS v FROM orders GROUP BY 1)"


@query(f"{_ENV} SELECT name, v FROM e WHERE name NOT IN (SELECT name FROM n) UNION ALL SELECT name, v FROM n")
def env_set(spark, sf_dir):
    old, new = _envs(spark, sf_dir)
    return env.set_all(old, new, ["name"], "seq")


@query(f"{_ENV} SELECT e.name, e.v, n.v AS new_v FROM e LEFT JOIN n USING (name)")
def env_get(spark, sf_dir):
    old, new = _envs(spark, sf_dir)
    return env.get(new.groupBy("name").agg(F.max("v").alias("new_v")), old, ["name"]).select("name", "v", "new_v")


@query(f"{_ENV} SELECT (SELECT count(*) FROM e WHERE name IN (SELECT name FROM n)) AS has, (SELECT count(*) FROM e WHERE name NOT IN (SELECT name FROM n)) AS rest")
def env_has_remove(spark, sf_dir):
    old, new = _envs(spark, sf_dir)
    keys = new.select("name").distinct()
    return env.has(keys, old, ["name"]).agg(F.count(F.lit(1)).alias("has")).crossJoin(env.remove(old, keys, ["name"]).agg(F.count(F.lit(1)).alias("rest")))


@query(f"{_ENV} SELECT name, coalesce(n.v, e.v) AS v FROM e FULL JOIN n USING (name)")
def env_merge(spark, sf_dir):
    old, new = _envs(spark, sf_dir)
    return env.merge(old, new.groupBy("name").agg(F.max("v").alias("v")), ["name"])


@query("SELECT c_mktsegment, count(DISTINCT c_nationkey) AS n FROM customer GROUP BY 1")
def env_size(spark, sf_dir):
    return env.size(table(spark, sf_dir, "customer").select("c_mktsegment", F.col("c_nationkey").alias("name")), ["c_mktsegment"])


# --- expressions over line items: q quantity, n line number, both whole
q, n, p = var("q"), var("n"), var("p")
_F = (q * q) * n + 3.0 * (q * n) + (-(n * n))


def _lines(spark, sf_dir, **values):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_linenumber").cast("double").alias("n"), "l_linenumber", "l_returnflag")
    return rows.groupBy("l_returnflag", "l_linenumber").agg(*(F.sum(plans.column(e)).alias(k) for k, e in values.items()))


def _lines_sql(**values):
    return f"WITH t AS (SELECT l_quantity AS q, CAST(l_linenumber AS DOUBLE) AS n, l_linenumber, l_returnflag FROM lineitem) SELECT l_returnflag, l_linenumber, {', '.join(f'sum({e}) AS {k}' for k, e in values.items())} FROM t GROUP BY 1, 2"


@query(_lines_sql(v="q * q * n + 3 * q * n - n * n"))
def expr_evaluate(spark, sf_dir):
    return _lines(spark, sf_dir, v=_F)


@query(_lines_sql(dq="2 * q * n + 3 * n", dn="q * q + 3 * q - 2 * n"))
def expr_gradient(spark, sf_dir):
    return _lines(spark, sf_dir, **{f"d{k}": calculus.simplify(e) for k, e in calculus.gradient(_F).items()})


@query(_lines_sql(mixed="2 * q + 3", second="2 * n", third="CAST(0 AS DOUBLE)", lap="2 * n - 2"))
def expr_higher_derivatives(spark, sf_dir):
    s = calculus.simplify
    return _lines(spark, sf_dir, mixed=s(calculus.mixed_partial(_F, "q", "n")), second=s(calculus.nth_derivative(_F, "q", 2)), third=s(calculus.nth_derivative(_F, "q", 3)), lap=s(calculus.laplacian(_F)))


@query(_lines_sql(central="2 * q * n + 3 * n", forward="2 * q * n + 3 * n + 0.5 * n", backward="2 * q * n + 3 * n - 0.5 * n", second="2 * n"))
def expr_finite_difference(spark, sf_dir):
    d = calculus.finite_difference
    return _lines(spark, sf_dir, central=d(_F, "q", 0.5), forward=d(_F, "q", 0.5, "forward"), backward=d(_F, "q", 0.5, "backward"), second=calculus.finite_difference_2nd(_F, "q", 0.5))


@query(_lines_sql(v="25 * n + 15 * n - n * n"))
def expr_partial_evaluation(spark, sf_dir):
    return _lines(spark, sf_dir, v=calculus.simplify(substitute(_F, {"q": 5.0})))


_CORPUS = (q * n, n * q, q + n, n + q, q @ n, n @ q, q * q, calculus.simplify(q + 0.0), q, 2.0 * q, q * 2.0, einsum(q, "ij", "ji"), -q)


@query("SELECT * FROM (VALUES (0, true, 2), (1, false, 2), (2, true, 2), (3, false, 2), (4, true, 2), (5, true, 2), (6, true, 1), (7, true, 1), (8, false, 1), (9, true, 1), (10, false, 1), (11, true, 1), (12, true, 1)) AS t(expr_id, is_new, n_vars)")
def expr_registry(spark, sf_dir):
    rows = [(i, f"{canonical_hash(e):016x}", len(variables(e))) for i, e in enumerate(_CORPUS)]
    return register(spark.createDataFrame(rows, "expr_id int, expr_hash string, n_vars int")).select("expr_id", "is_new", "n_vars")


@query("SELECT * FROM (VALUES (0, '((q * n) + 2)', '((q * n) + 2)'), (1, '(q + q)', '(2 * q)'), (2, '((3 * q) + (q * -3))', '0'), (3, '(d(q)/dx + ∇²(q))', '(d(q)/dx + ∇²(q))'), (4, '(1 * (q + 0))', 'q'), (5, '-(0)', '0'), (6, 'T(q)', 'T(q)')) AS t(expr_id, text, simple)")
def expr_print(spark, sf_dir):
    items = [q * n + 2.0, q + q, 3.0 * q + q * -3.0, derivative_of(q, "x") + laplacian_of(q), 1.0 * (q + 0.0), -scalar(0), q.T]
    return spark.createDataFrame([(i, str(e), str(calculus.simplify(e))) for i, e in enumerate(items)], "expr_id int, text string, simple string")


# --- dependency graphs
_TURNS = "t AS (SELECT DISTINCT conv_id, CAST(turn AS INTEGER) AS turn FROM conversations), e AS (SELECT a.conv_id, a.turn FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1)"
_RUNS = f"WITH RECURSIVE {_TURNS}, r AS (SELECT conv_id, turn, turn - 1 AS dep FROM e UNION ALL SELECT r.conv_id, r.turn, e.turn - 1 FROM r JOIN e ON e.conv_id = r.conv_id AND e.turn = r.dep)"


@query(f"{_RUNS} SELECT concat(conv_id, ':', turn) AS var, concat(conv_id, ':', dep) AS dep FROM r")
def graph_closure(spark, sf_dir):
    return graph.closure(lenses.conversation_graph(spark, sf_dir)[1])


@query(f"{_RUNS} SELECT concat(t.conv_id, ':', t.turn) AS var, CAST(count(r.dep) AS INTEGER) AS depth FROM t LEFT JOIN r ON r.conv_id = t.conv_id AND r.turn = t.turn GROUP BY 1")
def graph_depth(spark, sf_dir):
    return ints(graph.depth(*lenses.conversation_graph(spark, sf_dir)), "depth")


@query(f"{_RUNS}, d AS (SELECT conv_id, turn, count(*) AS n FROM r GROUP BY 1, 2), u AS (SELECT conv_id, dep AS turn, count(*) AS n FROM r GROUP BY 1, 2) SELECT concat(t.conv_id, ':', t.turn) AS var, CAST(coalesce(u.n, 0) AS INTEGER) AS first_level, CAST(coalesce(d.n, 0) AS INTEGER) AS eval_level FROM t LEFT JOIN d ON d.conv_id = t.conv_id AND d.turn = t.turn LEFT JOIN u ON u.conv_id = t.conv_id AND u.turn = t.turn")
def graph_toposort(spark, sf_dir):
    nodes, edges = lenses.conversation_graph(spark, sf_dir)
    a = graph.topological_levels(nodes, edges)[0].withColumnRenamed("level", "first_level")
    return a.join(graph.topological_levels(nodes, edges, "evaluation")[0].withColumnRenamed("level", "eval_level"), "var").select("var", "first_level", "eval_level")


@query("SELECT CAST(c_custkey AS VARCHAR) AS var, CAST(min(c_custkey) OVER (PARTITION BY c_nationkey) AS BIGINT) AS scc FROM customer")
def graph_components(spark, sf_dir):
    """Customers of a nation point to the next by key, the last to the first: one ring each."""
    from pyspark.sql import Window as W

    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    w = W.partitionBy("c_nationkey").orderBy("c_custkey")
    # the ring's step is by a hash order, so that rings have short ways too
    ends = c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("first"))
    rows = c.withColumn("next", F.lead("c_custkey").over(w)).join(ends, "c_nationkey")
    ring = rows.select(F.col("c_custkey").cast("string").alias("var"), F.coalesce("next", "first").cast("string").alias("dep"))
    hub = rows.select(F.col("first").cast("string").alias("var"), F.col("c_custkey").cast("string").alias("dep")).unionByName(rows.select(F.col("c_custkey").cast("string").alias("var"), F.col("first").cast("string").alias("dep")))
    nodes = c.select(F.col("c_custkey").cast("string").alias("var"), F.col("c_custkey").alias("ord"))
    return graph.components(nodes, ring.unionByName(hub).where("var <> dep"))


@query("SELECT * FROM (VALUES ('ring', 'HAS_CYCLES', false, 1, 3, 0), ('chain', 'ACYCLIC', true, 3, 1, 1), ('self', 'SELF_REFERENTIAL', false, 2, 1, 1)) AS t(name, status, acyclic, n_components, max_size, n_isolated)")
def graph_structure(spark, sf_dir):
    x, y, z = var("x"), var("y"), var("z")
    out = None
    for name, defs in {"ring": {"x": x + y, "y": y + z, "z": x + z}, "chain": {"x": y + z, "y": z * 2.0, "z": scalar(1)}, "self": {"x": x + 1.0, "y": scalar(2)}}.items():
        nodes, edges = graph.from_definitions(spark, defs)
        loops = edges.where("var <> dep") if name == "ring" else edges
        row = graph.structure(nodes, edges).select(F.lit(name).alias("name"), F.lit(graph.detect_cycles(nodes, loops)).alias("status"), "acyclic", F.col("n_components").cast("int").alias("n_components"), F.col("max_size").cast("int").alias("max_size"), F.col("n_isolated").cast("int").alias("n_isolated"))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"{_RUNS} SELECT concat(conv_id, ':', turn) AS var FROM r WHERE dep = 0 AND conv_id = (SELECT min(conv_id) FROM t)")
def graph_dependents(spark, sf_dir):
    nodes, edges = lenses.conversation_graph(spark, sf_dir)
    first = nodes.orderBy("ord").first().var
    return graph.dependents(edges, first)


# --- solvers
x, y = var("x"), var("y")


@query("SELECT l_orderkey, CAST(l_linenumber AS DOUBLE) AS b, round((3 * l_quantity - l_linenumber) / 5, 6) AS x, round((2 * l_linenumber - l_quantity) / 5, 6) + 0.0 AS y, 'SUCCESS' AS status FROM lineitem")
def newton_linear(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("a"), F.col("l_linenumber").cast("double").alias("b"))
    s = systems.System((2.0 * x + y - var("a"), x + 3.0 * y - var("b")), ("x", "y"))
    return solvers.newton(rows, s, ["l_orderkey", "b"]).select("l_orderkey", "b", six(F.col("x")).alias("x"), six(F.col("y")).alias("y"), "status")


@query("SELECT p_partkey, round(sqrt(p_size), 4) AS x, round(2 * sqrt(p_size), 4) AS y, 'SUCCESS' AS status FROM part")
def newton_square_root(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"))
    system = systems.System((x * x - var("s"), y - 2.0 * x), ("x", "y"), tolerance=1e-10)
    return solvers.newton(rows, system, ["p_partkey"], {"x": "s", "y": 1.0}).select("p_partkey", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "status")


@query("SELECT p_partkey, round((7 + sqrt(2 * (24 + p_size) - 49)) / 2, 4) AS x, round((7 - sqrt(2 * (24 + p_size) - 49)) / 2, 4) + 0.0 AS y, 'SUCCESS' AS status FROM part")
def newton_circle_line(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + 24.0).alias("r2"))
    system = systems.System((x * x + y * y - var("r2"), x + y - 7.0), ("x", "y"), tolerance=1e-10)
    return solvers.newton(rows, system, ["p_partkey"], {"x": 8.0, "y": -1.0}).select("p_partkey", F.round("x", 4).alias("x"), (F.round("y", 4) + 0.0).alias("y"), "status")


@query("SELECT p_partkey, 'INVALID_SYSTEM' AS status, 'Singular Jacobian matrix' AS message, 1 AS iterations FROM part")
def newton_singular(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"))
    return solvers.newton(rows, systems.System((x + y - var("s"), x + y - var("s")), ("x", "y")), ["p_partkey"]).select("p_partkey", "status", "message", "iterations")


@query("SELECT p_partkey, 'INVALID_SYSTEM' AS status, 'SOR not yet implemented' AS message FROM part")
def solver_sor(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"))
    return solvers.sor(rows, systems.System((x - var("s"),), ("x",)), ["p_partkey"]).select("p_partkey", "status", "message")


@query("SELECT p_partkey, round(CAST(p_size AS DOUBLE), 4) AS x, 'SUCCESS' AS status FROM part")
def fixed_point_linear(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"))
    return solvers.fixed_point(rows, systems.System((x - var("s"),), ("x",)), ["p_partkey"]).select("p_partkey", F.round("x", 4).alias("x"), "status")


@query("SELECT p_partkey, 'DIVERGED' AS status, CAST(NULL AS DOUBLE) AS x FROM part")
def fixed_point_diverges(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"))
    out = solvers.fixed_point(rows, systems.System((-10.0 * x - var("s"),), ("x",)), ["p_partkey"])
    return out.select("p_partkey", "status", F.nanvl("x", F.lit(None).cast("double")).alias("x"))


@query("SELECT l_orderkey, l_linenumber, round(sqrt((2 * l_quantity + 1 - 5) * (2 * l_quantity + 1 - 5) + (l_quantity - l_linenumber) * (l_quantity - l_linenumber)), 6) AS norm FROM lineitem")
def residual_norm(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), F.col("l_linenumber").cast("double").alias("b"))
    s = systems.System((2.0 * x + 1.0 - 5.0, x - var("b")), ("x",))
    return rows.select("l_orderkey", "l_linenumber", six(systems.residual_norm(s.residuals())).alias("norm"))


@query("SELECT p_partkey, round(sqrt(p_size), 3) AS x, round(p_size / 2.0, 3) AS y, 'SUCCESS' AS status FROM part")
def krylov_scalar(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"))
    system = systems.System((x * x - var("s"), 2.0 * y - var("s")), ("x", "y"))
    return solvers.newton_krylov(rows, system, ["p_partkey"], {"x": "s", "y": 1.0}).select("p_partkey", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "status")


@query("WITH r AS (SELECT n_nationkey AS grid_id, CAST(i AS INTEGER) AS i FROM nation CROSS JOIN (SELECT unnest(range(21)) AS i)) SELECT grid_id, i, round((n + 1) * i * (20 - i) / 800, 5) + 0.0 AS u, 'SUCCESS' AS status FROM (SELECT *, grid_id AS n FROM r)")
def krylov_poisson(spark, sf_dir):
    """-u'' = f with f one more than the nation's key, and both ends held at zero."""
    h = 0.05
    cells = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("grid_id"), (F.col("n_nationkey") + 1.0).alias("f"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"), F.lit(0.0).alias("u"))

    def residual(v):
        u = v["u"]
        out = u.copy()
        out[1:-1] = (u[:-2] - 2 * u[1:-1] + u[2:]) / (h * h) + v["f"][1:-1]
        return out

    out = solvers.krylov_on_grids(cells, ["grid_id"], residual, ["u"], ["i"])
    return out.select("grid_id", "i", (F.round("u", 5) + 0.0).alias("u"), "status")


@query("SELECT * FROM (VALUES ('chain', true, 'x,y,z'), ('ring', true, NULL), ('open', false, 'x')) AS t(name, well_posed, solve_order)")
def system_analysis(spark, sf_dir):
    z = var("z")
    s = systems.System
    cases = {"chain": s((x + y, y + z, z - 1.0), ("x", "y", "z")), "ring": s((x + y, y + z, z + x), ("x", "y", "z")), "open": s((x - 1.0, x - 2.0), ("x",))}
    rows = []
    for name, c in cases.items():
        order = c.solve_order(spark)
        rows.append((name, c.is_well_posed, None if order is None else ",".join(order)))
    return spark.createDataFrame(rows, "name string, well_posed boolean, solve_order string")


# --- waves on the months grid
_STEP = "s{b} AS (SELECT i, j, 2.0 * u - p + 0.0625 * {lap} AS u, u AS p FROM s{a})"


def _steps_sql(n, lap=None):
    return ", ".join(["s0 AS (SELECT i, j, u, u AS p FROM g)"] + [_STEP.format(a=k, b=k + 1, lap=lap or sql_laplacian()) for k in range(n)])


_LAP_BARRED = f"(0.0 + {_sql_d2_barrier('i', 84, W_I, 'j', _B2, '({x} - 30.25)')} + {_sql_d2_barrier('j', 50, W_J, 'i', _B1, '({y} - 12.0)')})"


def _state(spark, sf_dir):
    return lenses.months(spark, sf_dir, "u_curr").withColumn("u_prev", F.col("u_curr"))


@query(f"WITH {GRID}, {_steps_sql(3)} SELECT i, j, u AS u_curr, p AS u_prev FROM s3")
def wave_leapfrog(spark, sf_dir):
    return wave.run(_state(spark, sf_dir), lenses.months_grid(), 0.0625, 3).select("i", "j", "u_curr", "u_prev")


@query(f"WITH {GRID}, {_steps_sql(3)} SELECT i, j, u AS u_curr, p AS u_prev FROM s3")
def wave_fused(spark, sf_dir):
    state = _state(spark, sf_dir).withColumn("sim", F.lit(0))
    return wave.run_fused(state, lenses.months_grid(), 0.0625, 3, ["sim"]).select("i", "j", "u_curr", "u_prev")


@query(f"WITH {GRID}, {_steps_sql(3)} SELECT i, j, u AS u_curr, p AS u_prev FROM s3")
def wave_tiled(spark, sf_dir):
    return wave.run_tiled(_state(spark, sf_dir), lenses.months_grid(), 0.0625, 3, tile=16, block=2).select("i", "j", "u_curr", "u_prev")


@query(f"WITH {GRID}, {_steps_sql(3, _LAP_BARRED)} SELECT i, j, round(u, 6) + 0.0 AS u_curr, round(p, 6) + 0.0 AS u_prev FROM s3")
def wave_fused_barrier(spark, sf_dir):
    state = _state(spark, sf_dir).withColumn("sim", F.lit(0))
    return wave.run_fused(state, _barred(), 0.0625, 3, ["sim"]).select("i", "j", six("u_curr").alias("u_curr"), six("u_prev").alias("u_prev"))


@query(f"WITH {GRID}, {_steps_sql(3, _LAP_BARRED)} SELECT i, j, round(u, 6) + 0.0 AS u_curr, round(p, 6) + 0.0 AS u_prev FROM s3")
def wave_tiled_barrier(spark, sf_dir):
    return wave.run_tiled(_state(spark, sf_dir), _barred(), 0.0625, 3, tile=16, block=2).select("i", "j", six("u_curr").alias("u_curr"), six("u_prev").alias("u_prev"))


def _sponge_sql(distance):
    d = f"least({distance})"
    sig = f"(10.0 * (1.0 - {d} / 8.0) * (1.0 - {d} / 8.0))"
    return f"WITH {GRID}, {_steps_sql(1)}, n AS (SELECT s1.i, s1.j, s1.u AS a, s1.p AS u, s1.p AS b FROM s1) SELECT i, j, round(CASE WHEN {d} < 8 THEN (2.0 - {sig} * 0.125) * u - (1.0 - {sig} * 0.125) * b + (a - 2.0 * u + b) ELSE a END, 6) + 0.0 AS u_curr FROM n"


@query(_sponge_sql("i, 83 - i, j, 49 - j"))
def wave_sponge(spark, sf_dir):
    return wave.step(_state(spark, sf_dir), lenses.months_grid(), 0.0625, 8, 0.125).select("i", "j", six(F.col("u_curr")).alias("u_curr"))


@query(_sponge_sql("84, i, 83 - i, j").replace("lag(u, 1) OVER (PARTITION BY i ORDER BY j) - 2 * u + lead", "lag(u, 1) OVER (PARTITION BY i ORDER BY j) - 2 * u + lead"))
def wave_sponge_open_faces(spark, sf_dir):
    """The layer only along the OPEN faces; the other is PERIODIC in name and not stepped across here."""
    open_ = lenses.months_grid()
    faces = open_.with_boundary(1, 1, Boundary("REFLECT"))
    state = _state(spark, sf_dir).withColumn("_next", wave.leapfrog(open_, 0.0625))
    return state.select("i", "j", six(wave.sponge(faces, 8, 0.125, F.col("_next"), "open")).alias("u_curr"))


@query(f"""WITH {GRID}, s AS (SELECT s_suppkey AS ord, s_nationkey * 1.5 AS x, CAST(s_suppkey % 25 AS DOUBLE) AS y, 1.25 AS radius, CAST(s_suppkey AS DOUBLE) AS a FROM supplier WHERE s_suppkey % 3 <> 0),
h AS (SELECT g.i, g.j, arg_max(s.a, s.ord) AS v FROM g JOIN s ON (0.5 * g.i - s.x) * (0.5 * g.i - s.x) + (0.5 * g.j - s.y) * (0.5 * g.j - s.y) <= s.radius * s.radius GROUP BY 1, 2)
SELECT g.i, g.j, round(CASE WHEN h.v IS NULL THEN g.u ELSE h.v * sin(2 * pi() * 0.5 * 0.25 + 0.5) END, 6) AS u_curr FROM g LEFT JOIN h ON h.i = g.i AND h.j = g.j""")
def wave_sources(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"), (F.col("s_nationkey") * 1.5).alias("x"), (F.col("s_suppkey") % 25).cast("double").alias("y"), F.lit(1.25).alias("radius"), F.col("s_suppkey").cast("double").alias("amplitude"), F.lit(0.5).alias("frequency"), F.lit(0.5).alias("phase"), (F.col("s_suppkey") % 3 != 0).alias("active"))
    return wave.sources_overlay(_state(spark, sf_dir), lenses.months_grid(), s, 0.25).select("i", "j", six(F.col("u_curr")).alias("u_curr"))


_VISIBLE = "v AS (SELECT i, j, u, p FROM s1 WHERE i BETWEEN 8 AND 75 AND j BETWEEN 8 AND 41)"


def _slope(axis, lo, hi, w):
    return f"CASE WHEN {axis} = {lo} THEN (lead(u) OVER {w} - u) / 0.5 WHEN {axis} = {hi} THEN (u - lag(u) OVER {w}) / 0.5 ELSE (lead(u) OVER {w} - lag(u) OVER {w}) / 1.0 END"


_SLOPES = f"{_VISIBLE}, e AS (SELECT i, j, u, p, {_slope('i', 8, 75, W_I)} AS gi, {_slope('j', 8, 41, W_J)} AS gj FROM v)"


def _inside():
    return (F.col("i") >= 8) & (F.col("i") <= 75) & (F.col("j") >= 8) & (F.col("j") <= 41)


@query(f"WITH {GRID}, {_steps_sql(1)}, {_SLOPES} SELECT round(sum((0.5 * ((u - p) / 0.5) * ((u - p) / 0.5) + 0.5 * 4.0 * (gi * gi + gj * gj)) * 0.25), 3) AS energy FROM e")
def wave_energy(spark, sf_dir):
    g = lenses.months_grid()
    state = wave.step(_state(spark, sf_dir), g, 0.0625)
    return wave.total_energy(state, g, 0.5, 2.0, _inside()).select(F.round("energy", 3).alias("energy"))


@query(f"WITH {GRID}, {_steps_sql(1)}, {_SLOPES}, k AS (SELECT *, -(3.0 / 4.0) * exp(-((0.5 * i - 20) * (0.5 * i - 20) + (0.5 * j - 12) * (0.5 * j - 12)) / 8.0) AS bell FROM e) SELECT round(4.0 * sum((gi * bell * (0.5 * i - 20) + gj * bell * (0.5 * j - 12)) * 0.25), 3) AS energy FROM k")
def wave_interaction_energy(spark, sf_dir):
    g = lenses.months_grid()
    state = wave.step(_state(spark, sf_dir), g, 0.0625)
    return wave.interaction_energy(state, g, 20.0, 12.0, 3.0, 2.0, 2.0, _inside()).select(F.round("energy", 3).alias("energy"))


@query("SELECT n_nationkey, round(pi() / 2 * 4.0 * 9.0, 6) AS self_energy, CASE WHEN n_nationkey > 0 THEN round((10.0 - n_nationkey) / n_nationkey, 6) + 0.0 ELSE 0.0 END AS error FROM nation")
def wave_energy_error(spark, sf_dir):
    b = F.col("n_nationkey").cast("double")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.round(F.lit(wave.self_energy(2.0, 3.0)), 6).alias("self_energy"), six(wave.energy_error(F.lit(10.0), b)).alias("error"))


@query(f"WITH {GRID} SELECT i, j, round(u + 2.0 * exp(-((0.5 * i - 10) * (0.5 * i - 10) + (0.5 * j - 12) * (0.5 * j - 12)) / 2.0), 6) AS u_curr, round(0.5 * sin(10.0 * (0.5 * i + 0.5 * j)), 6) + 0.0 AS plane FROM g")
def wave_initial(spark, sf_dir):
    g = lenses.months_grid()
    rows = wave.add_wave(_state(spark, sf_dir), g, 10.0, 12.0, 2.0, 1.0)
    return rows.select("i", "j", six(F.col("u_curr")).alias("u_curr"), six(wave.plane_wave(*g.coords())).alias("plane"))


@query("""WITH s AS (SELECT s_suppkey AS ord, s_nationkey * 1.5 AS x, CAST(s_suppkey % 25 AS DOUBLE) AS y, 1.0 + s_suppkey % 3 AS r FROM supplier),
p AS (SELECT p_partkey, 0.5 * p_size AS x, 0.5 * floor(p_retailprice / 64) AS y FROM part),
b AS (SELECT p_partkey, ord, row_number() OVER (PARTITION BY p_partkey ORDER BY (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y), ord) AS k FROM p JOIN s ON (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) <= s.r * s.r)
SELECT p_partkey, ord FROM b WHERE k = 1""")
def nearest_source(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"), (F.col("s_nationkey") * 1.5).alias("x"), (F.col("s_suppkey") % 25).cast("double").alias("y"), (1.0 + F.col("s_suppkey") % 3).alias("radius"), F.lit(True).alias("active"))
    points = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 0.5).alias("x"), (F.floor(F.col("p_retailprice") / 64) * 0.5).alias("y"))
    return wave.nearest_source(points, s, ["p_partkey"], 2.0)


@query("""WITH s AS (SELECT s_suppkey AS ord, s_nationkey * 1.5 AS x, CAST(s_suppkey % 25 AS DOUBLE) AS y FROM supplier),
p AS (SELECT p_partkey, 0.5 * p_size AS x, 0.5 * floor(p_retailprice / 64) AS y FROM part),
b AS (SELECT p_partkey, ord AS bord, row_number() OVER (PARTITION BY p_partkey ORDER BY (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y), -ord) AS k FROM p JOIN s ON (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) <= 2.25)
SELECT p_partkey, bord FROM b WHERE k = 1""")
def nearest_barrier_point(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("bord"), (F.col("s_nationkey") * 1.5).alias("bx"), (F.col("s_suppkey") % 25).cast("double").alias("by"))
    points = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 0.5).alias("x"), (F.floor(F.col("p_retailprice") / 64) * 0.5).alias("y"))
    return wave.nearest_barrier_point(points, s, 1.5, ["p_partkey"])


@query("SELECT c_custkey, CAST(greatest(0.0, least(83.0, round((c_acctbal / 128) / 0.5))) * 0.5 AS DOUBLE) AS sx, c_nationkey / 25.0 * 2.0 AS px, (1.0 - c_nationkey / 25.0) * 3.0 AS py, 5.0 + greatest(0.0, least(1.0, c_acctbal / 8192)) * 45.0 AS slider, CASE WHEN (c_custkey // 2) * 2 + 1 < 101 THEN CAST(c_custkey // 2 AS BIGINT) ELSE CAST(-1 AS BIGINT) END AS pair FROM customer")
def screen_mapping(spark, sf_dir):
    k = F.col("c_nationkey").cast("double")
    px, py = wave.to_physical(k, k, 25.0, 25.0, 2.0, 3.0)
    return table(spark, sf_dir, "customer").select("c_custkey", wave.snap(F.col("c_acctbal") / 128, 0.5, 84).alias("sx"), px.alias("px"), py.alias("py"), wave.slider_value(F.col("c_acctbal") / 8192, 5.0, 50.0).alias("slider"), F.coalesce(wave.boundary_of_point(F.col("c_custkey"), F.lit(101)), F.lit(-1).cast("long")).alias("pair"))


@query("SELECT 240 AS nx, 240 AS ny, 60 AS sponge, round(0.004 / (1.0 / 119), 6) AS cfl, 5 AS every")
def wave_domain(spark, sf_dir):
    d = wave.Domain(120, 120)
    return spark.createDataFrame([(*d.dims, d.width, round(d.cfl, 6), wave.frame_interval(200, 41))], "nx int, ny int, sponge int, cfl double, every int")


@query("SELECT step FROM (SELECT CAST(unnest(range(200)) AS INTEGER) AS step) WHERE step % 5 = 0")
def wave_frames(spark, sf_dir):
    return wave.frames(spark.range(200).select(F.col("id").cast("int").alias("step")), 200, 41)


# --- rendering
_H = "(u - 10)"


def _pixels(spark, sf_dir, colors, mode, scale):
    g = lenses.months_grid()
    rows = lenses.months(spark, sf_dir).withColumns({"h": F.col("u") - 10, "vx": stencil.derivative(g, 0, 1), "vy": stencil.derivative(g, 1, 1)})
    return rows.select("i", "j", *(c.alias(k) for k, c in colors(F.col("h"), F.col("vx"), F.col("vy"), mode, scale).items()))


_VEL = f"WITH {GRID}, w AS (SELECT i, j, u - 10 AS h, {sql_difference(1, 'i', 84, W_I)} AS vx, {sql_difference(1, 'j', 50, W_J)} AS vy FROM g)"
_CLIP = "CAST(greatest(0, least(255, trunc({v}))) AS INTEGER)"


@query(f"{_VEL} SELECT i, j, CASE WHEN h > 0 THEN {_CLIP.format(v='h * 0.03125 * 255')} ELSE 0 END AS r, 0 AS g, CASE WHEN h > 0 THEN 0 ELSE {_CLIP.format(v='-h * 0.03125 * 255')} END AS b FROM w")
def screen_height(spark, sf_dir):
    return _pixels(spark, sf_dir, render.screen_colors, render.HEIGHT, 0.03125)


@query(f"{_VEL}, k AS (SELECT i, j, {_CLIP.format(v='sqrt(vx * vx + vy * vy) * 0.03125 * 255')} AS r FROM w) SELECT i, j, r, r AS g, r AS b FROM k")
def screen_velocity(spark, sf_dir):
    return _pixels(spark, sf_dir, render.screen_colors, render.VELOCITY, 0.03125)


@query(f"{_VEL} SELECT i, j, {_CLIP.format(v='127.5 + vx * 0.03125 * 127.5')} AS r, {_CLIP.format(v='127.5 + vy * 0.03125 * 127.5')} AS g, {_CLIP.format(v='127.5 + h * 0.03125 * 127.5')} AS b FROM w")
def screen_rgb(spark, sf_dir):
    return _pixels(spark, sf_dir, render.screen_colors, render.RGB, 0.03125)


@query(f"{_VEL} SELECT i, j, CASE WHEN h < 0 THEN {_CLIP.format(v='-h * 4')} ELSE 0 END AS r, 0 AS g, CASE WHEN h < 0 THEN 0 ELSE {_CLIP.format(v='h * 4')} END AS b FROM w")
def image_height(spark, sf_dir):
    return _pixels(spark, sf_dir, render.image_colors, render.HEIGHT, 4.0)


@query(f"{_VEL}, k AS (SELECT i, j, {_CLIP.format(v='sqrt(vx * vx + vy * vy) * 8')} AS r FROM w) SELECT i, j, r, r AS g, r AS b FROM k")
def image_velocity(spark, sf_dir):
    return _pixels(spark, sf_dir, render.image_colors, render.VELOCITY, 4.0)


@query(f"{_VEL} SELECT i, j, {_CLIP.format(v='vx * 8 + 127.5')} AS r, {_CLIP.format(v='vy * 8 + 127.5')} AS g, {_CLIP.format(v='h * 4 + 127.5')} AS b FROM w")
def image_rgb(spark, sf_dir):
    return _pixels(spark, sf_dir, render.image_colors, render.RGB, 4.0)


@query("SELECT 0 AS frame, 54 + 50 * 252 AS n_bytes, '424d' AS magic UNION ALL SELECT 1, 54 + 30 * 120, '424d'")
def bmp_frames(spark, sf_dir):
    g = _barred()
    pixels = _pixels(spark, sf_dir, render.image_colors, render.RGB, 4.0)
    white = boundary.near_boundary(g.barriers, g.coords(), 0.5) > 0
    pixels = render.with_barriers(pixels, white)
    whole = render.frames_to_bmp(pixels.withColumn("frame", F.lit(0)), ["frame"])
    part = render.frames_to_bmp(pixels.withColumn("frame", F.lit(1)), ["frame"], (10, 5, 50, 35))
    return whole.unionByName(part).select("frame", F.length("bytes").alias("n_bytes"), F.lower(F.hex(F.substring("bytes", 1, 2))).alias("magic"))


@query("SELECT CAST(3 AS BIGINT) AS path, CAST(0 AS INTEGER) AS k, CAST(0.0 AS DOUBLE) AS x, CAST(0.0 AS DOUBLE) AS y UNION ALL SELECT 3, 2, 0.125, 0.0 UNION ALL SELECT 3, 4, 0.25, 0.0")
def wave_paint(spark, sf_dir):
    points = spark.range(6).select(F.lit(3).cast("long").alias("path"), F.col("id").cast("int").alias("k"), (F.col("id") * 0.0625).alias("x"), F.lit(0.0).alias("y"))
    return wave.painted(points, ["path"], "k", 0.1).select("path", "k", "x", "y")


FLAGSHIP = "grid_laplacian_open"
assert math.isclose(wave.cfl(1.0, 0.5, 1.0, 2.0), 0.5)
