"""Queries whose operators keep everything in tables: solvers, graphs, barriers and expressions of any size."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkfield.functions import calculus
from sparkfield.functions.expr import derivative_of, einsum, var
from sparkfield.operators import barriers, boundary, forest, graph, krylov, lattice, solvers, systems, tiles
from sparkfield.plans.durable import saved
from sparkfield.sources import lenses
from sparkfield.sources.lenses import table

from . import compile
from .queries import GRID, MATRIX, W_I, _next, _out, query, six, sql_difference

# --- solvers
N = 10
_SIDES = {(-1, 0): 1.0, (1, 0): 1.0, (0, -1): 1.0, (0, 1): 1.0}


def _loads(spark, sf_dir, n: int = N):
    """A square of cells for each supplier, with a load whose Poisson solution is a product of parabolas."""
    inner = lambda: F.explode(F.sequence(F.lit(1), F.lit(n - 1)))
    cells = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") + 1.0).alias("a"), inner().alias("i")).select("*", inner().alias("j"))
    bump = lambda c: F.col(c) * (n - F.col(c))
    return cells.select("s_suppkey", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), (F.col("a") * 2 * (bump("i") + bump("j")) / 3000.0).alias("f"))


def _poisson_sql(n):
    return f"SELECT s_suppkey, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round((s_nationkey + 1.0) * i * ({n} - i) * j * ({n} - j) / 3000.0, 4) AS u, 'SUCCESS' AS status FROM supplier CROSS JOIN (SELECT unnest(range(1, {n})) AS i) CROSS JOIN (SELECT unnest(range(1, {n})) AS j)"


@query(_poisson_sql(N))
def krylov_poisson_tables(spark, sf_dir):
    """-laplacian(u) = f on all suppliers' squares as one system, by Newton-Krylov: its rows are spread over all tasks."""
    cells = _loads(spark, sf_dir).withColumn("x", F.lit(0.0))

    def residual(near, own):
        return sum(w * near(to) for to, w in {**_SIDES, (0, 0): -4.0}.items()) + own["f"]

    out = krylov.newton_krylov_blocks(cells, ["s_suppkey"], ["i", "j"], ["f"], residual, tolerance=1e-5, steps=40)
    return out.table.select("s_suppkey", "i", "j", (F.round("x", 4) + 0.0).alias("u"), F.lit(out.status).alias("status"))


@query(_poisson_sql(N))
def sor_red_black(spark, sf_dir):
    cells = _loads(spark, sf_dir).withColumn("x", F.lit(0.0))
    out = krylov.sor(cells, ["s_suppkey"], ["i", "j"], omega=1.53, tolerance=1e-5)
    return out.table.select("s_suppkey", "i", "j", (F.round("x", 4) + 0.0).alias("u"), F.lit(out.status).alias("status"))


@query("""WITH m AS (SELECT c_custkey, c_nationkey, lag(c_custkey) OVER w AS p, lead(c_custkey) OVER w AS q FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey))
SELECT c_custkey, CAST(c_custkey % 7 AS DOUBLE) AS x FROM m""")
def gmres_matrix(spark, sf_dir):
    """A sparse matrix of entries from a table: 4 on the diagonal, -1 towards the next and the last customer of a nation."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 7).cast("double").alias("want"))
    w = W.partitionBy("c_nationkey").orderBy("c_custkey")
    sides = c.withColumns({"p": F.lag("c_custkey").over(w), "q": F.lead("c_custkey").over(w)})
    entry = lambda other, a: F.struct(other.cast("long").alias("other"), F.lit(a).alias("a"))
    entries = sides.select("c_custkey", F.explode(F.array(entry(F.col("c_custkey"), 4.0), entry(F.col("p"), -1.0), entry(F.col("q"), -1.0))).alias("e")).select("c_custkey", "e.*").where("other is not null")
    entries = saved(entries)
    product = krylov.matrix_product(entries, ["c_custkey"], ["other"])
    b = saved(product(c.select("c_custkey", F.col("want").alias("v"))).withColumnRenamed("w", "b"))
    x, reached = krylov.gmres(b, ["c_custkey"], product, steps=40, tolerance=1e-6)
    return x.select("c_custkey", (F.round("x", 4) + 0.0).alias("x")).where(F.lit(reached))


@query("SELECT p_partkey, round((3.0 * p_size - 7) / 11, 4) + 0.0 AS x, round((28.0 - p_size) / 11, 4) + 0.0 AS y, 'SUCCESS' AS status FROM part")
def solver_sor_linear(spark, sf_dir):
    x, y = var("x"), var("y")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"))
    out = solvers.sor(rows, systems.System((4.0 * x + y - var("s"), x + 3.0 * y - 7.0), ("x", "y"), tolerance=1e-9), ["p_partkey"], omega=1.05)
    return out.select("p_partkey", (F.round("x", 4) + 0.0).alias("x"), (F.round("y", 4) + 0.0).alias("y"), "status")


# --- graphs
def _rings(spark, sf_dir):
    """Customers of a nation in a ring by key, and each order as a tail that depends on its customer."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    w = W.partitionBy("c_nationkey").orderBy("c_custkey")
    ends = c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("first"))
    name = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"))
    ring = c.withColumn("next", F.lead("c_custkey").over(w)).join(ends, "c_nationkey").withColumn("next", F.coalesce("next", "first")).select(name("c_custkey").alias("var"), name("next").alias("dep"))
    nodes = c.select(name("c_custkey").alias("var"), F.col("c_custkey").alias("ord"))
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("var"), (F.col("o_orderkey") + 100_000_000).alias("ord"), name("o_custkey").alias("dep"))
    o = o.join(nodes.select(F.col("var").alias("dep")), "dep", "left_semi")
    return nodes.unionByName(o.select("var", "ord")), ring.unionByName(o.select("var", "dep"))


_RING = "r AS (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey) AS cycle, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos, count(*) OVER (PARTITION BY c_nationkey) AS length FROM customer)"


@query(f"WITH {_RING} SELECT cycle, pos, concat('c', c_custkey) AS var, length FROM r")
def graph_cycles(spark, sf_dir):
    """Every nation's ring, found behind its tails, in order."""
    return graph.cycles(*_rings(spark, sf_dir))


@query(f"WITH {_RING} SELECT string_agg(concat('c', c_custkey), ',' ORDER BY pos) AS path, max(length) AS length FROM r WHERE cycle = (SELECT min(c_custkey) FROM customer)")
def graph_cycle_path(spark, sf_dir):
    return graph.cycle_path(*_rings(spark, sf_dir)).select(F.array_join("path", ",").alias("path"), "length")


@query("""SELECT concat('c', c_custkey) AS var, CAST(min(c_custkey) OVER (PARTITION BY c_nationkey) AS BIGINT) AS scc FROM customer
UNION ALL SELECT concat('o', o_orderkey), CAST(o_orderkey + 100000000 AS BIGINT) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)""")
def graph_components_rings(spark, sf_dir):
    """Long rings without hubs, and nodes that are components of their own."""
    return graph.components(*_rings(spark, sf_dir))


def _chains(spark, sf_dir):
    """Parts of a size in a chain by key; the first of a chain also depends on the last of the chain of the next smaller size."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    w = W.partitionBy("p_size").orderBy("p_partkey")
    ends = p.groupBy("p_size").agg(F.max("p_partkey").alias("last"))
    sizes = W.orderBy("p_size")  # a row for each of the fifty sizes
    ends = ends.withColumn("below", F.lag("last").over(sizes))
    chain = p.withColumn("dep", F.lag("p_partkey").over(w)).join(ends, "p_size").select(F.col("p_partkey").alias("var"), F.coalesce("dep", "below").alias("dep")).where("dep is not null")
    text = lambda df: df.select(*(F.col(c).cast("string").alias(c) for c in df.columns))
    return p.select(F.col("p_partkey").cast("string").alias("var"), F.col("p_partkey").alias("ord")), text(chain)


@query("SELECT CAST(p_partkey AS VARCHAR) AS var, CAST(row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS INTEGER) AS level FROM part")
def graph_deep_chain(spark, sf_dir):
    """One chain through all parts, as deep as the table is long."""
    levels, _ = graph.topological_levels(*_chains(spark, sf_dir), "evaluation")
    return levels.select("var", F.col("level").cast("int").alias("level"))


@query("""WITH RECURSIVE e AS (SELECT a.c_custkey AS v, b.c_custkey AS d FROM customer a JOIN customer b ON b.c_custkey IN (a.c_custkey // 2, a.c_custkey // 3) AND b.c_custkey <> a.c_custkey),
r AS (SELECT c_custkey AS v, 0 AS n FROM customer UNION SELECT e.v, r.n + 1 FROM r JOIN e ON e.d = r.v)
SELECT CAST(v AS VARCHAR) AS var, CAST(max(n) AS INTEGER) AS depth FROM r GROUP BY 1""")
def graph_depth_joins(spark, sf_dir):
    """A graph whose nodes have two dependencies each: a customer's key halved and divided by three."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    deps = c.select(F.col("c_custkey").alias("var"), F.explode(F.array(F.expr("c_custkey div 2"), F.expr("c_custkey div 3"))).alias("dep")).distinct()
    deps = deps.join(c.select(F.col("c_custkey").alias("dep")), "dep", "left_semi").where("var <> dep")
    nodes = c.select(F.col("c_custkey").cast("string").alias("var"), F.col("c_custkey").alias("ord"))
    out = graph.depth(nodes, deps.select(F.col("var").cast("string").alias("var"), F.col("dep").cast("string").alias("dep")))
    return out.select("var", F.col("depth").cast("int").alias("depth"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS var, c_custkey IN (SELECT o_custkey FROM orders) AS has FROM customer")
def graph_depends_on(spark, sf_dir):
    """Which customers some order depends on, as a reachability from all orders at once."""
    nodes, edges = _rings(spark, sf_dir)
    edges = edges.where("var like 'o%'")
    reached = graph.closure(edges).select(F.col("dep").alias("var")).distinct().withColumn("has", F.lit(True))
    return nodes.where("var like 'c%'").join(reached, "var", "left").select(F.substring("var", 2, 20).alias("var"), F.coalesce("has", F.lit(False)).alias("has"))


# --- barriers


def _planes(spark, sf_dir):
    """A line for each part: level, upright or diagonal, by its key."""
    p = table(spark, sf_dir, "part")
    kind = F.col("p_partkey") % 3
    normal = F.when(kind == 0, F.array(F.lit(0.0), F.lit(1.0))).when(kind == 1, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(1.0), F.lit(1.0)))
    point = F.array((F.col("p_partkey") % 97) * 0.5, (F.col("p_partkey") % 53) * 0.5)
    half = 0.3 + F.col("p_size") / 16.0
    return p.select(F.col("p_partkey").alias("bid"), normal.alias("normal"), point.alias("point"), F.array(-half).alias("low"), F.array(half).alias("high"), (F.col("p_partkey") % 7 != 0).alias("active"))


@query("""WITH b AS (SELECT p_partkey AS bid, p_partkey % 3 AS kind, (p_partkey % 97) * 0.5 AS px, (p_partkey % 53) * 0.5 AS py, 0.3 + p_size / 16.0 AS half FROM part WHERE p_partkey % 7 <> 0),
p AS (SELECT o_orderkey, (o_custkey % 101) * 0.5 AS x, (o_orderkey % 61) * 0.5 AS y FROM orders)
SELECT o_orderkey, min(bid) AS bid FROM p LEFT JOIN b ON CASE kind WHEN 0 THEN y = py AND abs(x - px) <= half WHEN 1 THEN x = px AND abs(y - py) <= half ELSE x - px = py - y AND abs(x - px) * sqrt(2) <= half END GROUP BY 1""")
def points_near_planes(spark, sf_dir):
    """Orders as points on a lattice, a bounded line for each part."""
    points = table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_custkey") % 101) * 0.5).alias("x"), ((F.col("o_orderkey") % 61) * 0.5).alias("y"))
    return barriers.near_barriers(points, "o_orderkey", ["x", "y"], _planes(spark, sf_dir), size=2.0)


@query("""WITH b AS (SELECT s_suppkey AS bid, s_suppkey % 2 AS kind, (s_suppkey % 17) * 0.5 AS px, (s_suppkey % 13) * 0.5 AS py, (s_suppkey % 11) * 0.5 AS pz, 0.7 + s_nationkey / 8.0 AS half FROM supplier),
p AS (SELECT c_custkey, (c_custkey % 23) * 0.5 AS x, (c_custkey % 19) * 0.5 AS y, c_nationkey * 0.5 AS z FROM customer)
SELECT c_custkey, min(bid) AS bid FROM p LEFT JOIN b ON abs(z - pz) <= half AND CASE kind WHEN 0 THEN x = px AND abs(y - py) <= half ELSE x - px = py - y AND abs(x - px) * sqrt(2) <= half END GROUP BY 1""")
def points_near_planes_3d(spark, sf_dir):
    """Upright and diagonal rectangles in space."""
    s = table(spark, sf_dir, "supplier")
    normal = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(1.0), F.lit(1.0), F.lit(0.0)))
    half = 0.7 + F.col("s_nationkey") / 8.0
    planes = s.select(F.col("s_suppkey").alias("bid"), normal.alias("normal"), F.array(*((F.col("s_suppkey") % m) * 0.5 for m in (17, 13, 11))).alias("point"), F.array(-half, -half).alias("low"), F.array(half, half).alias("high"))
    points = table(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_custkey") % 23) * 0.5).alias("x"), ((F.col("c_custkey") % 19) * 0.5).alias("y"), (F.col("c_nationkey") * 0.5).alias("z"))
    return barriers.near_barriers(points, "c_custkey", ["x", "y", "z"], planes, size=1.0)


@query("""SELECT p_partkey AS bid, (p_partkey % 97) * 0.5 + CASE WHEN p_partkey IN (SELECT s_suppkey FROM supplier) THEN 0.5 ELSE 0 END + 0.0::DOUBLE AS px, (p_partkey % 53) * 0.5 - CASE WHEN p_partkey IN (SELECT s_suppkey FROM supplier) THEN 0.25 ELSE 0 END + 0.0::DOUBLE AS py
FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)""")
def barriers_edited(spark, sf_dir):
    """The parts' lines: those of suppliers' keys moved, those of some customers' keys deleted."""
    moves = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("bid"), F.array(F.lit(0.5), F.lit(-0.25)).alias("by"))
    gone = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("bid"))
    left = barriers.deleted(barriers.moved(_planes(spark, sf_dir), moves), gone)
    return left.select("bid", F.col("point")[0].alias("px"), F.col("point")[1].alias("py"))


@query("""WITH p AS (SELECT c_custkey // 2 AS bid, c_custkey % 2 AS e, CAST(c_nationkey AS DOUBLE) AS x, CAST(c_custkey % 7 AS DOUBLE) AS y FROM customer),
s AS (SELECT bid, max(CASE WHEN e = 0 THEN x END) AS x0, max(CASE WHEN e = 0 THEN y END) AS y0, max(CASE WHEN e = 1 THEN x END) AS x1, max(CASE WHEN e = 1 THEN y END) AS y1, count(*) AS n FROM p GROUP BY bid),
t AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM s WHERE n = 2)
SELECT bid, round((y1 - y0) / len, 6) + 0.0 AS nx, round(-(x1 - x0) / len, 6) + 0.0 AS ny FROM t WHERE len >= 1e-6""")
def barrier_segments_right(spark, sf_dir):
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_nationkey").cast("double").alias("x"), (F.col("c_custkey") % 7).cast("double").alias("y"))
    return boundary.segments_to_barriers(points, right=True).select("bid", six(F.col("nx")).alias("nx"), six(F.col("ny")).alias("ny"))


# --- expressions as tables
def _order_terms(spark, sf_dir):
    """Each order as the sum of its lines, added one by one, and each line as a coefficient times a variable; every other operation has its operands the other way round.

    Line r has the nodes 4 r + 1 (coefficient), 4 r + 2 (variable), 4 r + 3 (product) and, but for the first, 4 r (sum so far).
    """
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "expr")
    w = W.partitionBy("expr").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    line = li.select("expr", F.row_number().over(w).cast("long").alias("r"), F.lead(F.lit(True)).over(w).isNotNull().alias("more"), (F.col("l_quantity").cast("int") % 2).cast("string").alias("c"), F.concat(F.lit("x"), (F.col("l_partkey") % 2).cast("string")).alias("x"))
    r = F.col("r")
    swap, after = (r % 2).cast("int"), ((r + 1) % 2).cast("int")
    no_label = F.lit(None).cast("string")
    term = lambda node, op, label, parent, pos: F.struct(node.alias("node"), F.lit(True).alias("own"), F.lit(op).alias("op"), label.alias("label"), parent.alias("parent"), pos.alias("pos"))
    inner = [term(r * 4 + 1, "lit", F.col("c"), r * 4 + 3, swap), term(r * 4 + 2, "var", F.col("x"), r * 4 + 3, 1 - swap)]
    up, place = F.when(F.col("more"), r * 4 + 4), F.when(F.col("more"), after)
    lone = F.array(*inner, term(r * 4 + 3, "*", no_label, up, place))
    later = F.array(*inner, term(r * 4 + 3, "*", no_label, r * 4, 1 - swap), term(r * 4, "+", no_label, up, place))
    return line.select("expr", F.when(r > 1, later).otherwise(lone).alias("terms"))


_SHA = "sha256('{op}||' || least({a}, {b}) || ',' || greatest({a}, {b}))"
_LEAVES = "sha256('lit|' || {c} || '|')", "sha256('var|x' || {x} || '|')"
_ORDER_SUMS = f"""l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r, CAST(CAST(l_quantity AS INTEGER) % 2 AS VARCHAR) AS c, CAST(l_partkey % 2 AS VARCHAR) AS x FROM lineitem),
m AS (SELECT l_orderkey, r, {_SHA.format(op='*', a=_LEAVES[0].format(c='c'), b=_LEAVES[1].format(x='x'))} AS h FROM l),
o AS (SELECT l_orderkey, list_reduce(list(h ORDER BY r), lambda a, b: {_SHA.format(op='+', a='a', b='b')}) AS hash, CAST(4 * count(*) - 1 AS BIGINT) AS size FROM m GROUP BY 1)"""


def _order_hashes(spark, sf_dir):
    return forest.hashes_of_terms(_order_terms(spark, sf_dir), roots_only=True).drop("node")


@query(f"WITH {_ORDER_SUMS} SELECT l_orderkey, hash, size, min(l_orderkey) OVER (PARTITION BY hash) AS first, l_orderkey = min(l_orderkey) OVER (PARTITION BY hash) AS is_new FROM o")
def expr_table_registry(spark, sf_dir):
    """Orders that are the same sum but for the order of operands."""
    return forest.registered(_order_hashes(spark, sf_dir)).select(F.col("expr").alias("l_orderkey"), "hash", "size", "first", "is_new")


@query(f"""WITH {_ORDER_SUMS}, n AS (SELECT hash, count(*) AS n FROM o GROUP BY 1),
p AS (SELECT p_partkey, {_SHA.format(op='*', a=_LEAVES[0].format(c='CAST(p_size % 3 AS VARCHAR)'), b=_LEAVES[1].format(x='CAST(p_partkey % 2 AS VARCHAR)'))} AS hash FROM part)
SELECT p_partkey, coalesce(n, 0) AS n, n IS NOT NULL AS known FROM p LEFT JOIN n USING (hash)""")
def expr_table_matching(spark, sf_dir):
    """For a product per part, how many orders are that product."""
    p = table(spark, sf_dir, "part")
    leaf = lambda node, op, label: F.struct(F.lit(node).alias("node"), F.lit(op).alias("op"), label.cast("string").alias("label"))
    parts = F.array(leaf(1, "lit", F.col("p_size") % 3), leaf(2, "var", F.concat(F.lit("x"), (F.col("p_partkey") % 2).cast("string"))), leaf(3, "*", F.lit(None)))
    nodes = p.select(F.col("p_partkey").alias("expr"), F.explode(parts).alias("n")).select("expr", "n.*")
    children = nodes.where("node < 3").select("expr", F.lit(3).alias("parent"), F.col("node").alias("pos"), F.col("node").alias("child"))
    probes = forest.hashes(nodes, children).where("node = 3").select(F.col("expr").alias("p_partkey"), "hash")
    return forest.matching(probes, _order_hashes(spark, sf_dir)).select("p_partkey", "n", (F.col("n") > 0).alias("known"))


@query("SELECT l_orderkey, concat('x', l_partkey % 2) AS name, count(*) AS n FROM lineitem GROUP BY 1, 2")
def expr_table_variables(spark, sf_dir):
    return forest.variable_counts(_order_terms(spark, sf_dir).select("expr", F.inline("terms"))).withColumnRenamed("expr", "l_orderkey")


# --- grids of four axes
_FOUR = lattice.Lattice((7, 12, 7, 5), (1.0, 0.5, 1.0, 0.25))
_FOUR_SQL = """c AS (SELECT year(l_shipdate) - 1995 AS a, month(l_shipdate) - 1 AS b, l_linenumber - 1 AS c, CAST(floor((l_quantity - 1) / 10) AS BIGINT) AS d, CAST(count(*) AS DOUBLE) AS u FROM lineitem GROUP BY 1, 2, 3, 4),
g AS (SELECT x.a, y.b, z.c, w.d, coalesce(u, 0.0) AS u FROM (SELECT unnest(range(7)) AS a) x CROSS JOIN (SELECT unnest(range(12)) AS b) y CROSS JOIN (SELECT unnest(range(7)) AS c) z CROSS JOIN (SELECT unnest(range(5)) AS d) w LEFT JOIN c ON c.a = x.a AND c.b = y.b AND c.c = z.c AND c.d = w.d)"""


def _four_second(axis, n, h):
    w = f"(PARTITION BY {', '.join(x for x in 'abcd' if x != axis)} ORDER BY {axis})"
    return f"CASE WHEN {axis} IN (0, {n - 1}) THEN 0.0 ELSE (lag(u) OVER {w} - 2 * u + lead(u) OVER {w}) / ({h} * {h}) END"


def _four_first(axis, n, h):
    w = f"(PARTITION BY {', '.join(x for x in 'abcd' if x != axis)} ORDER BY {axis})"
    return f"CASE WHEN {axis} = 0 THEN (lead(u) OVER {w} - u) / {h} WHEN {axis} = {n - 1} THEN (u - lag(u) OVER {w}) / {h} ELSE (lead(u) OVER {w} - lag(u) OVER {w}) / (2 * {h}) END"


def _four(spark, sf_dir):
    """Line items by year, month, line number and tens of quantity."""
    at = _FOUR.place([F.year("l_shipdate") - 1995, F.month("l_shipdate") - 1, F.col("l_linenumber") - 1, F.floor((F.col("l_quantity") - 1) / 10)])
    counted = table(spark, sf_dir, "lineitem").select(at.alias("pos")).where("pos is not null").groupBy("pos").agg(F.count(F.lit(1)).cast("double").alias("u"))
    return _FOUR.densify(counted)


_AXES = list(zip("abcd", _FOUR.shape, _FOUR.spacing, strict=True))
_POS = "CAST(((a * 12 + b) * 7 + c) * 5 + d AS BIGINT)"


@query(f"WITH {_FOUR_SQL} SELECT {_POS} AS pos, {' + '.join(_four_second(*x) for x in _AXES)} AS lap FROM g")
def lattice_laplacian(spark, sf_dir):
    return _FOUR.laplacian(_four(spark, sf_dir))


@query(f"WITH {_FOUR_SQL} SELECT {_POS} AS pos, {', '.join(f'{_four_first(*x)} AS d{k}' for k, x in enumerate(_AXES))} FROM g")
def lattice_gradient(spark, sf_dir):
    return _FOUR.gradient(_four(spark, sf_dir))


@query(f"WITH {_FOUR_SQL} SELECT {_POS} AS pos, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(c AS INTEGER) AS c, CAST(d AS INTEGER) AS d, CAST(0.5 * b AS DOUBLE) AS y, {_POS} AS back, a IN (0, 6) OR b IN (0, 11) OR c IN (0, 6) OR d IN (0, 4) AS edge FROM g WHERE u > 0")
def lattice_addressing(spark, sf_dir):
    cells = _four(spark, sf_dir).where("u > 0")
    a, b, c, d = _FOUR.index(F.col("pos"))
    xyz = _FOUR.coords(F.col("pos"))
    return cells.select("pos", a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), xyz[1].alias("y"), _FOUR.nearest(xyz).alias("back"), _FOUR.is_edge(F.col("pos")).alias("edge"))


# --- tensors
@query("""WITH a AS (SELECT l_orderkey // 4 AS r, l_partkey AS c, sum(CAST(l_linenumber AS DOUBLE)) AS v FROM lineitem GROUP BY 1, 2),
b AS (SELECT p_partkey AS c, p_size % 8 AS k, CAST(p_partkey % 5 + 1 AS DOUBLE) AS v FROM part)
SELECT r, CAST(k AS BIGINT) AS k, sum(a.v * b.v) AS v FROM a JOIN b USING (c) GROUP BY 1, 2""")
def tensor_matmul_tiles(spark, sf_dir):
    """Orders by parts times parts by sizes, in tiles of 64 by 64."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    a = tiles.tiled(li.select(F.expr("l_orderkey div 4").alias("row"), F.col("l_partkey").alias("col"), F.col("l_linenumber").alias("v")))
    b = tiles.tiled(p.select(F.col("p_partkey").alias("row"), (F.col("p_size") % 8).alias("col"), (F.col("p_partkey") % 5 + 1).alias("v")))
    return tiles.entries(tiles.matmul(a, b)).select(F.col("row").alias("r"), F.col("col").cast("long").alias("k"), "v")


@query("SELECT l_orderkey // 4 AS part, l_partkey AS row, sum(CAST(l_linenumber AS DOUBLE)) AS v FROM lineitem GROUP BY 1, 2")
def tensor_transpose_tiles(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a = tiles.tiled(li.select(F.expr("l_orderkey div 4").alias("row"), F.col("l_partkey").alias("col"), F.col("l_linenumber").alias("v")))
    return tiles.entries(tiles.transposed(a)).select(F.col("col").alias("part"), "row", "v")


@query(f"WITH {MATRIX}, p AS (SELECT a.vec_id, a.j, b.k, sum(a.v * b.v) AS v FROM m a JOIN m b ON b.vec_id = a.vec_id + 1 AND a.k = b.j GROUP BY 1, 2, 3) SELECT vec_id, j, k, 2 * v AS v FROM p")
def expr_product_derivatives(spark, sf_dir):
    """d/dt of einsum(tA, B) + (tA) @ B, by the rules for einsum and matmul: twice the product of A and B."""
    t, a, b = var("t"), var("A"), var("B")
    e = einsum(t * a, "ij", "ik", b, "jk") + (t * a) @ b
    env = {"A": lenses.matrices(spark, sf_dir), "B": _next(spark, sf_dir)}
    return _out(compile.tensors(calculus.simplify(calculus.derivative(e, "t")), env, spark), "i")


@query(f"WITH {MATRIX} SELECT a.vec_id, sum(a.v * b.v) AS v FROM m a JOIN m b ON b.vec_id = a.vec_id + 1 AND a.j = b.j AND a.k = b.k GROUP BY 1")
def expr_dot_derivative(spark, sf_dir):
    """d/dt of dot(tA, B)."""
    t, a, b = var("t"), var("A"), var("B")
    env = {"A": lenses.matrices(spark, sf_dir), "B": _next(spark, sf_dir)}
    return _out(compile.tensors(calculus.simplify(calculus.derivative((t * a).dot(b), "t")), env, spark), "i", "j", "k")


@query(f"WITH {GRID} SELECT i, j, 2 * ({sql_difference(1, 'i', 84, W_I)}) AS d FROM g")
def grid_derivative_of_derivative(spark, sf_dir):
    """d/dx of the node d(u u)/du, which becomes the difference along x of 2 u."""
    e = calculus.simplify(calculus.derivative(derivative_of(var("u") * var("u"), "u"), "x"))
    return compile.on_grid(lenses.months(spark, sf_dir), e, lenses.months_grid(), "d").select("i", "j", "d")


@query("""WITH n AS (SELECT p_partkey, CAST(p_partkey % 3 AS DOUBLE) AS x, CAST(p_size % 4 AS DOUBLE) AS y FROM part WHERE p_partkey % 3 + p_size % 4 > 0)
SELECT p_partkey, round(abs(x / sqrt(x * x + y * y)), 6) AS cross, CAST(1 AS DOUBLE) AS length, CAST(0 AS DOUBLE) AS along FROM n""")
def plane_basis(spark, sf_dir):
    """Within a line with normal (x, y): the direction's length, its product with the normal, and its second component's size."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("bid"), F.array((F.col("p_partkey") % 3).cast("double"), (F.col("p_size") % 4).cast("double")).alias("normal"))
    p = p.where(F.col("normal")[0] + F.col("normal")[1] > 0).select("bid", "normal", F.array(F.lit(0.0), F.lit(0.0)).alias("point"), F.array(F.lit(-1.0)).alias("low"), F.array(F.lit(1.0)).alias("high"))
    d, n = F.col("directions")[0], F.col("normal")
    return barriers.prepared(p, 2).select(F.col("bid").alias("p_partkey"), F.round(F.abs(d[1]), 6).alias("cross"), F.round(F.sqrt(d[0] * d[0] + d[1] * d[1]), 6).alias("length"), F.round(F.abs(d[0] * n[0] + d[1] * n[1]), 6).alias("along"))
