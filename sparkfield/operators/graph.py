"""Dependency graphs as node (var, ord) and edge (var, dep) tables.

Everything is iterative joins; only counts reach the driver, and each round is checkpointed.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Observation, Row, SparkSession, functions as F

from sparkfield.functions.expr import Expr, variables
from sparkfield.plans.durable import BROADCAST_ROWS, durable, saved


def from_definitions(spark: SparkSession, definitions: Mapping[str, Expr]) -> tuple[DataFrame, DataFrame]:
    """Nodes in order of definition and the distinct variables each depends on; redefinition replaces."""
    nodes = spark.createDataFrame([(v, i, str(e)) for i, (v, e) in enumerate(definitions.items())], "var string, ord int, definition string")
    edges = [(v, d, p) for v, e in definitions.items() for p, d in enumerate(variables(e))]
    return nodes, spark.createDataFrame(edges, "var string, dep string, pos int")


def closure(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Distinct (var, dep) with dep reachable from var, cycles included; from ``start(var)`` only, if given."""
    edges = edges.select("var", "dep").distinct()
    new = edges.join(start, "var", "left_semi") if start is not None else edges
    known = new = durable(new)
    while not new.isEmpty():
        step = edges.select(F.col("var").alias("dep"), F.col("dep").alias("_next"))
        new = durable(new.join(step, "dep").select("var", F.col("_next").alias("dep")).distinct().join(known, ["var", "dep"], "left_anti"))
        known = durable(known.unionByName(new))
    return known


def depends_on(edges: DataFrame, a: str, b: str) -> bool:
    start = edges.where(F.col("var") == a).select("var").distinct()
    return not closure(edges, start).where(F.col("dep") == b).isEmpty()


def dependents(edges: DataFrame, name: str) -> DataFrame:
    """Variables that depend on ``name``, directly or not."""
    back = edges.select(F.col("dep").alias("var"), F.col("var").alias("dep"))
    start = back.where(F.col("var") == name).select("var").distinct()
    return closure(back, start).select(F.col("dep").alias("var"))


def _rounds(n: int) -> int:
    """Doublings that reach every node of a path of ``n``."""
    return max(1, n).bit_length()


def _levels(nodes: DataFrame, edges: DataFrame, leaf: str, other: str) -> DataFrame:
    """(var, level): 0 for nodes that no edge has as ``leaf``, else one more than the highest of their ``other`` ends; none on or behind a cycle.

    A node with one open predecessor is at max(c, level of that one + d), and such functions
    compose to one of their kind: by pointer doubling every tree and chain is settled in a
    number of joins that grows with the logarithm of its depth. What remains are nodes with
    several open predecessors; their settled ones become constants, and the round repeats. The
    nodes that hang on them by one way are settled afterwards, last round first.
    """
    own = nodes.select("var").distinct()
    inner = edges.select(F.col(leaf).alias("var"), F.col(other).alias("p")).distinct().join(own, "var", "left_semi").join(own.withColumnRenamed("var", "p"), "p", "left_semi")
    # a node's terms: d from its open predecessor p, or the constant d where p is null
    none = F.lit(None).cast(own.schema["var"].dataType)
    terms = saved(inner.select("var", "p", F.lit(1).alias("d")).unionByName(own.select("var", none.alias("p"), F.lit(0).alias("d"))))
    ended, waiting = [], []
    while True:
        edge = F.col("p").isNotNull()
        sums = terms.groupBy("var").agg(F.max(F.when(~edge, F.col("d"))).alias("c"), F.count("p").alias("n"), F.min("p").alias("p"), F.min(F.when(edge, F.col("d"))).alias("d"))
        seen = Observation()
        state = saved(sums.observe(seen, F.count_if(F.col("n") == 0).alias("settled"), F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n") > 1).alias("joins")))
        counts = Row(**{k: seen.get[k] or 0 for k in ("settled", "single", "joins")})
        if not counts.settled:
            break
        jump = state.where("n < 2").select("var", "c", "p", "d")
        if counts.single:
            jump = saved(jump)
        for k in range(_rounds(counts.single) if counts.single else 0):
            # a node settled or with several open predecessors ends the jumps
            up = jump.select(F.col("var").alias("p"), F.col("c").alias("_c"), F.col("p").alias("_p"), F.col("d").alias("_d"))
            met = jump.join(up, "p", "left")
            on = F.col("_c").isNotNull()
            c = F.when(on, F.greatest("c", F.col("_c") + F.col("d"))).otherwise(F.col("c"))
            ahead = F.when(on, F.col("_p")).otherwise(F.col("p"))
            d = F.when(on, F.col("d") + F.col("_d")).otherwise(F.col("d"))
            jump = saved(met.select("var", c.alias("c"), ahead.alias("p"), F.when(ahead.isNotNull(), d).alias("d"), (on & F.col("_p").isNotNull()).alias("open")), jump)
            if jump.where("open").isEmpty():
                break
        ended.append(jump.where("p is null").select("var", F.col("c").alias("level")))
        if len(ended) == 16:
            ended = [saved(reduce(DataFrame.unionByName, ended))]
        if not counts.joins:
            break
        # nodes whose one way leads to a node with several predecessors wait for that one
        waiting.append(jump.where("p is not null").select(F.col("var").alias("_var"), F.col("c").alias("_c"), F.col("p").alias("var"), F.col("d").alias("_d")))
        # the rest: nodes with several predecessors, whose edges now begin where the jumps ended;
        # while few nodes are reached in a round, the edges to them are found without a shuffle
        few = F.broadcast if counts.settled + counts.single <= BROADCAST_ROWS else lambda df: df
        reach = few(jump.select(F.col("var").alias("_k"), F.col("c").alias("_c"), F.col("p").alias("_p"), F.col("d").alias("_d")))
        # constants meet nothing, by their own node, which is not reached: nulls would all be one task's
        moved = terms.join(few(jump.select("var")), "var", "left_anti").withColumn("_k", F.coalesce("p", "var")).join(reach, "_k", "left")
        term = lambda p, d: F.struct(p.alias("p"), d.alias("d"))
        met = F.col("_c").isNotNull()
        further = F.when(F.col("_p").isNotNull(), term(F.col("_p"), F.col("d") + F.col("_d")))
        new = F.when(met, F.array_compact(F.array(term(none, F.col("d") + F.col("_c")), further))).otherwise(F.array(term(F.col("p"), F.col("d"))))
        terms = saved(moved.select("var", F.explode(new).alias("t")).groupBy("var", "t.p").agg(F.max("t.d").alias("d")), terms)
    done = reduce(DataFrame.unionByName, ended) if ended else None
    if done is None:
        return nodes.select("var", F.lit(0).alias("level")).where("false")
    for those in reversed(waiting):
        done = saved(done.unionByName(those.join(done, "var").select(F.col("_var").alias("var"), F.greatest("_c", F.col("level") + F.col("_d")).alias("level"))))
    return done


def topological_levels(nodes: DataFrame, edges: DataFrame, order: str = "dependents_first") -> tuple[DataFrame, bool]:
    """(var, level) and whether the graph is acyclic.

    ``dependents_first`` puts a variable before what it depends on, ``evaluation`` after.
    Within a level, order by the nodes' ord.
    """
    if order not in ("dependents_first", "evaluation"):
        raise ValueError(f"unknown order {order!r}")
    levels = _levels(nodes, edges, *(("dep", "var") if order == "dependents_first" else ("var", "dep")))
    return levels, levels.count() == nodes.select("var").distinct().count()


def detect_cycles(nodes: DataFrame, edges: DataFrame) -> str:
    """SELF_REFERENTIAL, HAS_CYCLES or ACYCLIC; dependencies that are not defined count for nothing."""
    if not edges.where("var = dep").join(nodes, "var", "left_semi").isEmpty():
        return "SELF_REFERENTIAL"
    return "ACYCLIC" if topological_levels(nodes, edges)[1] else "HAS_CYCLES"


def depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(var, depth): 0 without dependencies or a definition, else one more than the deepest; null on or above a cycle."""
    every = nodes.select("var").unionByName(edges.select(F.col("dep").alias("var"))).distinct()
    levels = _levels(every, edges, "var", "dep").withColumnRenamed("level", "depth")
    return nodes.select("var").join(levels, "var", "left")


def _without_tails(edges: DataFrame, start: str, end: str) -> DataFrame:
    """Edges but those that begin where none ends, again and again for as long as an eighth goes: no such node is on a cycle."""
    size = edges.count()
    while size:
        edges = saved(edges.join(edges.select(F.col(end).alias(start)).distinct(), start, "left_semi"))
        left = edges.count()
        if 8 * left > 7 * size:
            break
        size = left
    return edges


def _pointer_cycles(after: DataFrame) -> DataFrame:
    """(cycle, pos, v, length) of the cycles of ``after(v, next)``, in which every next is some v: cycle is its least v, at pos 0.

    By doubling: jumps of 2^k steps end on cycles, and take the least node that they pass
    along; then the steps up to that node are counted in the same way. Tails are cut off first.
    """
    after = _without_tails(after, "v", "next")
    jump = saved(after.select("v", F.col("next").alias("to"), F.least("v", "next").alias("least")))
    rounds = _rounds(jump.count())
    for _ in range(rounds):
        far = jump.select(F.col("v").alias("to"), F.col("to").alias("_to"), F.col("least").alias("_least"))
        jump = saved(jump.join(far, "to").select("v", F.col("_to").alias("to"), F.least("least", "_least").alias("least")), jump)
    on = saved(jump.join(jump.select(F.col("to").alias("v")).distinct(), "v", "left_semi").select("v", F.col("least").alias("cycle")))
    # steps to the least node, which is where they end
    steps = after.join(on, "v").select("v", "cycle", F.when(F.col("v") == F.col("cycle"), F.col("v")).otherwise(F.col("next")).alias("to"), F.when(F.col("v") == F.col("cycle"), 0).otherwise(1).cast("long").alias("n"))
    steps = saved(steps)
    for _ in range(rounds):
        far = steps.select(F.col("v").alias("to"), F.col("to").alias("_to"), F.col("n").alias("_n"))
        steps = saved(steps.join(far, "to").select("v", "cycle", F.col("_to").alias("to"), (F.col("n") + F.col("_n")).alias("n")), steps)
    sizes = steps.groupBy("cycle").agg(F.count(F.lit(1)).alias("length"))
    return steps.join(sizes, "cycle").select("cycle", F.pmod(F.col("length") - F.col("n"), F.col("length")).alias("pos"), "v", "length")


def _numbered(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (var, ord) and the edges between them as (s, t) by ord."""
    ids = saved(nodes.select("var", F.col("ord").cast("long").alias("ord")))
    number = lambda c: ids.select(F.col("var").alias(c), F.col("ord").alias(f"_{c}"))
    return ids, saved(edges.select("var", "dep").join(number("var"), "var").join(number("dep"), "dep").select(F.col("_var").alias("s"), F.col("_dep").alias("t")).distinct())


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(cycle, pos, var, length): cycles of the graph, each a path of ``length`` nodes from pos 0 on, and back.

    Nodes that are on no cycle and above none are peeled off; each other one has a dependency
    of its kind, and follows the one with the least ord (itself, if it depends on itself).
    Where these pointers run in a ring is a cycle, named by its least ord. A cyclic graph has
    one at least; not every cycle is named, as there can be exponentially many.
    """
    ids, graph = _numbered(nodes, edges)
    # what nothing depends on is on no cycle, and no pointer leads there
    graph = _without_tails(graph, "s", "t")
    ends = graph.select(F.explode(F.array("s", "t")).alias("var")).distinct()
    peeled = _levels(ends, graph, "s", "t")
    for c in ("s", "t"):
        graph = graph.join(peeled.select(F.col("var").alias(c)), c, "left_anti")
    after = graph.groupBy(F.col("s").alias("v")).agg(F.min(F.when(F.col("s") == F.col("t"), -1).otherwise(F.col("t"))).alias("next"))
    after = saved(after.select("v", F.when(F.col("next") < 0, F.col("v")).otherwise(F.col("next")).alias("next")))
    return _pointer_cycles(after).join(ids, F.col("v") == F.col("ord")).select("cycle", "pos", "var", "length")


def cycle_path(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (path, length) for the cycle with the least ord; none for an acyclic graph."""
    found = cycles(nodes, edges)
    first = found.where(F.col("pos") == 0).orderBy("cycle").limit(1).select("cycle")
    return found.join(first, "cycle").groupBy("cycle", "length").agg(F.array_sort(F.collect_list(F.struct("pos", "var"))).alias("p")).select(F.col("p.var").alias("path"), "length")


def _by_colour(rest: DataFrame, inner: DataFrame) -> DataFrame:
    """(ord, c): the components of the nodes whose colour comes from themselves.

    Colours: the least ord that reaches a node spreads along the edges; what reaches the
    colour's own node back within the colour is its component.
    """
    colour = saved(rest.select("ord", F.col("ord").alias("c")))
    while True:
        into = inner.join(colour.withColumnRenamed("ord", "s"), "s").groupBy(F.col("t").alias("ord")).agg(F.min("c").alias("_c"))
        new = saved(colour.join(into, "ord", "left").select("ord", F.least("c", F.coalesce("_c", "c")).alias("c"), (F.coalesce("_c", "c") < F.col("c")).alias("moved")))
        moved = not new.where("moved").isEmpty()
        colour = new.drop("moved")
        if not moved:
            break
    own = inner.join(colour.withColumnsRenamed({"ord": "s", "c": "cs"}), "s").join(colour.withColumnsRenamed({"ord": "t", "c": "ct"}), "t").where("cs = ct").select("s", "t")
    own = saved(own)
    back = new = saved(colour.where("ord = c"))
    while not new.isEmpty():
        new = saved(own.join(new.withColumnRenamed("ord", "t"), "t").select(F.col("s").alias("ord"), "c").distinct().join(back.select("ord"), "ord", "left_anti"))
        back = saved(back.unionByName(new))
    return back


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Strongly connected components (var, scc) with scc the least ord in each.

    In each round, nodes that are on no cycle are trimmed from both ends; of the others each
    points to one of its dependencies, by a hash of the round, and every ring of pointers is
    contracted to one node. Both take joins in number of the logarithm of the length, so long
    rings cost little. Where that takes off less than an eighth (a hub has one ring at a
    time), components are found by colours, whose rounds grow with the diameter only.
    """
    ids, graph = _numbered(nodes, edges)
    graph = saved(graph.where("s <> t"))
    rest, turn = ids.select("ord"), 0
    # of nodes that were contracted into others, and of components found by colours; the others stand for themselves
    member = saved(ids.select("ord", F.col("ord").alias("rep")).where("false"))
    found = saved(ids.select("ord", F.col("ord").alias("c")).where("false"))

    def within(graph: DataFrame, rest: DataFrame) -> DataFrame:
        return graph.join(rest.withColumnRenamed("ord", "s"), "s", "left_semi").join(rest.withColumnRenamed("ord", "t"), "t", "left_semi")

    while True:
        for a, b in (("s", "t"), ("t", "s")):
            graph = _without_tails(graph, b, a)
            rest = saved(graph.select(F.explode(F.array("s", "t")).alias("ord")).distinct())
            if rest.join(graph.select(F.col(a).alias("ord")), "ord", "left_anti").isEmpty():
                continue
            trimmed = saved(_levels(rest.withColumnRenamed("ord", "var"), graph, a, b).select(F.col("var").alias("ord")))
            rest = saved(rest.join(trimmed, "ord", "left_anti"))
            graph = saved(within(graph, rest))
        size = rest.count()
        if not size:
            break
        turn += 1
        pick = F.min_by("t", F.xxhash64("t", "s", F.lit(turn)))
        rings = saved(_pointer_cycles(saved(graph.groupBy(F.col("s").alias("v")).agg(pick.alias("next")))).select("v", "cycle"))
        name = lambda c: F.coalesce("cycle", c)
        moved = member.join(rings, F.col("rep") == F.col("v"), "left").select("ord", name("rep").alias("rep"))
        member = saved(moved.unionByName(rings.where("v <> cycle").select(F.col("v").alias("ord"), F.col("cycle").alias("rep"))))
        for c in ("s", "t"):
            graph = graph.join(rings, F.col(c) == F.col("v"), "left").withColumn(c, name(c)).drop("v", "cycle")
        graph = saved(graph.where("s <> t").distinct())
        rest = saved(rest.join(rings, F.col("ord") == F.col("v"), "left").select(name("ord").alias("ord")).distinct())
        if 8 * rest.count() > 7 * size:
            some = _by_colour(rest, graph)
            found = saved(found.unionByName(some.select("ord", "c")))
            rest = saved(rest.join(some.select("ord"), "ord", "left_anti"))
            graph = saved(within(graph, rest))
    # rings, and so contracted nodes, are named by their least ord, and colours by the least of those
    whole = ids.join(member, "ord", "left").withColumn("_n", F.coalesce("rep", "ord"))
    return whole.join(found.withColumnRenamed("ord", "_n"), "_n", "left").select("var", F.coalesce("c", "_n").alias("scc"))


def structure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: acyclic, n_components, max_size, sizes, n_isolated (nodes without dependencies)."""
    sizes = components(nodes, edges).groupBy("scc").agg(F.count(F.lit(1)).alias("n"))
    summary = sizes.agg(F.count(F.lit(1)).alias("n_components"), F.max("n").alias("max_size"), F.array_sort(F.collect_list("n")).alias("sizes"))
    alone = nodes.join(edges, "var", "left_anti").agg(F.count(F.lit(1)).alias("n_isolated"))
    return summary.crossJoin(alone).withColumn("acyclic", F.lit(detect_cycles(nodes, edges) == "ACYCLIC"))
