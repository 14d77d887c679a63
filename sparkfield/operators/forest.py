"""Expressions as data: any number of trees in a node table and a child table.

``nodes(expr, node, op, label)`` has a row per node, ``children(expr, parent, pos, child)`` a
row per edge. Canonical hashes are formed from the leaves up: a node's hash covers its
operation, its label and its children's hashes, in order, or sorted where the operation
commutes. Equal expressions but for the order of such operands get equal hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Collection, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from sparkfield.plans.durable import saved

#: Operations whose operands may change places.
COMMUTATIVE = ("+", "*")
#: Fields of a term.
TERM = ("node", "own", "op", "label", "parent", "pos")
#: Expressions of at most so many nodes and edges are hashed within a task.
SMALL = 256
#: About so many terms are hashed at once; so many different subtrees are remembered for the next.
BATCH, SHAPES = 100_000, 200_000


def digest(op: Column, label: Column, inner: Column) -> Column:
    """sha256 of a node from its own fields and its children's hashes, comma-joined."""
    return F.sha2(F.concat(op, F.lit("|"), F.coalesce(label, F.lit("")), F.lit("|"), inner).cast("binary"), 256)


def terms(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """Both tables as one, ``terms(expr, terms)``: a row has some terms (node, own, op, label, parent, pos) of an expression.

    A term is a node (``own``), the edge to it from ``parent``, or both.
    """
    node = nodes.select("node").union(children.select("child")).union(children.select("parent")).schema["node"].dataType
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    own = F.struct(F.col("node").cast(node).alias("node"), F.lit(True).alias("own"), "op", "label", F.lit(None).cast(node).alias("parent"), none(children, "pos"))
    edge = F.struct(F.col("child").cast(node).alias("node"), F.lit(False).alias("own"), none(nodes, "op"), none(nodes, "label"), F.col("parent").cast(node).alias("parent"), "pos")
    return nodes.select("expr", F.array(own).alias("terms")).unionByName(children.select("expr", F.array(edge).alias("terms")))


def hashes(nodes: DataFrame, children: DataFrame, commutative: Collection[str] = COMMUTATIVE, roots_only: bool = False, small: int = SMALL) -> DataFrame:
    """(expr, node, hash, size): the canonical hash and the number of nodes of every subtree, or of the roots.

    Expressions of at most ``small`` nodes and edges are brought together by one shuffle and
    hashed many at once; larger ones go through joins level by level, so none is ever in one
    task whole. Nodes above a cycle or a missing child have no row.
    """
    both = terms(nodes, children)
    large = saved(both.groupBy("expr").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > small).select("expr"))
    some = not large.isEmpty()
    if some:
        both = both.join(large, "expr", "left_anti")
    out = _in_tasks(both, commutative, roots_only, small).select("expr", F.col("node").cast(nodes.schema["node"].dataType).alias("node"), "hash", "size")
    if not some:
        return out
    return out.unionByName(_deep(nodes.join(large, "expr", "left_semi"), children.join(large, "expr", "left_semi"), commutative, roots_only))


def hashes_of_terms(rows: DataFrame, commutative: Collection[str] = COMMUTATIVE, roots_only: bool = False, small: int = SMALL) -> DataFrame:
    """``hashes`` of ``terms``, in one pass: for terms that an earlier step has dealt and sorted by ``expr``, as neither is done again.

    All terms of an expression meet in a task, but only as a stream: of one with more than
    ``small`` nodes and edges no more is kept, and it goes through joins level by level.
    """
    out = saved(_in_tasks(rows, commutative, roots_only, small))
    large = out.where("node is null").select("expr")
    if large.isEmpty():
        return out
    rows = rows.join(saved(large), "expr", "left_semi").select("expr", F.inline("terms"))
    deep = _deep(rows.where("own").select("expr", "node", "op", "label"), rows.where("parent is not null").select("expr", "parent", "pos", F.col("node").alias("child")), commutative, roots_only)
    return out.where("node is not null").unionByName(deep)


def _deep(nodes: DataFrame, children: DataFrame, commutative: Collection[str], roots_only: bool) -> DataFrame:
    deep = _by_levels(nodes, children, commutative)
    return deep.join(roots(nodes, children), ["expr", "node"]) if roots_only else deep


def _in_tasks(rows: DataFrame, commutative: Collection[str], roots_only: bool, small: int) -> DataFrame:
    """``hashes`` of ``terms``; an expression of more than ``small`` nodes and edges has one row, without a node."""
    expr, node = rows.schema["expr"].dataType, rows.schema["terms"].dataType.elementType["node"].dataType
    met = rows.select("expr", "terms").repartition("expr").sortWithinPartitions("expr")
    return met.mapInArrow(partial(_hashed, commutative=frozenset(commutative), roots_only=roots_only, small=small), f"expr {expr.simpleString()}, node {node.simpleString()}, hash string, size long")


def _flat(b: pa.RecordBatch) -> list[pa.Array]:
    """The expression and the fields of each term that is a node or an edge."""
    told = b.column(1).flatten()
    fields = dict(zip((f.name for f in told.type), told.flatten(), strict=True))
    columns = [b.column(0).take(pc.list_parent_indices(b.column(1))), *(fields[c] for c in TERM)]
    some = pc.or_kleene(pc.and_kleene(fields["own"], fields["node"].is_valid()), fields["parent"].is_valid())
    return [c.filter(some) for c in columns]


def _numbers(column: pa.Array) -> np.ndarray:
    """Equal values as equal numbers from 0, nulls as -1."""
    if pa.types.is_nested(column.type):
        column = pa.array([None if x is None else repr(x) for x in column.to_pylist()], pa.string())
    return column.dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64)


def _hashed(batches: Iterator[pa.RecordBatch], commutative: frozenset[str], roots_only: bool, small: int) -> Iterator[pa.RecordBatch]:
    """Hashes of expressions whose terms come one expression after the other, those of about ``BATCH`` terms at once."""
    shapes, held = _Shapes(commutative), []
    for b in chain(batches, [None]):
        if b is not None and b.num_rows:
            held.append(_flat(b))
        n = sum(len(x[0]) for x in held)
        if not n or b is not None and n < BATCH:
            continue
        columns, held = [pa.concat_arrays(c) for c in zip(*held, strict=True)], []
        expr = _numbers(columns[0])
        starts = np.flatnonzero(np.append(True, expr[1:] != expr[:-1]))
        if b is not None:  # the last expression may go on; so many terms of it tell that it is large
            last = starts[-1]
            held = [[c[last:] if expr[last] < 0 else c[last : last + small + 1] for c in columns]]
            columns, expr, starts = [c[:last] for c in columns], expr[:last], starts[:-1]
        if len(starts):
            yield _of_whole(columns, expr, starts, shapes, roots_only, small)
        if len(shapes.hash) > SHAPES:
            shapes = _Shapes(commutative)


def _of_whole(columns: list[pa.Array], expr: np.ndarray, starts: np.ndarray, shapes: _Shapes, roots_only: bool, small: int) -> pa.RecordBatch:
    """Rows of ``hashes`` for whole expressions, from the leaves up, all nodes of a level at once."""
    _, node, own, op, label, parent, pos = columns
    n = len(expr)
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    ids = _numbers(pa.concat_arrays([node, parent]))
    own, edge = own.to_numpy(zero_copy_only=False).astype(bool) & (ids[:n] >= 0), ids[n:] >= 0
    large = (np.add.reduceat(own.astype(np.int64) + edge, starts) > small) & (expr[starts] >= 0)
    own, edge = np.flatnonzero(own & ~large[run]), np.flatnonzero(edge & ~large[run])
    key = np.where(ids >= 0, np.tile(run, 2) * (ids.max(initial=0) + 1) + ids, -1)
    nodes, at = np.unique(key[own], return_inverse=True)
    row = np.zeros(len(nodes), np.int64)
    row[at] = own
    heads = shapes.heads_of(op, label)[row]

    def place(keys):
        """Where nodes are; -1 where there is none."""
        p = np.searchsorted(nodes, keys)
        return np.where(np.append(nodes, -2)[p] == keys, p, -1)

    above, below = place(key[n:][edge]), place(key[edge])
    top = np.ones(len(nodes), bool)
    top[below[below >= 0]] = False
    # nulls first, as they are the least; equal positions have equal numbers
    value = pc.rank(pos.take(pa.array(edge)), sort_keys="ascending", null_placement="at_start", tiebreaker="min").to_numpy().astype(np.int64)
    below, value, above = below[above >= 0], value[above >= 0], above[above >= 0]
    by_parent = np.argsort(above, kind="stable")
    below, value, above = below[by_parent], value[by_parent], above[by_parent]
    arity = np.bincount(above, minlength=len(nodes))
    first = np.cumsum(arity) - arity
    by_child = np.argsort(below, kind="stable")
    asked = np.searchsorted(below[by_child], np.arange(len(nodes) + 1))
    shape, waits = np.full(len(nodes), -1, np.int64), arity.copy()
    new = np.flatnonzero(arity == 0)
    while len(new):
        who, at_edge = _spread(first[new], arity[new])
        shape[new] = shapes.numbered(heads[new], who, value[at_edge], shape[below[at_edge]])
        told = above[by_child[_spread(asked[new], asked[new + 1] - asked[new])[1]]]
        told, answers = np.unique(told, return_counts=True)
        waits[told] -= answers
        new = told[waits[told] == 0]
    shape = shape[at]
    keep = shape >= 0  # not on a cycle, nor above one or above a missing child
    if roots_only:
        keep &= top[at]
    big = starts[large]
    found, which = np.unique(shape[keep], return_inverse=True)
    hash_ = pa.array([shapes.hash[x] for x in found.tolist()], pa.string()).take(pa.array(which))
    size = pa.array(np.array([shapes.size[x] for x in found.tolist()], np.int64)[which])
    out = [pa.concat_arrays([c.take(pa.array(own[keep])), d]) for c, d in ((columns[0], columns[0].take(pa.array(big))), (node, pa.nulls(len(big), node.type)))]
    return pa.RecordBatch.from_arrays([*out, *(pa.concat_arrays([c, pa.nulls(len(big), c.type)]) for c in (hash_, size))], ["expr", "node", "hash", "size"])


def _spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places ``first`` to ``first + n`` of each, and whose they are."""
    who = np.repeat(np.arange(len(n)), n)
    return who, np.arange(len(who)) + np.repeat(first - (np.cumsum(n) - n), n)


class _Shapes:
    """Subtrees as numbers: one number, one hash and one size for an operation, a label and the children's numbers."""

    def __init__(self, commutative: frozenset[str]) -> None:
        self.commutative, self.heads, self.texts, self.commutes = commutative, {}, [], []
        self.known, self.hash, self.size = {}, [], []

    def heads_of(self, op: pa.Array, label: pa.Array) -> np.ndarray:
        """A number for each operation with its label."""
        o, x = _numbers(op) + 1, _numbers(label) + 1
        _, at, which = np.unique(o * (x.max(initial=0) + 1) + x, return_index=True, return_inverse=True)
        numbers = []
        for pair in zip(op.take(pa.array(at)).to_pylist(), label.take(pa.array(at)).to_pylist(), strict=True):
            if pair not in self.heads:
                self.heads[pair] = len(self.texts)
                self.texts.append(f"{pair[0]}|{pair[1] or ''}|")
                self.commutes.append(pair[0] in self.commutative)
            numbers.append(self.heads[pair])
        return np.array(numbers, np.int64)[which]

    def numbered(self, heads: np.ndarray, who: np.ndarray, value: np.ndarray, child: np.ndarray) -> list[int]:
        """Numbers of nodes, given the position ``value`` and the number of each child, and ``who`` has it."""
        free = np.array(self.commutes, bool)[heads][who]
        value = np.where(free, 0, value)
        order = np.lexsort((child, value, who))
        who, value, child = who[order], value[order], child[order]
        # children in one place are told from children in order: their hashes are to be sorted
        tied = np.append(False, (who[1:] == who[:-1]) & (value[1:] == value[:-1]))[: len(who)]
        ends = np.cumsum(np.bincount(who, minlength=len(heads)) + 1)
        starts = np.append(0, ends)[:-1]
        words = np.empty(ends[-1], np.int64)
        words[starts] = heads
        words[np.arange(len(who)) + who + 1] = child * 2 + tied
        data, known, out = words.tobytes(), self.known, []
        for a, b in zip((starts * 8).tolist(), (ends * 8).tolist(), strict=True):
            key = data[a:b]
            number = known.get(key)
            out.append(self._add(key) if number is None else number)
        return out

    def _add(self, key: bytes) -> int:
        head, *children = np.frombuffer(key, np.int64).tolist()
        place, inner = 0, []
        for c in children:
            place += not c % 2
            inner.append((place, self.hash[c // 2]))
        below = ",".join(h for _, h in sorted(inner))
        self.hash.append(hashlib.sha256(f"{self.texts[head]}{below}".encode()).hexdigest())
        self.size.append(1 + sum(self.size[c // 2] for c in children))
        self.known[key] = len(self.hash) - 1
        return len(self.hash) - 1


def _by_levels(nodes: DataFrame, children: DataFrame, commutative: Collection[str]) -> DataFrame:
    """``hashes`` in a round for each level of the deepest tree, all trees at once.

    A round joins the new hashes with their parents' edges; a node is hashed once all its
    children have answered.
    """
    children = saved(children)
    arity = children.groupBy("expr", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("arity"))
    own = saved(nodes.join(arity, ["expr", "node"], "left").select("expr", "node", "op", "label", F.coalesce("arity", F.lit(0)).alias("arity")))
    new = saved(own.where("arity = 0").select("expr", "node", digest(F.col("op"), F.col("label"), F.lit("")).alias("hash"), F.lit(1).cast("long").alias("size")))
    done, answers = [new], None
    while not new.isEmpty():
        told = children.join(new.withColumnRenamed("node", "child"), ["expr", "child"]).select("expr", F.col("parent").alias("node"), "pos", "hash", "size")
        answers = saved(told if answers is None else answers.unionByName(told), answers)
        # at most a node's own children
        met = answers.groupBy("expr", "node").agg(F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("inner"), F.sum("size").alias("size"))
        whole = met.join(own, ["expr", "node"]).where(F.size("inner") == F.col("arity"))
        ordered = F.when(F.col("op").isin(*commutative), F.array_sort("inner.hash")).otherwise(F.col("inner.hash"))
        new = saved(whole.select("expr", "node", digest(F.col("op"), F.col("label"), F.array_join(ordered, ",")).alias("hash"), (F.col("size") + 1).alias("size")))
        answers = saved(answers.join(new.select("expr", "node"), ["expr", "node"], "left_anti"), answers)
        done.append(new)
    out = done[0]
    for level in done[1:]:
        out = out.unionByName(level)
    return out


def roots(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """(expr, node) of the nodes that are nobody's child."""
    return nodes.select("expr", "node").join(children.select("expr", F.col("child").alias("node")), ["expr", "node"], "left_anti")


def registered(hashed: DataFrame) -> DataFrame:
    """``hashed(expr, hash, ...)`` with ``first``, the least expression of the same hash, and ``is_new`` for that one.

    Sums per hash come first, so that a hash of very many expressions costs a row for each task.
    """
    firsts = hashed.groupBy("hash").agg(F.min("expr").alias("first"))
    return hashed.join(firsts, "hash").withColumn("is_new", F.col("expr") == F.col("first"))


def matching(probes: DataFrame, hashed: DataFrame) -> DataFrame:
    """``probes(hash, ...)`` with the number ``n`` of expressions of their hash, 0 if none is known."""
    counts = hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    return probes.join(counts, "hash", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def variable_counts(nodes: DataFrame) -> DataFrame:
    """(expr, name, n): how often each variable occurs in each expression."""
    return nodes.where("op = 'var'").groupBy("expr", F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n"))
