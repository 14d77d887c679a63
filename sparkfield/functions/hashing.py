"""Canonical hashes of expressions and a registry of those already seen."""

from __future__ import annotations

import struct
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from .expr import Binary, Einsum, Expr, Literal, Op, Unary, Variable

# The 64-bit FNV-1a offset and prime, and the ordinals of node kinds and operations.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
KINDS = {Literal: 0, Variable: 1, Unary: 2, Binary: 3, Einsum: 3}
ORDINAL = {op: i for i, op in enumerate(Op)}


def fnv1a(data: bytes, h: int = FNV_OFFSET) -> int:
    for byte in data:
        h = (h ^ byte) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


@lru_cache(maxsize=65536)
def canonical_hash(e: Expr | None) -> int:
    """Equal for expressions that differ only in the order of sums' and element-wise products' operands."""
    if e is None:
        return FNV_OFFSET
    word = lambda n: struct.pack("<I", n)
    h = fnv1a(word(KINDS[type(e)]))
    if isinstance(e, Literal):
        h = fnv1a(struct.pack("<3I", *e.shape), h)
        return h if e.data is None else fnv1a(struct.pack(f"<{len(e.data)}d", *e.data), h)
    if isinstance(e, Variable):
        return fnv1a(e.name.encode(), h)
    h = fnv1a(word(ORDINAL[e.op]), h)
    if isinstance(e, Unary):
        h = h ^ canonical_hash(e.operand)
        return fnv1a(e.wrt.encode(), h) if e.op is Op.DERIVATIVE else h
    if isinstance(e, Einsum):
        for s in (e.left_indices, e.right_indices, e.out_indices):
            h = fnv1a(s.encode(), h)
        # the two sides are told apart, though xor alone would not
        return fnv1a(struct.pack("<2Q", canonical_hash(e.left), canonical_hash(e.right)), h)
    sides = [canonical_hash(e.left), canonical_hash(e.right)]
    if e.op in (Op.ADD, Op.MULTIPLY):
        sides.sort()
    return fnv1a(struct.pack("<2Q", *sides), h)


class Registry:
    """Expressions by canonical hash; duplicates are kept."""

    def __init__(self):
        self._seen: dict[int, list[Expr]] = {}

    def register(self, e: Expr) -> bool:
        """True if no expression of this hash was there."""
        mine = self._seen.setdefault(canonical_hash(e), [])
        mine.insert(0, e)
        return len(mine) == 1

    def contains(self, e: Expr) -> bool:
        return canonical_hash(e) in self._seen

    def matching(self, e: Expr) -> list[Expr]:
        return self.by_hash(canonical_hash(e))

    def by_hash(self, h: int) -> list[Expr]:
        """Newest first."""
        return list(self._seen.get(h, ()))


def register(corpus: DataFrame, key: str = "expr_hash", order: str = "expr_id") -> DataFrame:
    """A corpus of expressions as rows: ``is_new`` marks the first of each hash."""
    first = W.partitionBy(key).orderBy(order)
    return corpus.withColumn("is_new", F.row_number().over(first) == 1)
