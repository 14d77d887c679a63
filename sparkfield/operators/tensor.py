"""Tensors of rank three as tables.

Long form: one row (by..., i, j, k, v) per element, absent rows being zero; ``by`` tells many
tensors in one table apart. Packed form: one struct<shape array<int>, data array<double>> per
row, null data being all zeros. Shapes are known when a plan is made, so a mismatch is an
error then. Operations across tensors use the long form, row-local ones either.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

AXES = ("i", "j", "k")
Shape = tuple[int, int, int]


@dataclass(frozen=True)
class Tensor:
    """A batch of tensors of one shape."""

    df: DataFrame
    shape: Shape
    by: tuple[str, ...] = ()

    def like(self, df: DataFrame, shape: Shape | None = None) -> Tensor:
        return replace(self, df=df.select(*self.by, *AXES, "v"), shape=shape or self.shape)

    @property
    def size(self) -> int:
        return prod(self.shape)


def create(spark: SparkSession, shape: Shape, value: float = 0.0) -> Tensor:
    """A dense tensor of one value."""
    n = prod(shape)
    return Tensor(_unravel(spark.range(n).select(F.col("id").alias("pos"), F.lit(float(value)).alias("v")), shape), tuple(shape))


def create_zero(spark: SparkSession, shape: Shape) -> Tensor:
    """A zero tensor without rows."""
    return Tensor(spark.range(0).select(*(F.lit(0).alias(a) for a in AXES), F.lit(0.0).alias("v")), tuple(shape))


def from_literal(spark: SparkSession, lit) -> Tensor:
    if lit.data is None:
        return create_zero(spark, lit.shape)
    return Tensor(spark.createDataFrame(lit.rows(), "i int, j int, k int, v double"), lit.shape)


def _unravel(df: DataFrame, shape: Shape) -> DataFrame:
    _, m, n = shape
    at = {"i": F.floor(F.col("pos") / (m * n)), "j": F.floor(F.col("pos") / n) % m, "k": F.col("pos") % n}
    return df.withColumns({a: c.cast("int") for a, c in at.items()}).drop("pos")


def position(shape: Shape) -> Column:
    return (F.col("i") * shape[1] + F.col("j")) * shape[2] + F.col("k")


def to_long(df: DataFrame, column: str, shape: Shape, by: Sequence[str]) -> Tensor:
    """Packed to long form; null data gives no rows."""
    rows = df.select(*by, F.posexplode(F.col(f"{column}.data")).alias("pos", "v"))
    return Tensor(_unravel(rows, shape).select(*by, *AXES, "v"), tuple(shape), tuple(by))


def to_packed(t: Tensor, name: str = "t") -> DataFrame:
    """Long to packed form, one row per tensor that has rows; a tensor's elements are one row by nature."""
    cells = F.map_from_entries(F.collect_list(F.struct(position(t.shape).cast("int").alias("p"), "v")))
    data = F.transform(F.sequence(F.lit(0), F.lit(t.size - 1)), lambda p: F.coalesce(F.try_element_at(F.col("_cells"), p), F.lit(0.0)))
    rows = t.df.groupBy(*t.by).agg(cells.alias("_cells"))
    return rows.select(*t.by, F.struct(F.array(*map(F.lit, t.shape)).alias("shape"), data.alias("data")).alias(name))


# --- element access
def get(t: Tensor, index: Sequence[int]) -> DataFrame:
    """The element at an index for each tensor with rows, 0 where absent."""
    here = reduce(lambda a, b: a & b, (F.col(a) == v for a, v in zip(AXES, index, strict=True)))
    return t.df.groupBy(*t.by).agg(F.coalesce(F.max(F.when(here, F.col("v"))), F.lit(0.0)).alias("v"))


def set_value(t: Tensor, index: Sequence[int], value: float) -> Tensor:
    """Replace one element in every tensor; setting 0 where nothing is stored adds no row."""
    here = reduce(lambda a, b: a & b, (F.col(a) == v for a, v in zip(AXES, index, strict=True)))
    rest = t.df.where(~here)
    if value == 0:
        return t.like(rest)
    own = t.df.select(*t.by).distinct() if t.by else t.df.sparkSession.range(1)
    new = own.select(*t.by, *(F.lit(int(v)).alias(a) for a, v in zip(AXES, index, strict=True)), F.lit(float(value)).alias("v"))
    return t.like(rest.unionByName(new))


def is_zero(packed: Column) -> Column:
    """True only where no data is stored; stored zeros do not count."""
    return packed["data"].isNull()


def total_elements(packed: Column) -> Column:
    return F.aggregate(packed["shape"], F.lit(1).cast("long"), lambda a, x: a * x)


# --- element-wise
def negate(t: Tensor) -> Tensor:
    return t.like(t.df.withColumn("v", -F.col("v")))


def scale(t: Tensor, s: float) -> Tensor:
    return t.like(t.df.withColumn("v", F.col("v") * F.lit(float(s))))


def broadcast_shape(a: Shape, b: Shape) -> Shape:
    if any(x != y and 1 not in (x, y) for x, y in zip(a, b, strict=True)):
        raise ValueError(f"shapes {a} and {b} do not broadcast")
    return tuple(max(x, y) for x, y in zip(a, b, strict=True))


def broadcast_to(t: Tensor, shape: Shape) -> Tensor:
    """Repeat single axes up to a shape, whose extents bound the copies."""
    if any(a != b and a != 1 for a, b in zip(t.shape, shape, strict=True)):
        raise ValueError(f"shape {t.shape} does not broadcast to {shape}")
    df = t.df
    for axis, a, b in zip(AXES, t.shape, shape, strict=True):
        if a != b:
            df = df.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    return t.like(df, tuple(shape))


def _by(a: Tensor, b: Tensor) -> list[str]:
    return [c for c in a.by if c in b.by]


def _sum(a: Tensor, b: Tensor, sign: float) -> Tensor:
    shape = broadcast_shape(a.shape, b.shape)
    if a.by != b.by:
        raise ValueError("sums need tensors of the same batch")
    both = broadcast_to(a, shape).df.unionByName(broadcast_to(b, shape).df.withColumn("v", F.col("v") * sign))
    return replace(a, df=both.groupBy(*a.by, *AXES).agg(F.sum("v").alias("v")), shape=shape)


def add(a: Tensor, b: Tensor) -> Tensor:
    return _sum(a, b, 1.0)


def subtract(a: Tensor, b: Tensor) -> Tensor:
    return _sum(a, b, -1.0)


def multiply(a: Tensor, b: Tensor) -> Tensor:
    """Hadamard product with broadcasting: a join on the axes that neither side repeats."""
    shape = broadcast_shape(a.shape, b.shape)
    shared = [x for x, m, n in zip(AXES, a.shape, b.shape, strict=True) if m == n and m > 1]
    keys = [*_by(a, b), *shared]
    right = b.df.select(*b.by, *(F.col(x).alias(x if x in shared else f"_{x}") for x in AXES), F.col("v").alias("_v"))
    both = a.df.join(right, keys) if keys else a.df.crossJoin(right)
    for x, m in zip(AXES, a.shape, strict=True):
        if x not in shared and m == 1:
            both = both.withColumn(x, F.col(f"_{x}"))
    by = tuple(dict.fromkeys((*a.by, *b.by)))
    return Tensor(both.select(*by, *AXES, (F.col("v") * F.col("_v")).alias("v")), shape, by)


# --- contractions
def norm(t: Tensor) -> DataFrame:
    return t.df.groupBy(*t.by).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def dot(a: Tensor, b: Tensor) -> DataFrame:
    """Full inner product of equal shapes."""
    if a.shape != b.shape:
        raise ValueError("an inner product needs equal shapes")
    p = multiply(a, b)
    return p.df.groupBy(*p.by).agg(F.sum("v").alias("v"))


def matmul(a: Tensor, b: Tensor) -> Tensor:
    """Matrix products over the last two axes, batched over the first."""
    if a.shape[2] != b.shape[1] or b.shape[0] not in (1, a.shape[0]):
        raise ValueError(f"shapes {a.shape} and {b.shape} do not multiply")
    keys = _by(a, b)
    right = b.df.select(*b.by, F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("k").alias("_k"), F.col("v").alias("_v"))
    left = a.df.withColumns({"_j": F.col("k"), "_i": F.col("i") if b.shape[0] > 1 else F.lit(0)}).drop("k")
    by = tuple(dict.fromkeys((*a.by, *b.by)))
    both = left.join(right, [*keys, "_i", "_j"]).groupBy(*by, "i", "j", F.col("_k").alias("k")).agg(F.sum(F.col("v") * F.col("_v")).alias("v"))
    return Tensor(both.select(*by, *AXES, "v"), (a.shape[0], a.shape[1], b.shape[2]), by)


def transpose(t: Tensor) -> Tensor:
    swapped = t.df.select(*t.by, "i", F.col("k").alias("j"), F.col("j").alias("k"), "v")
    return t.like(swapped, (t.shape[0], t.shape[2], t.shape[1]))


def letters(indices: str) -> str:
    return "".join(c for c in indices if "a" <= c <= "z")


def validate_einsum(shapes: Sequence[Shape], operands: Sequence[str], out: str) -> dict[str, int]:
    """Extent of each letter. An n-letter operand uses its last n axes; the axes before must be single."""
    extents: dict[str, int] = {}
    for shape, names in zip(shapes, operands, strict=True):
        if len(names) > 3:
            raise ValueError("an operand has at most three indices")
        for c, n in zip(names, shape[3 - len(names) :], strict=True):
            if extents.setdefault(c, n) != n:
                raise ValueError(f"index {c} has extents {extents[c]} and {n}")
    if len(set(out)) != len(out):
        raise ValueError("an output index cannot be repeated")
    if missing := set(out) - set(extents):
        raise ValueError(f"output index {missing} is in no operand")
    return extents


def einsum(spec: str, *operands: Tensor) -> Tensor:
    """``einsum("ij,jk->ik", a, b)``: joins on shared letters, one sum over the letters that go.

    Column swaps and filters (transpose, trace) need neither join nor, without letters to sum
    over, an aggregation.
    """
    inputs, out = spec.split("->")
    names, out = [letters(s) for s in inputs.split(",")], letters(out)
    if len(names) != len(operands):
        raise ValueError("one index list for each operand")
    extents = validate_einsum([t.shape for t in operands], names, out)
    joined, have, by = None, "", ()
    for n, (t, own) in enumerate(zip(operands, names, strict=True)):
        axes = AXES[3 - len(own) :]
        df = t.df
        for a in AXES[: 3 - len(own)]:
            df = df.where(F.col(a) == 0)
        for x in range(len(own)):
            for y in range(x):
                if own[x] == own[y]:
                    df = df.where(F.col(axes[x]) == F.col(axes[y]))
        each = list(dict.fromkeys(own))
        df = df.select(*t.by, *(F.col(axes[own.index(c)]).alias(f"x_{c}") for c in each), F.col("v").alias(f"v{n}"))
        if joined is None:
            joined = df
        else:
            keys = [*(c for c in by if c in t.by), *(f"x_{c}" for c in each if c in have)]
            joined = joined.join(df, keys) if keys else joined.crossJoin(df)
        have += "".join(c for c in each if c not in have)
        by = tuple(dict.fromkeys((*by, *t.by)))
    value = reduce(lambda a, b: a * b, (F.col(f"v{n}") for n in range(len(operands))))
    lead = 3 - len(out)
    axes = {a: F.lit(0) for a in AXES[:lead]} | {a: F.col(f"x_{c}") for a, c in zip(AXES[lead:], out, strict=True)}
    rows = joined.select(*by, *(c.alias(a) for a, c in axes.items()), value.alias("v"))
    if set(have) - set(out):
        rows = rows.groupBy(*by, *AXES).agg(F.sum("v").alias("v"))
    return Tensor(rows, tuple([1] * lead + [extents[c] for c in out]), by)


# --- packed form, within a row
def packed_negate(t: Column) -> Column:
    return F.struct(t["shape"].alias("shape"), F.transform(t["data"], lambda v: -v).alias("data"))


def packed_scale(t: Column, s: float) -> Column:
    return F.struct(t["shape"].alias("shape"), F.transform(t["data"], lambda v: v * F.lit(float(s))).alias("data"))


def packed_add(a: Column, b: Column) -> Column:
    return F.struct(a["shape"].alias("shape"), F.zip_with(a["data"], b["data"], lambda x, y: x + y).alias("data"))


def packed_multiply(a: Column, b: Column) -> Column:
    return F.struct(a["shape"].alias("shape"), F.zip_with(a["data"], b["data"], lambda x, y: x * y).alias("data"))


def packed_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a["data"], b["data"], lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def packed_norm(t: Column) -> Column:
    return F.sqrt(F.aggregate(t["data"], F.lit(0.0), lambda s, x: s + x * x))


def packed_get(t: Column, position_: int) -> Column:
    return F.coalesce(F.get(t["data"], F.lit(position_)), F.lit(0.0))


def packed_set(t: Column, position_: int, value: float) -> Column:
    return F.struct(t["shape"].alias("shape"), F.transform(t["data"], lambda v, p: F.when(p == position_, F.lit(float(value))).otherwise(v)).alias("data"))
