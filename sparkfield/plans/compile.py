"""Expressions into plans: scalars into columns, tensors into joins, grid fields into windows."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkfield.functions.expr import Binary, Einsum, Expr, Literal, Op, Unary, Variable
from sparkfield.operators import stencil, tensor
from sparkfield.operators.grid import Grid, axis_from_name


def column(e: Expr, env: Mapping[str, Column | float] | None = None) -> Column:
    """A scalar expression as a column; variables not in ``env`` are columns of their own name.

    Derivative and Laplacian nodes have no value without a grid.
    """
    match e:
        case Literal():
            if not e.is_scalar:
                raise ValueError("a tensor literal in a scalar expression")
            return F.lit(float(e.value))
        case Variable(name):
            v = (env or {}).get(name)
            return F.col(name) if v is None else v if isinstance(v, Column) else F.lit(float(v))
        case Unary(Op.NEGATE, u):
            return -column(u, env)
        case Unary(Op.TRANSPOSE, u):
            return column(u, env)
        case Binary(Op.ADD, u, v):
            return column(u, env) + column(v, env)
        case Binary(Op.MULTIPLY | Op.MATMUL | Op.DOT, u, v):
            return column(u, env) * column(v, env)
    raise ValueError(f"{e} is not a scalar expression")


def array(e: Expr, env: Mapping[str, np.ndarray]) -> np.ndarray:
    """A scalar expression over numpy arrays, for batched solvers."""
    match e:
        case Literal():
            return np.float64(e.value)
        case Variable(name):
            return env[name]
        case Unary(Op.NEGATE, u):
            return -array(u, env)
        case Unary(Op.TRANSPOSE, u):
            return array(u, env)
        case Binary(Op.ADD, u, v):
            return array(u, env) + array(v, env)
        case Binary(Op.MULTIPLY | Op.MATMUL | Op.DOT, u, v):
            return array(u, env) * array(v, env)
    raise ValueError(f"{e} is not a scalar expression")


def tensors(e: Expr, env: Mapping[str, tensor.Tensor], spark: SparkSession) -> tensor.Tensor:
    """A tensor expression as one plan over the environment's tensors; shapes are checked on the way."""
    go = lambda x: tensors(x, env, spark)
    match e:
        case Literal():
            return tensor.from_literal(spark, e)
        case Variable(name):
            if name not in env:
                raise ValueError(f"unknown variable {name}")
            return env[name]
        case Unary(Op.NEGATE, u):
            return tensor.negate(go(u))
        case Unary(Op.TRANSPOSE, u):
            return tensor.transpose(go(u))
        case Binary(Op.ADD, u, v):
            return tensor.add(go(u), go(v))
        case Binary(Op.MULTIPLY, u, v):
            for c, x in ((u, v), (v, u)):  # a scalar factor needs no join
                if isinstance(c, Literal) and c.is_scalar:
                    return tensor.scale(go(x), c.value)
            return tensor.multiply(go(u), go(v))
        case Binary(Op.MATMUL, u, v):
            return tensor.matmul(go(u), go(v))
        case Binary(Op.DOT, u, v):
            a, b = go(u), go(v)
            by = tuple(c for c in dict.fromkeys((*a.by, *b.by)))
            d = tensor.dot(a, b)
            return tensor.Tensor(d.select(*by, *(F.lit(0).alias(x) for x in tensor.AXES), "v"), (1, 1, 1), by)
        case Einsum(u, li, None, _, out):
            return tensor.einsum(f"{li}->{out}", go(u))
        case Einsum(u, li, v, ri, out):
            return tensor.einsum(f"{li},{ri}->{out}", go(u), go(v))
    raise ValueError(f"{e} has no value without a grid")


def on_grid(df: DataFrame, e: Expr, grid: Grid, name: str, env: Mapping[str, float] | None = None) -> DataFrame:
    """``df`` (index columns and a column per field) with the expression's field as ``name``.

    Derivatives by an axis name are first differences, nested ones differences of differences;
    a Laplacian is the compact sum of second differences. Their operands must be fields.
    """
    known = {k: F.lit(float(v)) for k, v in (env or {}).items()}
    steps = 0

    def field_like(x: Expr) -> bool:
        return (isinstance(x, Variable) and x.name not in known) or any(map(field_like, x.children))

    def go(x: Expr) -> Column:
        nonlocal df, steps
        if isinstance(x, Unary) and x.op in (Op.DERIVATIVE, Op.LAPLACIAN):
            if not field_like(x.operand):
                raise ValueError(f"{x.operand} is not a field")
            operand = go(x.operand)
            if isinstance(x.operand, Variable):
                held = x.operand.name
            else:  # windows do not nest: the operand becomes a column first
                steps += 1
                held = f"_e{steps}"
                df = df.withColumn(held, operand)
            if x.op is Op.LAPLACIAN:
                value = stencil.laplacian(grid, held)
            else:
                axis = axis_from_name(x.wrt)
                if axis is None or axis >= len(grid.dims):
                    raise ValueError(f"the grid has no axis {x.wrt}")
                value = stencil.derivative(grid, axis, 1, held)
            steps += 1
            df = df.withColumn(f"_e{steps}", value)
            return F.col(f"_e{steps}")
        if isinstance(x, Unary):
            return -go(x.operand) if x.op is Op.NEGATE else go(x.operand)
        if isinstance(x, Binary):
            a, b = go(x.left), go(x.right)
            return a + b if x.op is Op.ADD else a * b
        return column(x, known)

    value = go(e)
    return df.withColumn(name, value).drop(*(f"_e{k}" for k in range(1, steps + 1)))
