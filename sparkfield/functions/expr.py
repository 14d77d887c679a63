"""Symbolic tensor expressions.

Trees of frozen nodes that live only at plan time: values are in DataFrames. Python
operators build them (``+ - * @``), ``str`` prints them, and ``substitute`` evaluates them
partially. ``sparkfield.plans.compile`` turns them into columns or DataFrame plans.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from enum import Enum
from math import prod


class Op(Enum):
    ADD = "+"
    NEGATE = "-"
    MULTIPLY = "*"
    MATMUL = "@"
    DOT = "dot"
    TRANSPOSE = "T"
    DERIVATIVE = "d/d"
    LAPLACIAN = "∇²"
    EINSUM = "einsum"

    @property
    def is_unary(self) -> bool:
        return self in (Op.NEGATE, Op.TRANSPOSE, Op.DERIVATIVE, Op.LAPLACIAN)

    @property
    def is_binary(self) -> bool:
        return self in (Op.ADD, Op.MULTIPLY, Op.MATMUL, Op.DOT)


class Expr:
    """Base of all nodes."""

    __slots__ = ()

    def __add__(self, other):
        return Binary(Op.ADD, self, lift(other))

    def __radd__(self, other):
        return Binary(Op.ADD, lift(other), self)

    def __neg__(self):
        return Unary(Op.NEGATE, self)

    def __sub__(self, other):
        return self + (-lift(other))

    def __rsub__(self, other):
        return lift(other) + (-self)

    def __mul__(self, other):
        return Binary(Op.MULTIPLY, self, lift(other))

    def __rmul__(self, other):
        return Binary(Op.MULTIPLY, lift(other), self)

    def __matmul__(self, other):
        return Binary(Op.MATMUL, self, lift(other))

    @property
    def T(self):
        return Unary(Op.TRANSPOSE, self)

    def dot(self, other):
        return Binary(Op.DOT, self, lift(other))

    @property
    def children(self) -> tuple[Expr, ...]:
        return ()


@dataclass(frozen=True)
class Literal(Expr):
    """A dense tensor of rank three; ``data`` None means all zeros, never stored."""

    data: tuple[float, ...] | None
    shape: tuple[int, int, int] = (1, 1, 1)

    def __post_init__(self):
        if self.data is not None and len(self.data) != prod(self.shape):
            raise ValueError(f"{len(self.data)} values for shape {self.shape}")

    @property
    def is_scalar(self) -> bool:
        return self.shape == (1, 1, 1)

    @property
    def value(self) -> float:
        return self.data[0] if self.data is not None else 0.0

    def rows(self) -> list[tuple[int, int, int, float]]:
        _, m, n = self.shape
        data = self.data if self.data is not None else [0.0] * prod(self.shape)
        return [(p // (m * n), p // n % m, p % n, v) for p, v in enumerate(data)]

    def __str__(self):
        return format_literal(self)


@dataclass(frozen=True)
class Variable(Expr):
    name: str

    def __str__(self):
        return self.name


@dataclass(frozen=True)
class Unary(Expr):
    op: Op
    operand: Expr
    wrt: str | None = None

    @property
    def children(self):
        return (self.operand,)

    def __str__(self):
        if self.op is Op.DERIVATIVE:
            return f"d({self.operand})/d{self.wrt}"
        return f"{self.op.value}({self.operand})"


@dataclass(frozen=True)
class Binary(Expr):
    op: Op
    left: Expr
    right: Expr

    @property
    def children(self):
        return (self.left, self.right)

    def __str__(self):
        return f"({self.left} {self.op.value} {self.right})"


@dataclass(frozen=True)
class Einsum(Expr):
    left: Expr
    left_indices: str
    right: Expr | None
    right_indices: str
    out_indices: str

    @property
    def op(self):
        return Op.EINSUM

    @property
    def children(self):
        return (self.left,) if self.right is None else (self.left, self.right)

    def __str__(self):
        inner = ", ".join(map(str, self.children))
        return f"einsum[{self.left_indices},{self.right_indices}->{self.out_indices}]({inner})"


def lift(x) -> Expr:
    return x if isinstance(x, Expr) else scalar(x)


def scalar(v: float) -> Literal:
    return Literal((float(v),))


def zeros(shape: tuple[int, int, int]) -> Literal:
    """A zero tensor that holds no values."""
    return Literal(None, shape)


def vector(values) -> Literal:
    return Literal(tuple(map(float, values)), (1, 1, len(values)))


def matrix(rows) -> Literal:
    return Literal(tuple(float(v) for r in rows for v in r), (1, len(rows), len(rows[0])))


def var(name: str) -> Variable:
    return Variable(name)


def derivative_of(e: Expr, name: str) -> Unary:
    """The unevaluated derivative node; see ``calculus.derivative`` for the symbolic result."""
    return Unary(Op.DERIVATIVE, e, name)


def laplacian_of(e: Expr) -> Unary:
    return Unary(Op.LAPLACIAN, e)


def einsum(left: Expr, left_indices: str, out: str, right: Expr | None = None, right_indices: str = "") -> Einsum:
    """``einsum(a, "ij", "ik", b, "jk")``; without right indices the right operand is not used."""
    return Einsum(left, left_indices, right if right_indices else None, right_indices, out)


def walk(e: Expr) -> Iterator[Expr]:
    """Depth first, left to right."""
    yield e
    for c in e.children:
        yield from walk(c)


def variables(e: Expr) -> list[str]:
    """Distinct variable names in the order of their first occurrence."""
    return list(dict.fromkeys(x.name for x in walk(e) if isinstance(x, Variable)))


def contains(e: Expr, name: str) -> bool:
    return any(isinstance(x, Variable) and x.name == name for x in walk(e))


def count(e: Expr, name: str) -> int:
    return sum(isinstance(x, Variable) and x.name == name for x in walk(e))


def rebuild(e: Expr, f) -> Expr:
    """The node with ``f`` applied to its children."""
    if isinstance(e, Unary):
        return Unary(e.op, f(e.operand), e.wrt)
    if isinstance(e, Binary):
        return Binary(e.op, f(e.left), f(e.right))
    if isinstance(e, Einsum):
        return Einsum(f(e.left), e.left_indices, None if e.right is None else f(e.right), e.right_indices, e.out_indices)
    return e


def substitute(e: Expr, known: Mapping[str, Expr | float]) -> Expr:
    """Partial evaluation: known variables replaced, the others left."""
    if isinstance(e, Variable):
        return lift(known[e.name]) if e.name in known else e
    return rebuild(e, lambda c: substitute(c, known))


def format_literal(lit: Literal | None) -> str:
    """A scalar as ``%g``; a matrix with ``%8.4g`` cells; deeper tensors slice by slice."""
    if lit is None:
        return "(null)"
    if lit.is_scalar:
        return f"{lit.value:g}"
    a, m, n = lit.shape
    cells = {(i, j, k): v for i, j, k, v in lit.rows()}
    out = ""
    for i in range(a):
        rows = ["[" + ", ".join(f"{cells[i, j, k]:8.4g}" for k in range(n)) + "]" for j in range(m)]
        out += f"\n-- Slice {i}/{a} along axis 0 --\n[" + "\n ".join(rows) + "]"
    return out
