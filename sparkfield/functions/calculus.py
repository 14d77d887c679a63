"""Symbolic differentiation and simplification, before any column is made.

Simplifying here matters because the engine's optimiser must keep ``x * 1.0``, ``x + 0.0``
and ``0.0 * x`` on doubles (NaN, infinity); expressions are assumed finite.
"""

from __future__ import annotations

from .expr import Binary, Einsum, Expr, Literal, Op, Unary, Variable, rebuild, scalar, substitute, variables


def derivative(e: Expr, name: str, strict_parity: bool = False) -> Expr:
    """The partial derivative, not simplified."""
    d = lambda x: derivative(x, name, strict_parity)
    match e:
        case Literal():
            return scalar(0)
        case Variable():
            return scalar(1 if e.name == name else 0)
        case Unary(Op.NEGATE | Op.TRANSPOSE as op, u):
            return Unary(op, d(u))
        case Unary(Op.DERIVATIVE, u, inner):
            return Unary(Op.DERIVATIVE, derivative(u, inner, strict_parity), name)
        case Unary(Op.LAPLACIAN):
            if strict_parity:
                return scalar(0)
            raise ValueError("the derivative of a Laplacian node is not defined symbolically")
        case Binary(Op.ADD, u, v):
            return d(u) + d(v)
        case Binary(Op.MULTIPLY, u, v):
            return u * d(v) + d(u) * v
        case Binary(Op.MATMUL, u, v):
            return (d(u) @ v) + (u @ d(v))
        case Binary(Op.DOT, u, v):
            return u.dot(d(v)) + d(u).dot(v)
        case Einsum(u, li, None, ri, out):
            return Einsum(d(u), li, None, ri, out)
        case Einsum(u, li, v, ri, out):
            return Einsum(d(u), li, v, ri, out) + Einsum(u, li, d(v), ri, out)
    raise ValueError(f"cannot differentiate {e}")


partial_derivative = derivative


def gradient(e: Expr) -> dict[str, Expr]:
    """One partial for each variable, in the order of first occurrence."""
    return {v: derivative(e, v) for v in variables(e)}


def laplacian(e: Expr) -> Expr:
    """Sum of second partials over all variables, parameters included."""
    names = variables(e)
    if not names:
        raise ValueError("an expression without variables has no Laplacian")
    out = None
    for v in names:
        second = derivative(derivative(e, v), v)
        out = second if out is None else out + second
    return out


def mixed_partial(e: Expr, a: str, b: str) -> Expr:
    return derivative(derivative(e, a), b)


def nth_derivative(e: Expr, name: str, n: int) -> Expr:
    if n < 0:
        raise ValueError("the order of a derivative cannot be negative")
    for _ in range(n):
        e = derivative(e, name)
    return e


def finite_difference(e: Expr, name: str, h: float, kind: str = "central") -> Expr:
    """First difference of step ``h``: forward, backward or central."""
    at = lambda s: substitute(e, {name: Variable(name) + s})
    if kind == "forward":
        return (at(h) - e) * (1 / h)
    if kind == "backward":
        return (e - at(-h)) * (1 / h)
    if kind == "central":
        return (at(h) - at(-h)) * (1 / (2 * h))
    raise ValueError(f"unknown difference {kind!r}")


def finite_difference_2nd(e: Expr, name: str, h: float) -> Expr:
    at = lambda s: substitute(e, {name: Variable(name) + s})
    return ((at(h) - 2 * e) + at(-h)) * (1 / (h * h))


def _constant(e: Expr) -> float | None:
    return e.value if isinstance(e, Literal) and e.is_scalar else None


def is_zero(e: Expr) -> bool:
    return _constant(e) == 0.0


def is_one(e: Expr) -> bool:
    return _constant(e) == 1.0


def coefficient(e: Expr) -> tuple[float, Expr]:
    """(c, x) of a term c * x or x * c; (1, e) of any other."""
    if isinstance(e, Binary) and e.op is Op.MULTIPLY:
        for c, x in ((e.left, e.right), (e.right, e.left)):
            if _constant(c) is not None:
                return _constant(c), x
    return 1.0, e


def simplify(e: Expr) -> Expr:
    """One pass from the leaves up: constants folded, 0 and 1 dropped, like terms joined."""
    e = rebuild(e, simplify)
    if isinstance(e, Unary) and e.op is Op.NEGATE and is_zero(e.operand):
        return scalar(0)
    if isinstance(e, Binary) and e.op in _RULES:
        return _RULES[e.op](e)
    if isinstance(e, Einsum) and any(is_zero(c) for c in e.children):
        return scalar(0)
    return e


def _sum(e: Binary) -> Expr:
    if is_zero(e.left):
        return e.right
    if is_zero(e.right):
        return e.left
    a, b = _constant(e.left), _constant(e.right)
    if a is not None and b is not None:
        return scalar(a + b)
    (a, x), (b, y) = coefficient(e.left), coefficient(e.right)
    if x != y:
        return e
    c = a + b
    return scalar(0) if c == 0 else x if c == 1 else c * x


def _product(e: Binary) -> Expr:
    if is_zero(e.left) or is_zero(e.right):
        return scalar(0)
    if is_one(e.left):
        return e.right
    if is_one(e.right):
        return e.left
    a, b = _constant(e.left), _constant(e.right)
    return e if a is None or b is None else scalar(a * b)


def _contraction(e: Binary) -> Expr:
    return scalar(0) if is_zero(e.left) or is_zero(e.right) else e


_RULES = {Op.ADD: _sum, Op.MULTIPLY: _product, Op.MATMUL: _contraction, Op.DOT: _contraction}
simplify_zero_terms = simplify_identity_terms = simplify_constants = simplify
