"""Expressions, calculus, simplification and hashing."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sparkfield.functions import calculus as c
from sparkfield.functions.expr import Literal, Op, count, contains, derivative_of, einsum, laplacian_of, matrix, scalar, substitute, var, variables, zeros
from sparkfield.functions.hashing import Registry, canonical_hash
from sparkfield.plans.compile import array, column

x, y = var("x"), var("y")


def value(e, **env):
    return float(array(e, env))


@pytest.mark.parametrize(
    ("e", "env", "want"),
    [
        (c.derivative(x * x, "x"), {"x": 3.0}, 6), (c.derivative(x * y, "x"), {"x": 3.0, "y": 5.0}, 5), (c.derivative(2.0 * x, "x"), {"x": 7.0}, 2),
        (c.derivative(x * x * x, "x"), {"x": 2.0}, 12), (c.mixed_partial(x * y, "x", "y"), {"x": 1.0, "y": 1.0}, 1), (c.laplacian(x * x + y * y), {"x": 1.0, "y": 2.0}, 4),
        (c.nth_derivative(x * x * x, "x", 2), {"x": 2.0}, 12), (c.nth_derivative(x, "x", 0), {"x": 2.0}, 2),
    ],
)
def test_derivative_values(e, env, want):
    assert value(e, **env) == want
    assert value(c.simplify(e), **env) == want


def test_inspection_and_printing():
    e = (x * x) + (y * 2.0)
    assert variables(y + x) == ["y", "x"]
    assert contains(e, "x") and not contains(e, "z") and count(e, "x") == 2
    assert str(e) == "((x * x) + (y * 2))"
    assert str(derivative_of(e, "x")) == "d(((x * x) + (y * 2)))/dx"
    assert str(laplacian_of(x)) == "∇²(x)"
    assert str(einsum(x, "ij", "ik", y, "jk")) == "einsum[ij,jk->ik](x, y)"
    assert "[[       1,        2]\n [       3,        4]]" in str(matrix([[1, 2], [3, 4]]))
    assert Op.EINSUM.is_unary is Op.EINSUM.is_binary is False


def test_simplify_rules():
    s = c.simplify
    assert s(x + 0.0) == s(0.0 + x) == s(1.0 * x) == x
    assert s(scalar(0) * x) == s(-scalar(0)) == s(x.dot(0.0)) == scalar(0)
    assert s(scalar(2) + 3.0) == scalar(5) and s(scalar(2) * 3.0) == scalar(6)
    assert str(s(x + x)) == "(2 * x)" and s(2.0 * x + x * -2.0) == scalar(0) and s(2.0 * x + (-1.0) * x) == x
    assert s(-(-x)) == -(-x) and s(x + (-x)) == x + (-x)
    assert s(derivative_of(x + 0.0, "x")) == derivative_of(x, "x")
    assert s(einsum(scalar(0), "i", "", x, "i")) == scalar(0)


def test_errors():
    with pytest.raises(ValueError):
        c.derivative(laplacian_of(x), "x")
    assert c.derivative(laplacian_of(x), "x", strict_parity=True) == scalar(0)
    for bad in (lambda: c.laplacian(scalar(1)), lambda: c.nth_derivative(x, "x", -1), lambda: column(laplacian_of(x)), lambda: Literal((1.0,), (1, 1, 2))):
        with pytest.raises(ValueError):
            bad()


def test_substitution_and_differences():
    assert str(c.simplify(substitute(x * y + x, {"x": 2.0}))) == "((2 * y) + 2)"
    for kind, want in (("forward", 6.5), ("backward", 5.5), ("central", 6.0)):
        assert value(c.finite_difference(x * x, "x", 0.5, kind), x=3.0) == want
    assert value(c.finite_difference_2nd(x * x, "x", 0.5), x=3.0) == 2


def test_hashes_and_registry():
    assert canonical_hash(x + y) == canonical_hash(y + x) and canonical_hash(x * 2.0) == canonical_hash(2.0 * x)
    assert canonical_hash(x @ y) != canonical_hash(y @ x)
    assert len({canonical_hash(einsum(x, a, "ij", y, "jk")) for a in ("ij", "ik", "ji")}) == 3
    assert canonical_hash(derivative_of(x, "x")) != canonical_hash(derivative_of(x, "y"))
    assert canonical_hash(zeros((1, 2, 2))) != canonical_hash(matrix([[0, 0], [0, 0]]))
    r = Registry()
    assert r.register(x + y) and not r.register(y + x) and r.contains(x + y) and not r.contains(x)
    assert r.matching(x + y) == [y + x, x + y]


trees = st.recursive(st.sampled_from([x, y]) | st.integers(-3, 3).map(scalar), lambda t: st.tuples(t, t).map(lambda p: p[0] + p[1]) | st.tuples(t, t).map(lambda p: p[0] * p[1]) | t.map(lambda e: -e), max_leaves=8)


@given(trees, trees, st.integers(-4, 4), st.integers(-4, 4))
def test_simplify_keeps_values_and_derivatives_are_linear(e, f, a, b):
    env = {"x": float(a), "y": float(b)}
    assert value(c.simplify(e), **env) == value(e, **env)
    assert value(c.derivative(e + f, "x"), **env) == value(c.derivative(e, "x"), **env) + value(c.derivative(f, "x"), **env)
    assert canonical_hash(e + f) == canonical_hash(f + e)
