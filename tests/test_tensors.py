import pytest

from sparkfield.functions.expr import matrix, vector, zeros
from sparkfield.operators import tensor as t


@pytest.fixture(scope="module")
def ab(spark):
    return t.from_literal(spark, matrix([[1, 2], [3, 4]])), t.from_literal(spark, matrix([[5, 6], [7, 8]]))


def values(x):
    return [r.v for r in x.df.orderBy("i", "j", "k").collect()]


def test_products(ab):
    a, b = ab
    assert values(t.matmul(a, b)) == values(t.einsum("ij,jk->ik", a, b)) == [19, 22, 43, 50]
    assert values(t.matmul(b, a)) == [23, 34, 31, 46]
    assert values(t.einsum("ij,ij->ij", a, b)) == values(t.multiply(a, b)) == [5, 12, 21, 32]
    assert values(t.transpose(a)) == values(t.einsum("ij->ji", a)) == [1, 3, 2, 4]
    assert values(t.einsum("ii->", a)) == [5]
    assert t.dot(a, b).first().v == 70


def test_vectors(spark):
    v = lambda *x: t.from_literal(spark, vector(x))
    assert values(t.einsum("i,j->ij", v(1, 2, 3), v(4, 5))) == [4, 5, 8, 10, 12, 15]
    assert values(t.einsum("i,i->", v(1, 2, 3), v(4, 5, 6))) == [32]


def test_broadcast_and_access(spark, ab):
    a, _ = ab
    row = t.from_literal(spark, vector([10, 20]))
    assert values(t.add(a, row)) == [11, 22, 13, 24]
    assert values(t.subtract(row, a)) == [9, 18, 7, 16]
    assert values(t.multiply(a, row)) == [10, 40, 30, 80]
    assert values(t.scale(t.negate(a), 2)) == [-2, -4, -6, -8]
    assert t.norm(a).first().norm == pytest.approx(30**0.5)
    assert t.get(a, (0, 1, 0)).first().v == 3
    assert values(t.set_value(a, (0, 0, 0), 9)) == [9, 2, 3, 4]
    assert t.create_zero(spark, (1, 2, 2)).df.count() == 0
    packed = t.to_packed(a)
    assert packed.first().t.data == [1, 2, 3, 4]
    assert values(t.to_long(packed, "t", a.shape, ())) == [1, 2, 3, 4]
    assert t.from_literal(spark, zeros((1, 2, 2))).df.count() == 0


def test_shape_errors(spark, ab):
    a, _ = ab
    odd = t.create(spark, (1, 3, 2))
    for bad in (lambda: t.matmul(a, odd), lambda: t.add(a, odd), lambda: t.dot(a, odd), lambda: t.einsum("ij,jk->il", a, a), lambda: t.einsum("ii->ii", a), lambda: t.einsum("ij,jk->ik", a, odd), lambda: t.broadcast_to(a, (1, 3, 2))):
        with pytest.raises(ValueError):
            bad()
