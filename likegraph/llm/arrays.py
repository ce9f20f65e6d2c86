"""Running sums and maxima over arrays, inside rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements summed anew for each place; with blocks, a long array costs far less than its square.
_BLOCK = 64


def let(value: Column, body) -> Column:
    """body(value), with value worked out once: what a lambda refers to from outside would be worked out anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, op, zero) -> Column:
    fold = lambda xs: F.aggregate(xs, F.lit(zero).cast("long"), op)
    block = lambda i: F.floor(i / _BLOCK).cast("int")
    each = lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / _BLOCK).cast("int") - 1, F.lit(0))), lambda b: fold(F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK))))
    before = lambda e: F.aggregate(e, F.array(F.lit(zero).cast("long")), lambda acc, x: F.array_append(acc, op(F.element_at(acc, -1), x)))
    return let(values, lambda v: let(before(each(v)), lambda b: F.transform(v, lambda _, i: op(F.element_at(b, block(i) + 1), fold(F.slice(v, block(i) * _BLOCK + 1, i % _BLOCK + 1))))))


def running_totals(values: Column) -> Column:
    """The sum of the elements up to each."""
    return _running(values, lambda a, b: a + b, 0)


def running_greatest(values: Column, least: int = 0) -> Column:
    """The greatest of least and the elements up to each."""
    return _running(values, lambda a, b: F.greatest(a, b), least)
