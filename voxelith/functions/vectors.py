"""Column arithmetic on fixed-length vectors, in double."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

#: Products that are written out one by one, inside generated code; longer vectors use a lambda.
UNROLL = 128


def total(terms: list[Column]) -> Column:
    """The sum, in order, as one expression."""
    return reduce(lambda a, b: a + b, terms)


def dot(a: Column, b: Column | Sequence[float], size: int | None = None) -> Column:
    """The inner product; ``size`` unrolls it. A list of numbers is a constant vector."""
    if not isinstance(b, Column):
        size, constants = len(b), [float(x) for x in b]
        if size and size <= UNROLL:
            return total([F.get(a, F.lit(i)).cast("double") * F.lit(x) for i, x in enumerate(constants)])
        b = F.array(*[F.lit(x) for x in constants])
    if size and size <= UNROLL:
        return total([F.get(a, F.lit(i)).cast("double") * F.get(b, F.lit(i)).cast("double") for i in range(size)])
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column, size: int | None = None) -> Column:
    return F.sqrt(dot(a, a, size))


def normalized(a: Column, eps: float = 1e-8) -> Column:
    """The vector over its norm plus ``eps``."""
    n = norm(a) + F.lit(eps)
    return F.transform(a, lambda x: x.cast("double") / n)


def vector_sum(a: Column, size: int, weight: Column | None = None) -> Column:
    """An aggregate: the element-wise sum, one running sum an element, so rows are combined before any shuffle."""
    own = [F.get(a, F.lit(i)).cast("double") for i in range(size)]
    return F.array(*[F.sum(x if weight is None else x * weight) for x in own])
