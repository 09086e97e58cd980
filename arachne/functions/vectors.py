"""Vector arithmetic on array columns, as JVM-side higher-order functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def vec(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def total(a: Column | str) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def sub(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def mul(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x * y)


def scale(a: Column | str, k: Column | float) -> Column:
    return F.transform(_c(a), lambda x: x * k)


def l1(a: Column | str) -> Column:
    return total(F.transform(_c(a), F.abs))


def l2(a: Column | str) -> Column:
    return F.sqrt(total(F.transform(_c(a), lambda x: x * x)))


def unit(a: Column | str, floor: float = 1e-12) -> Column:
    """a over its L2 norm (at least floor)."""
    return F.transform(_c(a), lambda x: x / F.greatest(l2(a), F.lit(floor)))


def relu(a: Column | str) -> Column:
    return F.transform(_c(a), lambda x: F.greatest(x, F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def linear(a: Column | str, weight: Sequence[Sequence[float]], bias: Sequence[float] | None = None) -> Column:
    """weight (rows: outputs) times a, plus bias."""
    out = [dot(a, vec(row)) for row in weight]
    return F.array(*[o + float(bias[i]) if bias is not None else o for i, o in enumerate(out)])


def matvec(matrix: Column | str, a: Column | str) -> Column:
    """An array of rows times a."""
    return F.transform(_c(matrix), lambda row: dot(row, a))


def sum_vectors(a: str, size: int) -> Column:
    """Aggregate: the sum of array columns of a known size, one codegen sum for each place."""
    return F.array(*[F.sum(F.col(a)[i]) for i in range(size)])


def mean_vectors(a: str, size: int) -> Column:
    return F.array(*[F.avg(F.col(a)[i]) for i in range(size)])


def max_vectors(a: str, size: int) -> Column:
    return F.array(*[F.max(F.col(a)[i]) for i in range(size)])


def zeros(size: int) -> Column:
    return vec([0.0] * size)


def rounded(a: Column | str, digits: int = 6) -> Column:
    """Rounded, with no negative zero, so that equal results print alike."""
    return F.transform(_c(a), lambda x: F.round(x, digits) + F.lit(0.0))
