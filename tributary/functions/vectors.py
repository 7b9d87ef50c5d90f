"""Vector expressions over array columns, summed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def normalized(v: Column | str) -> Column:
    return F.transform(doubles(v), lambda x: F.try_divide(x, norm(v)))


def cosine(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def centered(tags: Column | str) -> Column:
    """Ratings 1..5 to -1..1."""
    return F.transform(doubles(tags), lambda x: (x - 3.0) / 2.0)


def uncentered(tags: Column | str) -> Column:
    return F.transform(doubles(tags), lambda x: x * 2.0 + 3.0)


def blended(a: Column | str, b: Column | str, share: Column | str) -> Column:
    """share * a + (1 - share) * b, component by component."""
    p = F.col(share) if isinstance(share, str) else share
    return F.zip_with(doubles(a), doubles(b), lambda x, y: p * x + (1.0 - p) * y)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def r6(x: Column) -> Column:
    return F.round(x, 6)
