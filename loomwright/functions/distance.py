"""Vector distances as column expressions: smaller is nearer, null or non-finite vectors give null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "cosine", "dot", "hamming")


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def inner(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(_doubles(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, 1.0 - inner(a, b) / size)


def dot(a: Column, b: Column) -> Column:
    return 1.0 - inner(a, b)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of bytes."""
    bits = F.zip_with(a.cast("array<int>"), b.cast("array<int>"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda acc, x: acc + x).cast("double")


def distance(metric: str, a: Column, b: Column) -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")
    d = {"l2": l2, "cosine": cosine, "dot": dot, "hamming": hamming}[metric](a, b)
    return F.when(~F.isnan(d), d)


def multivector(metric: str, row: Column, queries: Sequence[Sequence[float]]) -> Column:
    """1 - sum over query vectors of the best similarity (1 - distance) among the row's vectors."""
    total = None
    for q in queries:
        best = F.array_max(F.transform(row, lambda v: 1.0 - distance(metric, v, literal(q))))
        total = best if total is None else total + best
    return 1.0 - total


def normalise(v: Column) -> Column:
    size = norm(v)
    return F.when(size > 0, F.transform(_doubles(v), lambda x: x / size))


def residual(v: Column, centre: Column) -> Column:
    return F.zip_with(_doubles(v), _doubles(centre), lambda x, y: x - y)


def finite(v: Column) -> Column:
    """Whether a vector is there and holds neither null, NaN nor infinity."""
    odd = F.exists(_doubles(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(odd, F.lit(True))
