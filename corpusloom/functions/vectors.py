"""Vector and distribution measures over array columns, in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, not for each element of a lambda in it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def correlation(x: Column | str, y: Column | str) -> Column:
    """Over rows that have both; null where either side has no variance, which `corr` divides by."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))


def softmax(a: Column) -> Column:
    """Shares of the exponentials, taken after the largest value is subtracted, so that none overflows."""
    shifted = bound(F.array_max(doubles(a)), lambda m: F.transform(doubles(a), lambda x: F.exp(x - m)))
    return bound(shifted, lambda e: bound(total(e), lambda t: F.transform(e, lambda x: x / t)))


def normalised(p: Column) -> Column:
    return bound(total(doubles(p)), lambda t: F.transform(doubles(p), lambda x: x / t))


def entropy(p: Column, eps: float = 0.0) -> Column:
    """-sum p ln(p + eps); zeros add nothing."""
    return -total(F.transform(doubles(p), lambda x: F.when(x > 0, x * F.ln(x + F.lit(eps))).otherwise(0.0)))


def variance(p: Column) -> Column:
    return bound(total(doubles(p)) / F.size(p), lambda m: total(F.transform(doubles(p), lambda x: (x - m) * (x - m))) / F.size(p))


def top_values(p: Column, k: int) -> Column:
    return F.slice(F.reverse(F.array_sort(doubles(p))), 1, k)


def nucleus(p: Column, mass: float = 0.95) -> Column:
    """Values in the smallest prefix of the sorted ones that reaches the mass."""
    step = lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["n"] + F.when(s["sum"] < mass, 1).otherwise(0)).cast("int").alias("n"))
    return F.aggregate(F.reverse(F.array_sort(doubles(p))), F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("int").alias("n")), step, lambda s: s["n"])
