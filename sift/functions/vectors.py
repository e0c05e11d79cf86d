"""Column functions over dense vectors stored as ``ARRAY<FLOAT|DOUBLE>``.

Spark 4.1 has no built-in vector arithmetic, so these are higher-order array
expressions.  Accumulation is always in DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(col_(a), col_(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda acc, x: acc + x)


def sumsq(a) -> Column:
    return F.aggregate(col_(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def norm(a) -> Column:
    return F.sqrt(sumsq(a))


def l2_normalize(a) -> Column:
    """Unit-length copy; a zero vector stays all zeros."""
    n = norm(a)
    return F.transform(col_(a), lambda x: F.when(n > 0, x.cast("double") / n)
                       .otherwise(F.lit(0.0)))


def cosine_similarity(a, b) -> Column:
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den).otherwise(F.lit(0.0))


def cosine_distance(a, b) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def l2sq_distance(a, b) -> Column:
    return F.aggregate(
        F.zip_with(col_(a), col_(b), lambda x, y: (x.cast("double") - y.cast("double"))
                   * (x.cast("double") - y.cast("double"))),
        F.lit(0.0), lambda acc, x: acc + x)


def inner_product_distance(a, b) -> Column:
    return F.lit(1.0) - dot(a, b)


def similarity_from_distance(d) -> Column:
    """``1 - distance`` as the fast profile reports it (not a cosine for L2)."""
    return F.lit(1.0) - col_(d)
