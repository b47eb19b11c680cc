"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COSINE_EPS = 1e-8
NORM_EPS = 1e-12


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, value: total + value)


def dot(left: Column, right: Column) -> Column:
    """Inner product (H2)."""
    return _sum(F.zip_with(as_double(left), as_double(right), lambda a, b: a * b))


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity, the product of the norms bounded away from zero (H3)."""
    return dot(left, right) / F.greatest(norm(left) * norm(right), F.lit(COSINE_EPS))


def squared_distance(left: Column, right: Column) -> Column:
    return _sum(
        F.zip_with(as_double(left), as_double(right), lambda a, b: (a - b) * (a - b))
    )


def half_squared_distance(left: Column, right: Column) -> Column:
    """Half the squared Euclidean distance (H1)."""
    return squared_distance(left, right) / 2


def unit(vector: Column) -> Column:
    """The vector scaled to length one (H4)."""

    def scaled(v: Column) -> Column:
        length = F.greatest(norm(v), F.lit(NORM_EPS))
        return let(length, lambda n: F.transform(v, lambda value: value / n))

    return let(as_double(vector), scaled)


def is_zero(vector: Column) -> Column:
    return F.forall(as_double(vector), lambda value: value == 0)


def assert_dimension(df: DataFrame, column: str) -> int:
    """The common length of the vectors; raises if they differ or there are none (H5)."""
    sizes = df.agg(F.min(F.size(column)).alias("low"), F.max(F.size(column)).alias("high")).first()
    if sizes["low"] is None or sizes["low"] != sizes["high"] or sizes["low"] < 1:
        raise ValueError(f"vectors in {column} must have one length, found {sizes['low']}..{sizes['high']}")
    return sizes["low"]
