"""Vector arithmetic on array columns, carried out in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: floor of the product of norms in a cosine.
NORM_FLOOR = 1e-8


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(NORM_FLOOR))


def l2_squared(a: Column, b: Column) -> Column:
    def gap(x: Column, y: Column) -> Column:
        return (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))

    return _total(F.zip_with(a, b, gap))


def dummy_vector(dim: int = 1024) -> Column:
    """The vector of ones that the stand-in model returns for every text."""
    return F.array_repeat(F.lit(1.0).cast("float"), dim)


def check_dimension(vector: Column, dim: int) -> Column:
    """The vector itself, or a failed job when its length is not `dim`."""
    message = F.format_string(
        "a vector should have %d numbers but has %d", F.lit(dim), F.array_size(vector)
    )
    return F.when(F.array_size(vector) == dim, vector).otherwise(
        F.raise_error(message).cast("array<float>")
    )
