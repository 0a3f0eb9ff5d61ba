"""Column functions on vectors (arrays of numbers), in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalised(v: Column) -> Column:
    """Length 1; a zero vector stays. The inner function names the length, which is else found again for every component."""
    return F.when(norm(v) > 0, F.element_at(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x / n)), 1)).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


def projected(v: Column, dimensions: int) -> Column:
    """The first dimensions, brought to length 1 again."""
    return normalised(F.slice(v, 1, dimensions))


def int8(v: Column) -> Column:
    """Each component as a whole number from -127 to 127."""
    return F.transform(v, lambda x: F.floor(x * 127 + 0.5).cast("int"))


def binary(v: Column) -> Column:
    """The sign of each component."""
    return F.transform(v, lambda x: F.when(x > 0, 1).otherwise(0))


def agreement(a: Column, b: Column) -> Column:
    """How many components of two binary vectors are equal."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
