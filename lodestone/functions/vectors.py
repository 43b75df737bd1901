"""Vector expressions over array columns, summed in double precision in element order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def l2_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def score(distance: Column) -> Column:
    """1 - d^2 / 2: the cosine of unit vectors; applied to any distance as it is."""
    return F.lit(1.0) - distance * distance / F.lit(2.0)


def l2_normalize(v: Column) -> Column:
    """A vector of length 1; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))
