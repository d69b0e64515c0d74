"""Vector functions over array columns, summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(inner_product(v, v))


def normalized_vector(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return F.when(norm(v) > 0, F.transform(v, lambda x: (x.cast("double") / norm(v)).cast("float"))).otherwise(v)


def cosine_gate(similarity: Column) -> Column:
    """(1 + cosine) / 2, the older profile's similarity from a cosine distance."""
    return 1 - (1 - similarity) / 2
