"""Vector columns in double arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    lengths = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.when(lengths > 0, dot(left, right) / lengths).otherwise(F.lit(0.0))


def checked_size(vector: Column, size: int) -> Column:
    """The vector, or an error that fails the job when it has another size."""
    return F.when(F.size(vector) == size, vector).otherwise(
        F.raise_error(F.concat(F.lit(f"vector size is not {size}: "), F.size(vector).cast("string")))
        .cast("array<float>")
    )
