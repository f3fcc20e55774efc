"""Vector arithmetic on array columns, in doubles, and text helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: str | Column) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(*vectors: Column) -> Column:
    """The sum of products of two, three or more vectors."""
    return total(reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x * y), vectors))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def mean_squared_difference(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))) / F.size(a)


def mean_pool(tokens: Column, mask: Column, dim: int) -> Column:
    """The mean of those token vectors whose mask is 1; zeros if there is none."""
    zero = F.array(*[F.lit(0.0)] * dim)
    kept = F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: x["m"] == 1)
    sums = F.aggregate(kept, zero, lambda a, x: F.zip_with(a, x["t"].cast("array<double>"), lambda p, q: p + q))
    return F.transform(sums, lambda x: x / F.greatest(F.lit(1), F.size(kept)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def residues(sequence: Column) -> Column:
    """A protein sequence for a tokenizer: rare residues as X, a blank one as X, letters set apart."""
    text = F.regexp_replace(F.upper(F.trim(F.coalesce(sequence, F.lit("")))), "[UZOB]", "X")
    return F.array_join(F.split(F.when(text == "", "X").otherwise(text), ""), " ")
