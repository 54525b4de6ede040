"""Vectors as arrays; sums in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def l2_normalize(a) -> Column:
    """A zero vector stays as it is."""
    one = lambda v: let(norm(v), lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n)))
    return let(col(a), one)


def cosine(a, b) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def hash_bucket(token, dim: int = 64) -> Column:
    """A token's dimension in the default embedding, by its md5."""
    return (F.conv(F.substring(F.md5(col(token).cast("binary")), 1, 8), 16, 10).cast("long") % dim).cast("int")


def hash_embed(tokens, dim: int = 64) -> Column:
    """Counts of hashed tokens, unit length: the offline default that depends on content alone."""
    # between the markers 0 .. dim of a sorted array lie the tokens of each bucket
    buckets = F.concat(F.transform(col(tokens), lambda t: hash_bucket(t, dim)), F.sequence(F.lit(0), F.lit(dim)))
    count = lambda s, i: (F.array_position(s, i + 1) - F.array_position(s, i) - 1).cast("double")
    return l2_normalize(let(F.array_sort(buckets), lambda s: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: count(s, i))))
