"""Vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.schema import DEGENERATE_NORM


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def usable(a: Column) -> Column:
    """Finite throughout and not all zero."""
    return F.exists(a, lambda x: x != 0) & ~F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def scaled(a: Column) -> Column:
    """``a`` of length 1; one without a direction stays."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a))).otherwise(F.transform(a, lambda x: x.cast("double")))


def max_difference(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def bucket(word: Column, dim: int) -> Column:
    """The place of a word: the first four bytes of its SHA-256, modulo ``dim``."""
    return F.conv(F.substr(F.sha2(word, 256), F.lit(1), F.lit(8)), 16, 10).cast("bigint") % dim


def degenerate(a: Column) -> Column:
    return norm(a) < DEGENERATE_NORM
