"""Vector arithmetic as Column expressions over array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once: inside a lambda, an expression would be evaluated for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def as_doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def length(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """v over its length; null for a zero vector."""
    return let(v, lambda w: let(length(w), lambda n: F.when(n > 0, F.transform(w, lambda x: x / n))))


def add_scaled(a: Column, b: Column, factor: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + factor * y)
