"""Column helpers for arrays of tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def span(first: Column, last: Column) -> Column:
    """The integers from first to last; none if last is smaller."""
    return F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))


def positions(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: x["idx"])


def before(values: Column) -> Column:
    """For each of an array of integers the sum of those before it. In pieces of a square root's length, so that long arrays take the power 1.5 of their length, not its square."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    sums = lambda a: F.transform(a, lambda _, i: total(F.slice(a, F.lit(1), i)))
    step = lambda v: F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
    pieces = lambda v: let(step(v), lambda s: F.transform(span(F.lit(0), F.floor((F.size(v) - 1) / s).cast("int")), lambda j: F.slice(v, j * s + 1, s)))
    placed = lambda p, b: F.flatten(F.transform(p, lambda a, j: F.transform(sums(a), lambda x: x + F.get(b, j))))
    return let(values, lambda v: let(pieces(v), lambda p: let(F.transform(p, total), lambda t: let(sums(t), lambda b: placed(p, b)))))
