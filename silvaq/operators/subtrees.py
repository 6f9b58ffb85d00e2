"""Sets and relations that follow edges any number of times. No pattern reaches them; they are columns to build searches of one's own with.

Trees of a sentence have 256 tokens at most, so every closure is one expression over its row: no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import let, span

NONE = "array<int>"


def add_edge(edges: Column, gov: Column, dep: Column) -> Column:
    """edges (array of gov, dep) with one more, if it is not there."""
    return F.array_union(edges, F.array(F.struct(gov.cast("int").alias("gov"), dep.cast("int").alias("dep"))))


def edges_of(tokens: Column) -> Column:
    """The basic edges of a sentence's tokens as an array of gov, dep."""
    return F.flatten(F.transform(tokens, lambda x: F.transform(F.filter(x["out"], lambda e: e["basic"]), lambda e: F.struct(x["idx"].alias("gov"), e["u"].alias("dep")))))


def children(edges: Column, chosen: Column) -> Column:
    """The tokens that any of the chosen ones governs, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(edges, lambda e: F.array_contains(chosen, e["gov"])), lambda e: e["dep"])))


def descendants(edges: Column, chosen: Column, n: Column) -> Column:
    """The chosen tokens and all below them, in order. n: the sentence's tokens, and so of steps at most; edges may form cycles."""
    step = lambda s, _: let(children(edges, s["new"]), lambda c: F.struct(F.array_union(s["all"], c).alias("all"), F.array_except(c, s["all"]).alias("new")))
    start = F.struct(chosen.cast(NONE).alias("all"), chosen.cast(NONE).alias("new"))
    return F.array_sort(F.aggregate(span(F.lit(1), n), start, step, lambda s: s["all"]))


def neighbours(n: Column, first: int, last: int) -> Column:
    """For each token the tokens that stand first to last places apart on either side: array of arrays."""
    beside = lambda t: F.concat(span(F.greatest(F.lit(0), t - last), t - first), span(t + first, F.least(n - 1, t + last)))
    return F.transform(span(F.lit(0), n - 1), beside)
