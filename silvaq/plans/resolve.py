"""Decides what words without quotes mean, by the vocabulary of symbols."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ast


@dataclass
class Symbols:
    """tags: what is searched as a tag. values: the full form that a value stands for."""

    tags: set[str] = field(default_factory=set)
    values: dict[str, str] = field(default_factory=dict)


def symbol_kinds(stats: DataFrame) -> DataFrame:
    """symbol, is_tag, value_of: the most frequent full form of a symbol that is a value and nothing else (ties: the first by name)."""
    kinds = stats.groupBy("symbol").agg(F.max(F.col("s_type").isin("TAG", "CAT", "CAT=VAL")).alias("is_tag"), F.min(F.col("s_type") == "VAL").alias("only_value"))
    order = Window.partitionBy("symbol").orderBy(F.desc("cnt"), "full_form")
    best = stats.where("s_type = 'VAL'").withColumn("r", F.row_number().over(order)).where("r = 1").select("symbol", "full_form")
    return kinds.join(best, "symbol", "left").select("symbol", "is_tag", F.when(F.col("only_value"), F.col("full_form")).alias("value_of"))


def load(stats: DataFrame) -> Symbols:
    """The vocabulary on the driver: tag names, values and categories, whose number does not grow with the corpus. Relation names stay out."""
    rows = symbol_kinds(stats).where("is_tag OR value_of IS NOT NULL").collect()
    return Symbols({r["symbol"] for r in rows if r["is_tag"]}, {r["symbol"]: r["value_of"] for r in rows if r["value_of"] is not None})


def resolve(node, symbols: Symbols | None):
    """The tree with each bare word as a tag, the tag that a value stands for, or else a form. Without symbols every bare word is a tag."""
    if symbols is None:
        return node
    match node:
        case ast.Tag(name=t):
            if t in symbols.tags:
                return node
            if t in symbols.values:
                return ast.Tag(symbols.values[t], comments=node.comments)
            return ast.Form(t, comments=node.comments)
        case ast.And() | ast.Or() | ast.Plus() | ast.Equal() | ast.Subset():
            return type(node)(resolve(node.left, symbols), resolve(node.right, symbols), comments=node.comments)
        case ast.Not():
            return ast.Not(resolve(node.node, symbols), comments=node.comments)
        case ast.Restricted():
            return ast.Restricted(resolve(node.head, symbols), [(r, resolve(t, symbols)) for r, t in node.restrictions], comments=node.comments)
    return node
