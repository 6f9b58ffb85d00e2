"""Compiles a pattern to joins over flat tables, as a second way to the same result: for graphs of any size, and to check the first.

tokens: keys, tok, n, form, form_norm, lemma, lemma_norm, tags. edges: keys, gov, dep, dtype; anyrel for basic relations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ast
from .prune import lengths, needs_edge


class Relational:
    def __init__(self, tokens: DataFrame, edges: DataFrame, *, keys=("graph_id",), insensitive: bool = False):
        self.tokens, self.edges, self.keys, self.insensitive = tokens, edges, list(keys), insensitive
        self.at = [*self.keys, "tok"]

    def _where(self, condition: Column) -> DataFrame:
        return self.tokens.where(condition).select(*self.at)

    def _word(self, field: str, word: str) -> Column:
        out = F.col(field) == word
        return out | F.coalesce(F.col(f"{field}_norm") == word, F.lit(False)) if self.insensitive else out

    def set(self, node: ast.Node) -> DataFrame:
        """keys, tok of a set; no row twice."""
        match node:
            case ast.AnyToken():
                return self.tokens.select(*self.at)
            case ast.Form(word=w):
                return self._where(self._word("form", w))
            case ast.Lemma(word=w):
                return self._where(self._word("lemma", w))
            case ast.Tag(name=t):
                return self._where(F.array_contains("tags", F.lit(t)))
            case ast.And(left=a, right=b):
                return self.set(a).join(self.set(b), self.at, "left_semi")
            case ast.Or(left=a, right=b):
                return self.set(a).union(self.set(b)).distinct()
            case ast.Not(node=a):
                return self.tokens.select(*self.at).join(self.set(a), self.at, "left_anti")
            case ast.Plus(left=a, right=b):
                a, b = self.set(a), self.set(b)
                return a.union(b).distinct().join(a, self.keys, "left_semi").join(b, self.keys, "left_semi")
            case ast.Equal(left=a, right=b):
                a, b = self.set(a), self.set(b)
                return a.join(a.join(b, self.at, "left_anti").union(b.join(a, self.at, "left_anti")), self.keys, "left_anti")
            case ast.Subset(left=a, right=b):
                a, b = self.set(a), self.set(b)
                return a.join(a.join(b, self.at, "left_anti"), self.keys, "left_anti")
            case ast.Restricted(head=h, restrictions=rs):
                return self._restricted(self.set(h), rs)
        raise TypeError(node)

    def _restricted(self, head: DataFrame, restrictions) -> DataFrame:
        found = []
        for r, target in restrictions:
            negative = isinstance(r, ast.Without)
            pairs = self.pairs(r.relation if negative else r)
            if not isinstance(target, ast.AnyToken):
                pairs = pairs.join(self.set(target).withColumnRenamed("tok", "u"), [*self.keys, "u"], "left_semi")
            if negative:
                head = head.join(pairs.withColumnRenamed("t", "tok"), self.at, "left_anti")
            else:
                found.append(pairs)
        if len(found) == 1:
            return head.join(found[0].withColumnRenamed("t", "tok"), self.at, "left_semi")
        if found:
            named = [p.select(*self.keys, F.col("t").alias("tok"), F.col("u").alias(f"u{i}")) for i, p in enumerate(found)]

            def meet(a: DataFrame, b: DataFrame) -> DataFrame:
                out = a.join(b, self.at)
                last = b.columns[-1]
                return out.where(reduce(lambda x, y: x & y, (F.col(c) != F.col(last) for c in a.columns if c[0] == "u" and c[1:].isdigit())))

            head = head.join(reduce(meet, named), self.at, "left_semi")
        return head

    def pairs(self, r) -> DataFrame:
        """keys, t, u of a relation from t to u. A pair may be there more than once: all that is asked is whether there is one, so none is dealt out to tell."""
        columns = [*self.keys, "t", "u"]
        match r:
            case ast.Edge(other=True):
                return self.pairs(ast.Edge(r.governs, None)).join(self.pairs(ast.Edge(r.governs, r.name, r.side)), columns, "left_anti")
            case ast.Edge():
                t, u = ("gov", "dep") if r.governs else ("dep", "gov")
                out = self.edges.where(F.col("dtype") == (r.name or "anyrel")).select(*self.keys, F.col(t).alias("t"), F.col(u).alias("u"))
                return out.where(F.col("u") < F.col("t")) if r.side == "L" else out.where(F.col("u") > F.col("t")) if r.side == "R" else out
            case ast.Linear(first=a, last=b, side=side):
                n = F.col("n")
                far = n if b is None else F.least(n, F.lit(b))
                steps = F.when(far >= a, F.sequence(F.lit(a), F.greatest(far, F.lit(a)))).otherwise(F.array().cast("array<int>"))
                signs = F.array(*[F.lit(s) for s in ((-1,) if side == "L" else (1,) if side == "R" else (-1, 1))])
                out = self.tokens.select(*self.keys, "n", F.col("tok").alias("t"), F.explode(steps).alias("step")).withColumn("sign", F.explode(signs))
                out = out.withColumn("u", (F.col("t") + F.col("sign") * F.col("step")).cast("int"))
                return out.where((F.col("u") >= 0) & (F.col("u") < F.col("n"))).select(*columns)
            case ast.Both(left=a, right=b):
                return self.pairs(a).join(self.pairs(b), columns, "left_semi")
            case ast.Either(left=a, right=b):
                return self.pairs(a).union(self.pairs(b))
        raise TypeError(r)


def hits(tokens: DataFrame, edges: DataFrame, tree: ast.Node, *, keys=("graph_id",), insensitive: bool = False, require_edge: bool = True) -> DataFrame:
    """keys, tok of each token found."""
    for keyword, limit in lengths(tree):
        tokens = tokens.where(F.col("n") < limit if keyword == "max" else F.col("n") > limit)
    if require_edge and needs_edge(tree):
        tokens = tokens.join(edges.where("dtype = 'anyrel'"), list(keys), "left_semi")
    return Relational(tokens, edges, keys=keys, insensitive=insensitive).set(tree)
