"""Compiles a pattern to one Column over a sentence row: no join, no shuffle, no Python on the executors.

A sentence has an array `tokens` of structs; each token knows its edges both ways (`out`: tokens that it governs, `into`:
tokens that govern it), so that a restriction looks at a token's own edges only. A set is a predicate on a token; sets that a sentence-level
operator compares are computed first. Everything is one expression in which tokens and sets are variables: as columns of their own, the
optimizer would copy their definitions to each place of use.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, positions, span
from . import ast
from .prune import lengths, needs_edge


class Sentence:
    """The tokens of a sentence: a variable, an array of structs. Sentences whose tokens follow from something shorter have a class of their own with the same methods;
    tokens there are whatever gives a Column for the name of a field, so that fields are computed where a pattern asks for them and no others are."""

    def __init__(self, tokens: Column):
        self.tokens, self.n = tokens, F.size(tokens)

    def at(self, place: Column) -> Column:
        return F.get(self.tokens, place)

    def edges(self, x: Column, side: str) -> tuple[Column, Member]:
        """The edges of a token (out or into) as an array, and what gives an element's fields."""
        return x[side], lambda e: e

    def where(self, test: Member) -> Column:
        """The places of the tokens that pass a test, in order."""
        return positions(F.filter(self.tokens, test))

    def some(self, test: Member) -> Column:
        return F.exists(self.tokens, test)


Member = Callable[[Column], Column]
#: Binds a sentence of a row: from what is to be computed of it to the Column that does so.
Source = Callable[[Callable[[Sentence], Column]], Column]


def stored(body: Callable[[Sentence], Column]) -> Column:
    """The source of rows with a column tokens."""
    return let(F.col("tokens"), lambda t: body(Sentence(t)))


_SENTENCE = (ast.Plus, ast.Equal, ast.Subset)


def _sentence_nodes(node) -> list[ast.Node]:
    """Sentence-level operators of a tree, inner ones first."""
    match node:
        case ast.Restricted(head=h, restrictions=rs):
            return _sentence_nodes(h) + [n for _, t in rs for n in _sentence_nodes(t)]
        case ast.Not(node=a):
            return _sentence_nodes(a)
        case ast.And() | ast.Or() | ast.Plus() | ast.Equal() | ast.Subset():
            return _sentence_nodes(node.left) + _sentence_nodes(node.right) + ([node] if isinstance(node, _SENTENCE) else [])
    return []


class Nested:
    """A tree over a sentence."""

    def __init__(self, sentence: Sentence, insensitive: bool = False):
        self.sentence, self.insensitive = sentence, insensitive
        self.sets: dict[int, Column] = {}

    def hits(self, tree: ast.Node) -> Column:
        def build(rest: list[ast.Node]) -> Column:
            if not rest:
                return self._array(tree)

            def bound(value: Column) -> Column:
                self.sets[id(rest[0])] = value
                return build(rest[1:])

            return let(self._sentence(rest[0]), bound)

        return build(_sentence_nodes(tree))

    def _array(self, node: ast.Node) -> Column:
        return self.sentence.where(self.member(node))

    def _sentence(self, node: ast.Node) -> Column:
        none = F.array().cast("array<int>")

        def kept(a: Column, b: Column) -> Column:
            match node:
                case ast.Plus():
                    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.array_union(a, b)).otherwise(none)
                case ast.Equal():
                    return F.when(a == b, a).otherwise(none)  # both are in sentence order
            return F.when(F.size(F.array_except(a, b)) == 0, a).otherwise(none)

        return let(self._array(node.left), lambda a: let(self._array(node.right), lambda b: kept(a, b)))

    def member(self, node: ast.Node) -> Member:
        match node:
            case ast.AnyToken():
                return lambda x: x["idx"].isNotNull()
            case ast.Form(word=w):
                return self._word("form", w)
            case ast.Lemma(word=w):
                return self._word("lemma", w)
            case ast.Tag(name=t):
                return lambda x: F.array_contains(x["tags"], F.lit(t))
            case ast.And(left=a, right=b):
                a, b = self.member(a), self.member(b)
                return lambda x: a(x) & b(x)
            case ast.Or(left=a, right=b):
                a, b = self.member(a), self.member(b)
                return lambda x: a(x) | b(x)
            case ast.Not(node=a):
                a = self.member(a)
                return lambda x: ~a(x)
            case ast.Plus() | ast.Equal() | ast.Subset():
                return lambda x: F.array_contains(self.sets[id(node)], x["idx"])
            case ast.Restricted(head=h, restrictions=rs):
                return self._restricted(h, rs)
        raise TypeError(node)

    def _at(self, u: Column) -> Column:
        return self.sentence.at(u)

    def _word(self, field: str, word: str) -> Member:
        if self.insensitive:
            return lambda x: (x[field] == word) | F.coalesce(x[f"{field}_norm"] == word, F.lit(False))
        return lambda x: x[field] == word

    def _restricted(self, head: ast.Node, restrictions) -> Member:
        head = self.member(head)
        no, yes = [], []
        for r, target in restrictions:
            negative = isinstance(r, ast.Without)
            (no if negative else yes).append((r.relation if negative else r, None if isinstance(target, ast.AnyToken) else self.member(target)))

        def test(x: Column) -> Column:
            out = head(x)
            for r, target in no:
                out = out & ~self._some(r, target, x)
            if len(yes) == 1:
                out = out & self._some(*yes[0], x)
            elif yes:
                for r, target in yes:  # most tokens lack one, which is cheaper to see than to list
                    out = out & self._some(r, target, x)
                out = out & self._distinct([self._witnesses(r, t, x) for r, t in yes])
            return out

        return test

    def _edges(self, r: ast.Edge, x: Column) -> tuple[Column, Member, Member]:
        """The edges of x on a relation's side, whether one fits, and what gives an edge's fields."""
        edges, view = self.sentence.edges(x, "out" if r.governs else "into")

        def fits(e: Column) -> Column:
            e = view(e)
            out = e["basic"] if r.name is None else e["d"] == r.name
            if r.side:
                out = out & (e["u"] < x["idx"] if r.side == "L" else e["u"] > x["idx"])
            return out

        return edges, fits, view

    def _some(self, r, target: Member | None, x: Column) -> Column:
        """Whether a relation leads from x to a token of target."""
        if isinstance(r, ast.Edge):
            edges, fits, view = self._edges(ast.Edge(r.governs, None) if r.other else r, x)

            def leads(e: Column) -> Column:
                out = fits(e) if target is None else fits(e) & target(self._at(view(e)["u"]))
                if r.other:
                    _, named, _ = self._edges(ast.Edge(r.governs, r.name, r.side), x)
                    out = out & ~F.exists(edges, lambda f: named(f) & (view(f)["u"] == view(e)["u"]))
                return out

            return F.exists(edges, leads)
        if isinstance(r, ast.Either):
            return self._some(r.left, target, x) | self._some(r.right, target, x)
        found = self._related(r, x)
        return F.size(found) > 0 if target is None else F.exists(found, lambda u: target(self._at(u)))

    def _witnesses(self, r, target: Member | None, x: Column) -> Column:
        found = self._related(r, x)
        return found if target is None else F.filter(found, lambda u: target(self._at(u)))

    def _distinct(self, witnesses: list[Column]) -> Column:
        """Whether one witness of each list can be chosen, all different."""
        names = [f"w{i}" for i in range(len(witnesses))]

        def choose(all_: Column, i: int, before: list[Column]) -> Column:
            if i == len(names):
                return F.lit(True)

            def free(u: Column) -> Column:
                out = choose(all_, i + 1, [*before, u])
                for b in before:
                    out = (u != b) & out
                return out

            return F.exists(all_[names[i]], free)

        return let(F.struct(*[w.alias(n) for w, n in zip(witnesses, names, strict=True)]), lambda a: choose(a, 0, []))

    def _related(self, r, x: Column) -> Column:
        """Positions that a relation leads to from x."""
        match r:
            case ast.Edge(other=True):
                return F.array_except(self._related(ast.Edge(r.governs, None), x), self._related(ast.Edge(r.governs, r.name, r.side), x))
            case ast.Edge():
                edges, fits, view = self._edges(r, x)
                return F.transform(F.filter(edges, fits), lambda e: view(e)["u"])
            case ast.Linear(first=a, last=b, side=side):
                n = self.sentence.n
                end = n if b is None else F.lit(b)
                left = span(F.greatest(F.lit(0), x["idx"] - end), x["idx"] - a)
                right = span(x["idx"] + a, F.least(n - 1, x["idx"] + end))
                return left if side == "L" else right if side == "R" else F.array_union(left, right)
            case ast.Both(left=a, right=b):
                return F.array_intersect(self._related(a, x), self._related(b, x))
            case ast.Either(left=a, right=b):
                return F.array_union(self._related(a, x), self._related(b, x))
        raise TypeError(r)


def column(graphs: DataFrame, tree: ast.Node, *, insensitive: bool = False, require_edge: bool = True, source: Source = stored) -> tuple[DataFrame, Column]:
    """Sentences of the lengths that a tree allows, and the positions found in each."""
    for keyword, limit in lengths(tree):
        graphs = graphs.where(F.col("n") < limit if keyword == "max" else F.col("n") > limit)
    return graphs, source(lambda s: _found(s, tree, insensitive, require_edge))


def _found(s: Sentence, tree: ast.Node, insensitive: bool, require_edge: bool) -> Column:
    out = Nested(s, insensitive).hits(tree)

    def hangs(x) -> Column:
        edges, view = s.edges(x, "into")
        return F.exists(edges, lambda e: view(e)["basic"])

    return F.when(s.some(hangs), out) if require_edge and needs_edge(tree) else out


def together(graphs: DataFrame, trees: dict[str, ast.Node], *, insensitive: bool = False, require_edge: bool = True, source: Source = stored) -> DataFrame:
    """keys, and for each name the positions that its tree finds in the sentence: one pass for all."""
    keys = [c for c in ("shard", "graph_id") if c in graphs.columns]
    none = F.array().cast("array<int>")

    def fits(tree: ast.Node) -> Column:
        return reduce(lambda a, b: a & b, (F.col("n") < limit if keyword == "max" else F.col("n") > limit for keyword, limit in lengths(tree)), F.lit(True))

    every = source(lambda s: F.struct(*[F.coalesce(F.when(fits(tree), _found(s, tree, insensitive, require_edge)), none).alias(name) for name, tree in trees.items()]))
    return graphs.select(*keys, F.explode(F.array(every)).alias("e")).select(*keys, "e.*")


def fields(tree: ast.Node, *, insensitive: bool = False, require_edge: bool = True) -> set[str]:
    """The fields of tokens, besides idx, that decide a tree."""

    def of_relation(r) -> set[str]:
        match r:
            case ast.Edge(governs=governs):
                return {"out" if governs else "into"}
            case ast.Both(left=a, right=b) | ast.Either(left=a, right=b):
                return of_relation(a) | of_relation(b)
            case ast.Without(relation=a):
                return of_relation(a)
        return set()

    def of(node) -> set[str]:
        match node:
            case ast.Form() | ast.Lemma():
                name = "form" if isinstance(node, ast.Form) else "lemma"
                return {name, f"{name}_norm"} if insensitive else {name}
            case ast.Tag():
                return {"tags"}
            case ast.Not(node=a):
                return of(a)
            case ast.Restricted(head=h, restrictions=rs):
                return of(h).union(*[of_relation(r) | of(t) for r, t in rs])
            case ast.And() | ast.Or() | ast.Plus() | ast.Equal() | ast.Subset():
                return of(node.left) | of(node.right)
        return set()

    return of(tree) | ({"into"} if require_edge and needs_edge(tree) else set())


def grouped(graphs: DataFrame, tree: ast.Node, keep=(), **options) -> DataFrame:
    """keys, columns to keep, toks: one row per sentence with its tokens in order, where any is found. A sentence is one row of graphs, so nothing is shuffled."""
    keys = [c for c in ("shard", "graph_id") if c in graphs.columns]
    graphs, found = column(graphs, tree, **options)
    return graphs.select(*keys, *keep, F.explode(F.filter(F.array(found), lambda f: F.size(f) > 0)).alias("toks"))  # exploded, so that it is computed once


def hits(graphs: DataFrame, tree: ast.Node, **options) -> DataFrame:
    """keys, tok of each token found."""
    keys = [c for c in ("shard", "graph_id") if c in graphs.columns]
    graphs, found = column(graphs, tree, **options)
    return graphs.select(*keys, F.explode(found).alias("tok"))
