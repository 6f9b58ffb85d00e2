"""A pattern as one SQL statement over flat tables t (graph_id, tok, n, form, lemma, upos, feats) and e (graph_id, gov, dep, dtype)."""

from __future__ import annotations

from . import ast
from .prune import lengths, needs_edge


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


class Statement:
    """Common table expressions, one for each set and relation of a tree."""

    def __init__(self, insensitive: bool = False):
        self.parts: list[str] = []
        self.insensitive = insensitive

    def _add(self, query: str) -> str:
        name = f"q{len(self.parts)}"
        self.parts.append(f"{name} AS ({query})")
        return name

    def _word(self, field: str, word: str) -> str:
        low = f"lower({field})" if field == "form" else f"regexp_replace(lower({field}), '[#-]', '', 'g')"
        return f"{field} = {_quoted(word)}" + (f" OR {low} = {_quoted(word)}" if self.insensitive else "")

    def _leaf(self, condition: str) -> str:
        return self._add(f"SELECT graph_id, tok FROM u WHERE {condition}")

    def set(self, node: ast.Node) -> str:
        match node:
            case ast.AnyToken():
                return self._leaf("true")
            case ast.Form(word=w):
                return self._leaf(self._word("form", w))
            case ast.Lemma(word=w):
                return self._leaf(self._word("lemma", w))
            case ast.Tag(name=t):
                q = _quoted(t)
                return self._leaf(f"upos = {q} AND upos <> '_' OR list_contains(string_split(feats, '|'), {q}) OR list_contains(list_transform(list_filter(string_split(feats, '|'), lambda f: contains(f, '=')), lambda f: split_part(f, '=', 1)), {q})")
            case ast.And(left=a, right=b):
                return self._add(f"SELECT * FROM {self.set(a)} INTERSECT SELECT * FROM {self.set(b)}")
            case ast.Or(left=a, right=b):
                return self._add(f"SELECT * FROM {self.set(a)} UNION SELECT * FROM {self.set(b)}")
            case ast.Not(node=a):
                return self._add(f"SELECT graph_id, tok FROM u EXCEPT SELECT * FROM {self.set(a)}")
            case ast.Plus(left=a, right=b):
                a, b = self.set(a), self.set(b)
                return self._add(f"SELECT * FROM (SELECT * FROM {a} UNION SELECT * FROM {b}) WHERE graph_id IN (SELECT graph_id FROM {a}) AND graph_id IN (SELECT graph_id FROM {b})")
            case ast.Equal(left=a, right=b):
                a, b = self.set(a), self.set(b)
                return self._add(f"SELECT * FROM {a} WHERE graph_id NOT IN (SELECT graph_id FROM ((SELECT * FROM {a} EXCEPT SELECT * FROM {b}) UNION ALL (SELECT * FROM {b} EXCEPT SELECT * FROM {a})))")
            case ast.Subset(left=a, right=b):
                a, b = self.set(a), self.set(b)
                return self._add(f"SELECT * FROM {a} WHERE graph_id NOT IN (SELECT graph_id FROM (SELECT * FROM {a} EXCEPT SELECT * FROM {b}))")
            case ast.Restricted(head=h, restrictions=rs):
                base, where, joins = self.set(h), [], []
                for r, target in rs:
                    negative = isinstance(r, ast.Without)
                    pairs = self.pairs(r.relation if negative else r)
                    if not isinstance(target, ast.AnyToken):
                        pairs = self._add(f"SELECT p.* FROM {pairs} p JOIN {self.set(target)} s ON p.graph_id = s.graph_id AND p.u = s.tok")
                    if negative:
                        where.append(f"NOT EXISTS (SELECT 1 FROM {pairs} p WHERE p.graph_id = h.graph_id AND p.t = h.tok)")
                    else:
                        joins.append(pairs)
                tables = "".join(f" JOIN {p} p{i} ON p{i}.graph_id = h.graph_id AND p{i}.t = h.tok" for i, p in enumerate(joins))
                where += [f"p{i}.u <> p{j}.u" for j in range(len(joins)) for i in range(j)]
                return self._add(f"SELECT DISTINCT h.graph_id, h.tok FROM {base} h{tables}" + (" WHERE " + " AND ".join(where) if where else ""))
        raise TypeError(node)

    def pairs(self, r) -> str:
        match r:
            case ast.Edge(other=True):
                return self._add(f"SELECT * FROM {self.pairs(ast.Edge(r.governs, None))} EXCEPT SELECT * FROM {self.pairs(ast.Edge(r.governs, r.name, r.side))}")
            case ast.Edge():
                t, u = ("gov", "dep") if r.governs else ("dep", "gov")
                side = {"L": f" AND {u} < {t}", "R": f" AND {u} > {t}", None: ""}[r.side]
                return self._add(f"SELECT DISTINCT graph_id, {t} AS t, {u} AS u FROM e WHERE dtype = {_quoted(r.name or 'anyrel')}{side}")
            case ast.Linear(first=a, last=b, side=side):
                far = f"abs(y.tok - x.tok) >= {a}" + ("" if b is None else f" AND abs(y.tok - x.tok) <= {b}")
                near = {"L": " AND y.tok < x.tok", "R": " AND y.tok > x.tok", None: ""}[side]
                return self._add(f"SELECT x.graph_id, x.tok AS t, y.tok AS u FROM u x JOIN u y ON x.graph_id = y.graph_id AND {far}{near}")
            case ast.Both(left=a, right=b):
                return self._add(f"SELECT * FROM {self.pairs(a)} INTERSECT SELECT * FROM {self.pairs(b)}")
            case ast.Either(left=a, right=b):
                return self._add(f"SELECT * FROM {self.pairs(a)} UNION SELECT * FROM {self.pairs(b)}")
        raise TypeError(r)


def statement(tables: str, tree: ast.Node, *, insensitive: bool = False, require_edge: bool = True) -> str:
    """Hits of a tree as graph_id, tok. tables: common table expressions that define t and e."""
    s = Statement(insensitive)
    keep = [f"n {'<' if k == 'max' else '>'} {limit}" for k, limit in lengths(tree)]
    if require_edge and needs_edge(tree):
        keep.append("graph_id IN (SELECT graph_id FROM e)")
    top = s.set(tree)
    whole = f"u AS (SELECT * FROM t{' WHERE ' + ' AND '.join(keep) if keep else ''})"
    return f"WITH {tables},\n{whole},\n" + ",\n".join(s.parts) + f"\nSELECT graph_id::BIGINT AS graph_id, tok::INT AS tok FROM {top}"
