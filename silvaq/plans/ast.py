"""Syntax tree of the pattern language."""

from __future__ import annotations

from dataclasses import dataclass, field


class ExpressionError(ValueError):
    """A pattern that cannot be read. offset: where, in characters."""

    def __init__(self, message: str, offset: int | None = None):
        super().__init__(message if offset is None else f"{message} (at {offset})")
        self.offset = offset


# Relations between two tokens of a sentence.


@dataclass(frozen=True)
class Edge:
    """governs: the left token governs the right one by `name` (None: any basic relation); other: by any basic relation but that. side: L, R or None."""

    governs: bool
    name: str | None = None
    side: str | None = None
    other: bool = False


@dataclass(frozen=True)
class Linear:
    """The tokens stand first to last places apart (last None: to the sentence's end)."""

    first: int
    last: int | None
    side: str | None = None


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


@dataclass(frozen=True)
class Without:
    """A negated restriction; only as a whole restriction."""

    relation: object


# Sets of tokens of a sentence.


@dataclass
class Node:
    comments: list[str] = field(default_factory=list, kw_only=True)


@dataclass
class AnyToken(Node):
    pass


@dataclass
class Form(Node):
    word: str


@dataclass
class Lemma(Node):
    word: str


@dataclass
class Tag(Node):
    """A tag, a value or a word without quotes, as it stands; resolve() decides."""

    name: str


@dataclass
class And(Node):
    left: Node
    right: Node


@dataclass
class Or(Node):
    left: Node
    right: Node


@dataclass
class Not(Node):
    node: Node


@dataclass
class Plus(Node):
    """The union, if neither is empty in the sentence."""

    left: Node
    right: Node


@dataclass
class Equal(Node):
    """The left set, if both are equal in the sentence."""

    left: Node
    right: Node


@dataclass
class Subset(Node):
    """The left set, if the right one holds it all."""

    left: Node
    right: Node


@dataclass
class Restricted(Node):
    """Tokens of head that meet every (relation, target) restriction."""

    head: Node
    restrictions: list[tuple[object, Node]]


def show(x) -> str:
    """A tree as text, for explain()."""
    match x:
        case AnyToken():
            return "_"
        case Form(word=w):
            return f'"{w}"'
        case Lemma(word=w):
            return f"L={w}"
        case Tag(name=n):
            return n
        case And(left=a, right=b):
            return f"(and {show(a)} {show(b)})"
        case Or(left=a, right=b):
            return f"(or {show(a)} {show(b)})"
        case Not(node=a):
            return f"(not {show(a)})"
        case Plus(left=a, right=b):
            return f"(plus {show(a)} {show(b)})"
        case Equal(left=a, right=b):
            return f"(equal {show(a)} {show(b)})"
        case Subset(left=a, right=b):
            return f"(subset {show(a)} {show(b)})"
        case Restricted(head=h, restrictions=rs):
            return f"(where {show(h)} " + " ".join(f"[{show(r)} {show(t)}]" for r, t in rs) + ")"
        case Edge():
            return ("governs " if x.governs else "governed ") + ("other than " if x.other else "") + (x.name or "any") + (f"@{x.side}" if x.side else "")
        case Linear():
            return f"near {x.first}..{'' if x.last is None else x.last}" + (f"@{x.side}" if x.side else "")
        case Both(left=a, right=b):
            return f"{show(a)} and {show(b)}"
        case Either(left=a, right=b):
            return f"{show(a)} or {show(b)}"
        case Without(relation=r):
            return f"no {show(r)}"
    raise TypeError(x)
