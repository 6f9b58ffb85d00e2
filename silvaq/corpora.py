"""The catalog: corpora by id and name, wildcard corpora, and groups of corpora."""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

Listing = Callable[[str], list[str]]
_WILDCARD = "wildcard_"


@dataclass
class Corpus:
    id: str
    name: str
    shards: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Fixed:
    """An entry for one corpus: space-separated folders or patterns of paths."""

    id: str
    name: str
    paths: str

    def corpora(self, listing: Listing) -> Iterator[Corpus]:
        yield Corpus(self.id, self.name, shards(self.paths.split(), listing))


@dataclass(frozen=True)
class Wildcard:
    """An entry for a corpus at each path of a pattern; \\1 and so on in its id and name are groups of an expression that the path begins with."""

    id: str
    name: str
    found_by: str
    named_by: str

    def corpora(self, listing: Listing) -> Iterator[Corpus]:
        named = re.compile(self.named_by)
        matches = ((path, named.match(path)) for path in sorted(listing(self.found_by)))
        yield from (Corpus(m.expand(self.id), m.expand(self.name), shards([path], listing)) for path, m in matches if m)


def shards(patterns: list[str], listing: Listing = glob.glob) -> list[str]:
    """Sorted shard folders (shard=...) or files at patterns of paths, or below them."""
    places = [place for pattern in patterns for place in listing(pattern)]
    inside = {place: listing(os.path.join(place, "graphs", "shard=*")) or listing(os.path.join(place, "*.db")) or [place] for place in places}
    return sorted({shard for found in inside.values() for shard in found})


def entries(spec: dict) -> list[Fixed | Wildcard]:
    """The entries of a configuration: id -> {paths, name}, or wildcard_<id> -> {pathglob, pathre, name}."""
    return [Wildcard(key.removeprefix(_WILDCARD), e["name"], e["pathglob"], e["pathre"]) if key.startswith(_WILDCARD) else Fixed(key, e["name"], e["paths"]) for key, e in spec.items()]


def load(spec: dict, listing: Listing = glob.glob) -> dict[str, Corpus]:
    """Corpora by id; of entries that give one id the last counts."""
    return {c.id: c for entry in entries(spec) for c in entry.corpora(listing)}


def groups(corpora: dict[str, Corpus], spec: list[dict]) -> dict[str, list[Corpus]]:
    """Groups of a list of {name, corpora: space-separated expressions that ids begin with}; sorted by id, each once."""
    chosen = lambda g: re.compile("|".join(f"(?:{p})" for p in g["corpora"].split()) or r"(?!)")
    return {g["name"]: [c for i, c in sorted(corpora.items()) if chosen(g).match(i)] for g in spec}


def find(corpora: dict[str, Corpus], wanted: list[str]) -> list[Corpus]:
    """Corpora by id, else by name; unknown ones are left out."""
    by_name = {c.name: c for c in corpora.values()}
    return [c for w in wanted if (c := corpora.get(w) or by_name.get(w))]
