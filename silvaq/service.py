"""The search as a web service, and its client. Standard library only.

    from wsgiref.simple_server import make_server
    make_server("", 8080, Service(spark, corpora_spec, group_spec)).serve_forever()
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import parse_qs, urlencode

from pyspark.sql import SparkSession

from . import corpora as catalog
from .engine import DEFAULT, Engine
from .plans.ast import ExpressionError

HELP = """/ takes search (a pattern), db (corpora by id or name, comma-separated), retmax (sentences at most), context (sentences around each),
i or case=false (either spelling), shuffle (shards in a drawn order), dl (as a download).
/metadata lists the groups of corpora.
"""


class Service:
    """A WSGI application over a catalog. Results are annotated CoNLL-U in lines of text, sent as they are read."""

    def __init__(self, spark: SparkSession, spec: dict, groups: list[dict] = (), *, listing: catalog.Listing | None = None, open_index: Callable[[SparkSession, list[str]], Engine] | None = None):
        self.spark, self.spec, self.groups = spark, spec, groups
        self.options = {} if listing is None else {"listing": listing}
        self.open_index = open_index or _open

    def __call__(self, environ: dict, start_response) -> Iterable[bytes]:
        asked = {k: v[-1] for k, v in parse_qs(environ.get("QUERY_STRING", ""), keep_blank_values=True).items()}
        path = environ.get("PATH_INFO", "/").rstrip("/")
        status, kind, extra = "200 OK", "text/plain; charset=utf-8", []
        if path == "/metadata":
            kind, body = "application/json", [json.dumps(self.metadata()).encode()]
        elif path:
            status, body = "404 Not Found", [HELP.encode()]
        elif "search" not in asked:
            body = [HELP.encode()]
        else:
            try:
                body = self.lines(asked)
                if "dl" in asked:
                    extra = [("Content-Disposition", "attachment; filename=result.conllu")]
            except ExpressionError as wrong:
                body = [f"# Error in query: {wrong}\n".encode()]
            except ValueError as wrong:
                status, body = "400 Bad Request", [f"{wrong}\n".encode()]
        start_response(status, [("Content-Type", kind), *extra])
        return body

    def metadata(self) -> dict:
        known = catalog.load(self.spec, **self.options)
        return {"corpus_groups": [{"name": name, "corpora": [[c.id, c.name] for c in members]} for name, members in catalog.groups(known, list(self.groups)).items()]}

    def lines(self, asked: dict[str, str]) -> Iterator[bytes]:
        """The result of a request; raises before the first line where the request is wrong."""
        number = {}
        for name, default in (("retmax", DEFAULT), ("context", 0)):
            try:
                number[name] = max(0, int(asked.get(name, default)))
            except ValueError:
                raise ValueError(f"{name} is a number") from None
        shards = [s for c in catalog.find(catalog.load(self.spec, **self.options), asked.get("db", "").split(",")) for s in c.shards]
        if not shards:
            return iter([b"# No such corpus\n"])
        found = self.open_index(self.spark, shards).search(
            asked["search"], insensitive="i" in asked or asked.get("case", "").lower() == "false", limit=number["retmax"], context=number["context"], shuffle=0 if "shuffle" in asked else None
        )
        return (f"{row['block']}\n".encode() for row in found.toLocalIterator())


def _open(spark: SparkSession, shards: list[str]) -> Engine:
    """Indexes of shard folders <index>/graphs/shard=<name>, each with the shards asked for."""
    names: dict[str, list[str]] = {}
    for s in shards:
        index, _, name = s.rpartition("/graphs/shard=")
        names.setdefault(index or s, []).append(name)
    wanted = sorted({n for some in names.values() for n in some if n})
    return Engine.load(spark, sorted(names), shards=wanted or None)


def ask(url: str, search: str, db: str, **options) -> Iterator[str]:
    """The lines that a service at url answers with. options: retmax, context, i, shuffle."""
    with urllib.request.urlopen(f"{url}?{urlencode({'search': search, 'db': db} | options)}") as answer:
        for line in answer:
            yield line.decode().rstrip("\n")
