"""The engine: searches sentence tables with patterns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import hits as H
from .plans import ast, bracketed, nested, relational
from .plans.parser import parse
from .plans.prune import levels, required
from .plans.resolve import Symbols, resolve
from .plans.resolve import load as load_symbols
from .sources import fixtures, postings
from .sources.postings import merge

#: Sentences that a service returns when not told, and at most; context at most.
DEFAULT, MOST, WIDEST = 1000, 100_000, 10


def _there(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


class Engine:
    """Sentences with, if there are, their texts, postings and symbols. Searches use postings where there are any.

    graphs: (shard,) graph_id, n, tokens. text: keys, comments, lines (read for hits only). index: postings, for skipping sentences that lack a
    term. symbols: what bare words mean. source: for graphs without the column tokens, what their tokens follow from.
    flat: for searches by joins, tokens and edges of graphs; by default fixtures.flat().
    """

    def __init__(self, graphs: DataFrame, text: DataFrame | None = None, index: DataFrame | None = None, symbols: Symbols | None = None, source: nested.Source = nested.stored, flat: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None):
        self.flat = flat or (lambda graphs: fixtures.flat(graphs, source))
        self.graphs, self.text, self.index, self.symbols, self.source = graphs, text, index, symbols, source

    @classmethod
    def load(cls, spark: SparkSession, paths: Sequence[str], shards: Sequence[str] | None = None, symbols: Symbols | str | None = "own") -> Engine:
        """Indexes that write_index() has written, with their postings; texts where all have them. shards prune partitions. symbols: by default those of the indexes; None: none."""

        def part(name: str) -> DataFrame | None:
            found = [spark.read.parquet(f"{p}/{name}") for p in paths if _there(spark, f"{p}/{name}")]
            if len(found) < len(paths):
                return None
            out = reduce(DataFrame.unionByName, found)
            return out if shards is None or "shard" not in out.columns else out.where(F.col("shard").isin(list(shards)))

        if symbols == "own":
            stats = part("symbols")
            symbols = None if stats is None else load_symbols(merge(stats))
        return cls(part("graphs"), part("text"), part("postings"), symbols)

    def tree(self, pattern: str | ast.Node) -> ast.Node:
        return resolve(parse(pattern) if isinstance(pattern, str) else pattern, self.symbols)

    def hits(self, pattern: str | ast.Node | Callable[[Engine], DataFrame], *, insensitive: bool = False, require_edge: bool = True, how: str = "nested", pruned: bool | None = None) -> DataFrame:
        """keys, tok. pattern: text, a tree, or a function of the engine that returns such rows. how: nested or relational. pruned: by postings or not; by default
        where the engine has them."""
        if callable(pattern):
            return pattern(self)
        tree = self.tree(pattern)
        graphs = self._candidates(tree, insensitive, pruned)
        if how == "nested":
            return nested.hits(graphs, tree, insensitive=insensitive, require_edge=require_edge, source=self.source)
        tokens, edges = self.flat(graphs)
        keys = tuple(k for k in ("shard", "graph_id") if k in graphs.columns)
        return relational.hits(tokens, edges, tree, keys=keys, insensitive=insensitive, require_edge=require_edge)

    def _candidates(self, tree: ast.Node, insensitive: bool, pruned: bool | None) -> DataFrame:
        if pruned and self.index is None:
            raise ValueError("an engine without postings cannot prune by them")
        if self.index is None or pruned is False:
            return self.graphs
        return postings.candidates(self.graphs, self.index, required(tree), insensitive=insensitive)

    def grouped(self, pattern: str | ast.Node | Callable[[Engine], DataFrame], *, insensitive: bool = False) -> DataFrame:
        """keys, toks of each sentence with hits."""
        if callable(pattern):
            return H.group(pattern(self))
        tree = self.tree(pattern)
        return nested.grouped(self._candidates(tree, insensitive, None), tree, insensitive=insensitive, source=self.source)

    def together(self, patterns: dict[str, str | ast.Node], *, insensitive: bool = False) -> DataFrame:
        """keys, and for each name the tokens of a sentence that its pattern finds, of all sentences in one pass. For searches written as functions."""
        return nested.together(self.graphs, {name: self.tree(p) for name, p in patterns.items()}, insensitive=insensitive, source=self.source)

    def search(self, pattern, *, insensitive: bool = False, limit: int = DEFAULT, context: int = 0, same_document: bool = False, shuffle: int | None = None) -> DataFrame:
        """keys, block: annotated CoNLL-U of the hit sentences. limit: at most MOST; 0 finds nothing more than MOST either."""
        limit = min(limit or MOST, MOST)
        grouped = self.grouped(pattern, insensitive=insensitive)
        grouped = grouped.transform(H.shuffled, shuffle).limit(limit) if shuffle is not None else H.first(grouped, limit)
        around = None
        if context:
            sentences = self.text.withColumn("text", H.sentence_text(F.col("lines")))
            around = H.context(grouped, sentences, min(context, WIDEST), same_document=same_document)
        return H.annotated(grouped, self.text, around)

    def batch(self, lines, *, limit: int = 5, **options) -> list[tuple[str, DataFrame]]:
        """(name, result of search()) of each construction in a file of names and bracketed constructions."""
        return [(name, self.search(tree, limit=limit, **options)) for name, tree in bracketed.read_batch(lines)]

    def explain(self, pattern: str, mode: str = "ast") -> str:
        """The tree of a pattern, its sets by level with what sentences need (plan), needed terms alone (required), or Spark's plan (mode formatted, codegen, cost...)."""
        tree = self.tree(pattern)
        if mode == "ast":
            return ast.show(tree)
        if mode == "plan":
            return "\n".join(f"{level} {'must' if must else 'may '} {text}" for level, must, text in levels(tree))
        if mode == "required":
            return ", ".join(f"{k}:{t}" for k, t in required(tree))
        df = self.hits(pattern)
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
