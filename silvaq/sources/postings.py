"""The inverted index and vocabulary statistics of sentences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, span

KEYS = ("shard", "graph_id")
#: Share of sentences from which a term is too frequent to choose sentences by.
FREQUENT = 0.2


#: What an index is made of, and the fields of tokens that each kind is made from.
FIELDS = {"token": ("idx", "form", "form_norm"), "lemma": ("idx", "lemma", "lemma_norm"), "tag": ("idx", "tags"), "rel": ("idx", "out")}
ALL = tuple(FIELDS)


def postings(graphs: DataFrame, kinds=ALL) -> DataFrame:
    """kind, term, norm, shard, graph_id, positions: where each form, lemma, tag and relation (by governor) stands in each sentence.

    norm 1: a lower-cased form or cleaned lemma, only where it differs. kinds: others are not made. A sentence's entries are grouped in its row, so nothing is shuffled.
    """
    keys = [k for k in KEYS if k in graphs.columns]
    pair = lambda term, idx: F.struct(term.alias("term"), idx.alias("idx"))
    field = lambda name: F.filter(F.transform("tokens", lambda x: pair(x[name], x["idx"])), lambda p: p["term"].isNotNull())
    tags = lambda: F.flatten(F.transform("tokens", lambda x: F.transform(x["tags"], lambda t: pair(t, x["idx"]))))
    out = lambda edges, x: F.transform(edges, lambda e: pair(e["d"], x["idx"]))
    relations = lambda: F.flatten(F.transform("tokens", lambda x: out(x["out"], x)))
    basic = lambda: F.transform(F.filter("tokens", lambda x: F.exists(x["out"], lambda e: e["basic"])), lambda x: pair(F.lit("anyrel"), x["idx"]))
    made = {
        "token": lambda: [(field("form"), 0), (field("form_norm"), 1)], "lemma": lambda: [(field("lemma"), 0), (field("lemma_norm"), 1)],
        "tag": lambda: [(tags(), 0)], "rel": lambda: [(relations(), 0), (basic(), 0)],
    }

    def grouped(pairs: Column, kind: str, norm: int) -> Column:
        def cut(s: Column) -> Column:
            """Groups of sorted pairs, from where each term begins."""
            n = F.size(s)
            begins = F.filter(span(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i)["term"] != F.get(s, i - 1)["term"]))
            places = lambda i, end: F.array_distinct(F.transform(F.slice(s, i + 1, end - i), lambda p: p["idx"]))
            return let(begins, lambda b: F.transform(b, lambda i, k: F.struct(F.lit(kind).alias("kind"), F.get(s, i)["term"].alias("term"), F.lit(norm).alias("norm"), places(i, F.coalesce(F.get(b, k + 1), n)).alias("positions"))))

        return let(F.sort_array(pairs), cut)

    every = F.concat(*[grouped(pairs, kind, norm) for kind in kinds for pairs, norm in made[kind]()])
    return graphs.select(*keys, F.explode(every).alias("e")).select("e.kind", "e.term", "e.norm", *keys, "e.positions")


def symbols(graphs: DataFrame) -> DataFrame:
    """symbol, s_type, full_form, cnt: how often each tag, category, value and relation occurs.

    Tokens are counted by tag and features first, and what these stand for is added up from the counts.
    """
    entry = lambda symbol, kind, full=None: F.struct(symbol.alias("symbol"), F.lit(kind).alias("s_type"), (F.lit(None).cast("string") if full is None else full).alias("full_form"))
    feature = lambda f: F.when(f.contains("="), F.array(entry(F.substring_index(f, "=", 1), "CAT"), entry(F.regexp_replace(f, "^[^=]*=", ""), "VAL", f), entry(f, "CAT=VAL"))).otherwise(F.array(entry(f, "CAT=VAL")))
    none = F.array().cast("array<struct<symbol:string,s_type:string,full_form:string>>")
    tag = F.when(F.col("upos") != "_", F.array(entry(F.col("upos"), "TAG")))
    features = F.when(F.col("feats") != "_", F.flatten(F.transform(F.split("feats", r"\|"), feature)))
    kinds = graphs.select(F.explode(F.transform("tokens", lambda x: F.struct(x["upos"].alias("upos"), x["feats"].alias("feats")))).alias("x")).groupBy("x.upos", "x.feats").agg(F.count("*").alias("k"))
    tags = kinds.select("k", F.explode(F.concat(F.coalesce(tag, none), F.coalesce(features, none))).alias("s")).select("s.*", "k")
    names = graphs.select(F.explode(F.flatten(F.transform("tokens", lambda x: F.transform(x["out"], lambda e: e["d"])))).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("k"))
    relations = names.select("symbol", F.lit("DTYPE").alias("s_type"), F.lit(None).cast("string").alias("full_form"), "k")
    return tags.union(relations).groupBy("symbol", "s_type", "full_form").agg(F.sum("k").alias("cnt"))


def merge(*stats: DataFrame) -> DataFrame:
    """Statistics of several corpora as one."""
    out = stats[0]
    for s in stats[1:]:
        out = out.unionByName(s)
    return out.groupBy("symbol", "s_type", "full_form").agg(F.sum("cnt").alias("cnt"))


def ordered(stats: DataFrame) -> DataFrame:
    """symbol, forms: the entries of a symbol, the most frequent first."""
    entry = F.struct((-F.col("cnt")).alias("neg"), F.coalesce("full_form", F.lit("")).alias("full_form"), "s_type")
    return stats.groupBy("symbol").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda e: F.struct(e["s_type"].alias("s_type"), e["full_form"].alias("full_form"), (-e["neg"]).alias("cnt"))).alias("forms"))


def argmax(stats: DataFrame) -> DataFrame:
    """symbol, full_form: the most frequent full form of each value; ties go to the first by name."""
    return stats.where("s_type = 'VAL'").groupBy("symbol").agg(F.min(F.struct((-F.col("cnt")).alias("neg"), "full_form")).alias("b")).select("symbol", "b.full_form")


def candidates(graphs: DataFrame, index: DataFrame, terms, *, insensitive: bool = False) -> DataFrame:
    """Sentences that have all terms (kind, term), by semi-joins with the index, the rarest term first. insensitive: in either spelling.

    Sizes decide: the terms' numbers of sentences are counted in one pass over the terms' postings, and joins go in their order. Terms that more than
    FREQUENT of all sentences have spare less than their join costs; these are left to the evaluation.
    """
    if not terms:
        return graphs
    keys = [k for k in KEYS if k in graphs.columns]
    # Plain comparisons, which reach the files' statistics and bloom filters.
    wanted = reduce(lambda a, b: a | b, ((F.col("kind") == k) & (F.col("term") == t) for k, t in terms))
    found = index.where(wanted if insensitive else wanted & (F.col("norm") == 0))
    counts = {(r["kind"], r["term"]): r["count"] for r in found.groupBy("kind", "term").count().collect()}
    most = FREQUENT * graphs.count() if max(counts.values(), default=0) else 0  # the number of rows is in the files' footers
    terms = [t for t in terms if counts.get(t, 0) <= most]
    for kind, term in sorted(terms, key=lambda t: counts.get(t, 0)):
        graphs = graphs.join(found.where((F.col("kind") == kind) & (F.col("term") == term)).select(*keys), keys, "left_semi")
    return graphs
