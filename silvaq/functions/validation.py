"""Checks and repairs of CoNLL-U rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.conllu import FIELDS
from .arrays import before, let

_ID = r"^(\d+|\d+-\d+|\d+\.\d+)$"


def _cut(line: Column, most: int = -1) -> Column:
    """The pieces of a line; most: the first ones are cut off, the last is what is left."""
    return F.when(F.contains(line, F.lit("\t")), F.split(line, "\t", most)).otherwise(F.split(F.trim(line), r"\s+", most))


def _lines(block: Column) -> Column:
    return F.filter(F.split(block, "\n"), lambda x: ~x.startswith("#") & (F.trim(x) != ""))


def fields(line: Column) -> Column:
    """Ten fields of a line: cut at tabs if it has any, else at white space; missing ones are _, further ones go."""
    return let(_cut(line), lambda c: F.array(*[F.coalesce(F.get(c, F.lit(i)), F.lit("_")) for i in range(len(FIELDS))]))


def _keys(df: DataFrame) -> list[str]:
    return [k for k in ("shard", "graph_id") if k in df.columns]


def _rows_of(block: Column, names) -> Column:
    """Array of row and the named fields of each line that is not a comment."""
    at = [FIELDS.index(n) for n in names]
    return F.transform(_lines(block), lambda x, i: let(_cut(x, max(at) + 2), lambda c: F.struct(i.alias("row"), *[F.coalesce(F.get(c, F.lit(k)), F.lit("_")).alias(FIELDS[k]) for k in at])))


def rows(blocks: DataFrame) -> DataFrame:
    """keys, row and the ten fields of each line that is not a comment. Lines are cut after they are exploded, which Spark compiles."""
    keys = _keys(blocks)
    each = blocks.select(*keys, F.posexplode(_lines(F.col("block"))).alias("row", "line")).select(*keys, "row", _cut(F.col("line")).alias("f"))
    return each.select(*keys, "row", *[F.coalesce(F.get("f", F.lit(i)), F.lit("_")).alias(n) for i, n in enumerate(FIELDS)])


def _exploded(r: DataFrame, names, body=lambda rs: rs) -> DataFrame:
    """keys and the fields of each element of body(the rows of a sentence: array of row and the named fields, in order).

    r: blocks, whose rows are seen to where they are, without a shuffle; or rows(), which are brought together first.
    """
    keys = _keys(r)
    if "block" in r.columns:
        found = let(_rows_of(F.col("block"), names), body)
    else:
        r = r.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("row", *names))).alias("r"))
        found = let(F.col("r"), body)
    return r.select(*keys, F.explode(found).alias("e")).select(*keys, "e.*")


def kind(id_: Column) -> Column:
    return F.when(id_.rlike(r"^\d+$"), "word").when(id_.rlike(r"^\d+-\d+$"), "multiword").when(id_.rlike(r"^\d+\.\d+$"), "empty").otherwise("wrong")


def surface(blocks: DataFrame, names=FIELDS) -> DataFrame:
    """Rows (with the named fields) of the surface tokens: multi-word tokens, and words that none covers."""
    return _exploded(blocks, list(dict.fromkeys(["id", *names])), _surface).select(*_keys(blocks), "row", *names)


def _surface(rs: Column) -> Column:
    """The rows (with row and id) of the surface tokens."""
    bound = lambda x, pattern: F.regexp_extract(x["id"], pattern, 1).cast("int")
    ranges = F.transform(F.filter(rs, lambda x: F.contains(x["id"], F.lit("-")) & (kind(x["id"]) == "multiword")), lambda x: F.struct(bound(x, r"^(\d+)-").alias("a"), bound(x, r"-(\d+)$").alias("b")))
    covered = lambda x, spans: F.exists(spans, lambda s: F.coalesce(x["id"].try_cast("int").between(s["a"], s["b"]), F.lit(False)))
    kept = lambda spans: F.filter(rs, lambda x: let(kind(x["id"]), lambda k: (k == "multiword") | ((k == "word") & ~covered(x, spans))))
    return let(ranges, kept)


def _feature_order(feats: Column) -> Column:
    names = F.transform(F.split(feats, r"\|"), lambda f: F.lower(F.substring_index(f, "=", 1)))
    return (feats != "_") & (F.array_sort(names) != names)


def _dep_order(deps: Column) -> Column:
    heads = F.transform(F.split(deps, r"\|"), lambda d: F.substring_index(d, ":", 1).try_cast("double"))
    return (deps != "_") & (F.array_sort(heads) != heads)


def field_issues(r: DataFrame) -> DataFrame:
    """keys, row, issue: what is wrong with single fields. r: blocks or rows(). Rows without features and DEPS are mostly right, which few tests tell."""
    if "block" in r.columns:
        r = _exploded(r, FIELDS)  # not rows(): a condition on these would be pushed to where lines are cut, and cut them once for each field
    repeated = lambda c: (F.col(c) != "_") & (F.size(F.array_distinct(F.split(c, r"\|"))) != F.size(F.split(c, r"\|")))
    tests = {
        "id": ~F.col("id").rlike(_ID),
        "head": ~F.col("head").rlike(r"^(\d+|_)$"),
        "feats form": (F.col("feats") != "_") & ~F.col("feats").rlike(r"^[^=|]+=[^=|]+(\|[^=|]+=[^=|]+)*$"),
        "feats order": _feature_order(F.col("feats")),
        "feats repeated": repeated("feats"),
        "deps form": (F.col("deps") != "_") & ~F.col("deps").rlike(r"^\d+(\.\d+)?:[^|]+(\|\d+(\.\d+)?:[^|]+)*$"),
        "deps order": _dep_order(F.col("deps")),
        "space": F.concat("id", "upos", "xpos", "feats", "head", "deprel", "deps").rlike(r"\s"),
        "empty": reduce(lambda a, b: a | b, (F.col(c) == "" for c in FIELDS)),
    }
    simple = [tests[n] for n in ("id", "head", "space", "empty")]
    r = r.where(reduce(lambda a, b: a | b, simple, (F.col("feats") != "_") | (F.col("deps") != "_")))
    found = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))
    return r.select(*_keys(r), "row", F.explode(found).alias("issue"))


def sentence_issues(r: DataFrame) -> DataFrame:
    """keys, issue: repeated ids, words out of sequence, heads and DEPS that lead nowhere. r: blocks or rows()."""

    def issues(rs: Column) -> Column:
        of = lambda *kinds: F.filter(rs, lambda x: x["kind"].isin(*kinds))
        ids = lambda a: F.transform(a, lambda x: x["id"])
        starts = lambda spans: F.transform(spans, lambda p: p[0].cast("int"))
        multiwords = F.transform(of("multiword"), lambda x: F.split(x["id"], "-"))
        known = F.concat(ids(of("word", "empty")), F.array(F.lit("0"), F.lit("_")))
        heads = F.transform(rs, lambda x: x["head"])
        deps = F.flatten(F.transform(F.filter(rs, lambda x: x["deps"] != "_"), lambda x: F.transform(F.split(x["deps"], r"\|"), lambda d: F.substring_index(d, ":", 1))))

        def tests(spans: Column, known: Column) -> Column:
            made = {
                "repeated id": F.size(F.array_distinct(ids(rs))) != F.size(rs),
                "words out of sequence": F.exists(F.transform(of("word"), lambda x, i: x["id"].cast("int") != i + 1), lambda x: x),
                "multiwords out of order": (F.array_sort(starts(spans)) != starts(spans)) | F.exists(spans, lambda p: p[0].cast("int") >= p[1].cast("int")),
                "unknown head": F.size(F.array_except(heads, known)) > 0,
                "unknown deps": F.size(F.array_except(deps, known)) > 0,
            }
            return F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in made.items()]))

        return let(multiwords, lambda spans: let(known, lambda k: tests(spans, k)))

    told = lambda rs: F.transform(rs, lambda x: F.struct(x["id"].alias("id"), kind(x["id"]).alias("kind"), x["head"].alias("head"), x["deps"].alias("deps")))
    found = lambda rs: F.transform(let(told(rs), issues), lambda name: F.struct(name.alias("issue")))
    return _exploded(r, ["id", "head", "deps"], found)


def repaired(r: DataFrame, names=FIELDS) -> DataFrame:
    """Rows (with the named fields) with the first of each repeated id, wrong fields as _, and DEPS that lead nowhere left out. r: blocks or rows()."""
    needed = list(dict.fromkeys(["id", "head", "deps", *names]))

    def first(rs: Column) -> Column:
        pairs = F.sort_array(F.transform(rs, lambda x, i: F.struct(x["id"].alias("id"), i.alias("i"))))
        again = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i > 0) & (F.get(s, i - 1)["id"] == x["id"]), x["i"])), lambda i: i.isNotNull())
        few = lambda gone: F.filter(rs, lambda x, i: ~F.array_contains(gone, i))
        some = F.size(F.array_distinct(F.transform(rs, lambda x: x["id"]))) != F.size(rs)
        return F.filter(F.when(some, let(pairs, lambda s: let(again(s), few))).otherwise(rs), lambda x: x["id"].rlike(_ID))

    def mended(rs: Column) -> Column:
        nodes = F.transform(F.filter(rs, lambda x: ~F.contains(x["id"], F.lit("-"))), lambda x: x["id"])  # ids are right here
        cut = lambda x: F.filter(F.split(x["deps"], r"\|"), lambda d: d.rlike(r"^\d+(\.\d+)?:.+$"))
        ref = lambda d: F.substring_index(d, ":", 1)
        named = F.concat(F.transform(rs, lambda x: x["head"]), F.flatten(F.transform(F.filter(rs, lambda x: x["deps"] != "_"), lambda x: F.transform(F.split(x["deps"], r"\|"), ref))))
        lost = F.array_except(named, F.concat(nodes, F.array(F.lit("0"))))

        def one(x: Column, lost: Column) -> Column:
            deps = F.array_join(F.filter(cut(x), lambda d: ~F.array_contains(lost, ref(d))), "|")
            good = lambda: x["feats"].rlike(r"^[^=|]+=[^=|]+(\|[^=|]+=[^=|]+)*$")
            made = {
                "head": lambda: F.when(x["head"].rlike(r"^\d+$") & ~F.array_contains(lost, x["head"]), x["head"]).otherwise("_"),
                "feats": lambda: F.when((x["feats"] != "_") & good(), x["feats"]).otherwise("_"),
                "deps": lambda: F.when((x["deps"] != "_") & (deps != ""), deps).otherwise("_"),
            }
            return F.struct(x["row"].alias("row"), *[(made[c]() if c in made else F.when(x[c] == "", "_").otherwise(x[c])).alias(c) for c in names])

        return let(lost, lambda gone: F.transform(rs, lambda x: one(x, gone)))

    return _exploded(r, needed, lambda rs: let(first(rs), mended))


def features(r: DataFrame) -> DataFrame:
    """keys, row, name, value of each feature; values such as a,b count singly. r: blocks or rows()."""
    r = _exploded(r, ["feats"], lambda rs: F.filter(rs, lambda x: x["feats"] != "_")) if "block" in r.columns else r
    keys = _keys(r)
    pairs = r.where("feats <> '_'").select(*keys, "row", F.explode(F.split("feats", r"\|")).alias("f"))
    return pairs.select(*keys, "row", F.substring_index("f", "=", 1).alias("name"), F.explode(F.split(F.regexp_replace("f", "^[^=]*=", ""), ",")).alias("value"))


def dependencies(r: DataFrame) -> DataFrame:
    """keys, row, head, deprel of each dependency, the basic one and those of DEPS; each once in a row. r: blocks or rows()."""
    distinct = "block" not in r.columns
    r = r if distinct else rows(r)

    def of(x: Column) -> Column:
        one = lambda head, deprel: F.struct(x["row"].alias("row"), head.alias("head"), deprel.alias("deprel"))
        none = F.array().cast("array<struct<row:int,head:string,deprel:string>>")
        basic = F.when(x["head"] != "_", F.array(one(x["head"], x["deprel"]))).otherwise(none)
        more = lambda: F.transform(F.split(x["deps"], r"\|"), lambda d: one(F.substring_index(d, ":", 1), F.regexp_replace(d, "^[^:]*:", "")))
        return F.when(x["deps"] == "_", basic).otherwise(F.array_distinct(F.concat(basic, more())))

    each = r.select(*_keys(r), F.explode(of({c: F.col(c) for c in ("row", "head", "deprel", "deps")})).alias("e")).select(*_keys(r), "e.*")
    return each.distinct() if distinct else each


def spans(blocks: DataFrame) -> DataFrame:
    """keys, row, start, end, form of each surface token in the sentence's text, tokens by spaces."""

    def placed(rs: Column) -> Column:
        sizes = before(F.transform(rs, lambda x: F.char_length(x["form"]) + 1))
        one = lambda x, start: F.struct(x["row"].alias("row"), start.alias("start"), (start + F.char_length(x["form"])).alias("end"), x["form"].alias("form"))
        return let(sizes, lambda s: F.transform(rs, lambda x, i: one(x, F.get(s, i))))

    return _exploded(blocks, ["id", "form"], lambda rs: let(_surface(rs), placed))


def styles(blocks: DataFrame) -> DataFrame:
    """keys, target, style, value of the visual-style comments; target: an id, a pair of ids, or the wildcard nodes or arcs."""
    keys = _keys(blocks)
    marks = F.filter(F.split("block", "\n"), lambda x: x.rlike(r"^# *visual-style\s"))
    each = blocks.select(*keys, F.explode(marks).alias("m")).withColumn("t", F.regexp_replace("m", r"^# *visual-style\s+", ""))
    return each.select(*keys, F.regexp_extract("t", r"^(.*?)\s+[^\s:]+:[^:]*$", 1).alias("target"), F.regexp_extract("t", r"\s([^\s:]+):[^:]*$", 1).alias("style"), F.regexp_extract("t", r":([^:]*)$", 1).alias("value"))
