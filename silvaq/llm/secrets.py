"""Secret scans. DataFrame functions only.

Three fixed patterns give base spans: assignments, access keys and hex strings. The method adds spans: runs of identifier
characters that a character Markov model of random strings explains better than one of ordinary identifiers, by log-likelihood
ratio. Both models are counted from labelled samples in the corpus: what the patterns find, without its key word, is random; runs of letters,
signs and few digits that no pattern touches are ordinary.

SQL has no function for the places of all matches. They come from the lengths of what a split by the pattern leaves and of the
matches: running sums in blocks, so that a text with many matches costs little more than their number.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# The patterns and limits of the base spans.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE = 12

#: Runs that the method judges.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: Log odds that the method asks for, and the mean over a run's characters.
ODDS, MEAN = 12.0, 0.25
BLOCK = 256
CODES = 128


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, op) -> Column:
    """op over all elements up to and with each element of an array of non-negative integers; op(0, x) is x.

    Blocks are folded first, then the blocks before each block, then each block's elements up to its own.
    """
    fold = lambda a: F.aggregate(a, F.lit(0), op)
    blocks = lambda v: F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / BLOCK).cast("int")), lambda b: fold(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))).otherwise(F.array().cast("array<int>"))
    before = lambda bs: F.transform(bs, lambda _, b: fold(F.slice(bs, F.lit(1), b)))

    def all_of(v):
        each = lambda bf: F.transform(v, lambda _, i: op(F.get(bf, (i / BLOCK).cast("int")), fold(F.slice(v, (i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1))))
        return _let(blocks(v), lambda bs: _let(before(bs), each))

    return _let(values, all_of)


def _places(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of the leftmost non-overlapping matches; code points, end exclusive."""
    return F.when(text.rlike(pattern), F.struct(F.transform(F.split(text, pattern, -1), F.char_length).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")))


def _ends(raw: Column) -> Column:
    """The end of each match that _places has found."""
    return _running(F.transform(raw["found"], lambda m, i: F.get(raw["gaps"], i) + F.char_length(m)), lambda x, y: x + y)


def _with_spans(docs: DataFrame, name: str, text: Column, pattern: str) -> DataFrame:
    """Adds column `name`: array<struct<start, end, found>>; null where nothing matches."""
    docs = docs.withColumn("silvaq_raw", _places(text, pattern))
    docs = docs.withColumn("silvaq_ends", F.when(F.col("silvaq_raw").isNotNull(), _ends(F.col("silvaq_raw"))))
    struct = lambda m, e: F.struct((e - F.char_length(m)).alias("start"), e.alias("end"), m.alias("found"))
    return docs.withColumn(name, F.zip_with("silvaq_raw.found", "silvaq_ends", struct)).drop("silvaq_raw", "silvaq_ends")


PARTS = tuple(f"silvaq_{k}" for k in KINDS)


def annotate(docs: DataFrame) -> DataFrame:
    """Adds the base spans and the runs to judge, as columns PARTS."""
    text = F.coalesce(F.col("text"), F.lit(""))
    for name, pattern in zip(PARTS, (ASSIGN, ACCESS, HEX, RUN), strict=True):
        docs = _with_spans(docs, name, text, pattern)
    value = lambda s: F.regexp_extract(s["found"], ASSIGN, 2)
    return docs.withColumn(PARTS[0], F.filter(PARTS[0], lambda s: F.char_length(value(s)) >= ASSIGN_VALUE))


def _apart(run: Column) -> Column:
    """Whether a run overlaps no base span."""
    meets = lambda part: F.coalesce(F.exists(part, lambda b: (b["start"] < run["end"]) & (b["end"] > run["start"])), F.lit(False))
    return ~(meets(PARTS[0]) | meets(PARTS[1]) | meets(PARTS[2]))


def _codes(token: Column) -> Column:
    return F.transform(F.split(token, ""), F.ascii)


def train(found: DataFrame) -> str | None:
    """The log-likelihood ratio of each pair of characters, random over ordinary, as a JSON array; None without samples of both.

    Counts are made over all samples in the corpus; at most CODES x CODES x 2 counts reach the driver.
    """
    none = F.array().cast("array<string>")
    secret = F.concat(
        F.coalesce(F.transform(PARTS[0], lambda s: F.regexp_extract(s["found"], ASSIGN, 2)), none),
        F.coalesce(F.transform(PARTS[1], lambda s: s["found"]), none),
        F.coalesce(F.transform(PARTS[2], lambda s: s["found"]), none),
    )
    plain = lambda r: (F.char_length(F.regexp_replace(r["found"], "[^0-9]+", "")) * 10 < F.char_length(r["found"])) & _apart(r)
    ordinary = F.coalesce(F.transform(F.filter(PARTS[3], plain), lambda r: r["found"]), none)
    labelled = lambda tokens, y: F.transform(tokens, lambda t: F.struct(F.lit(y).alias("y"), t.alias("t")))
    samples = found.where(F.size(F.concat(secret, ordinary)) > 0).select(F.explode(F.concat(labelled(secret, 1), labelled(ordinary, 0))).alias("s"))
    codes = samples.select(F.col("s.y").alias("y"), _codes(F.col("s.t")).alias("c"))
    n = F.size("c") - 1
    pairs = F.zip_with(F.slice("c", F.lit(1), n), F.slice("c", F.lit(2), n), lambda a, b: a * CODES + b)
    counts = codes.where(F.size("c") > 1).select("y", F.explode(pairs).alias("pair")).where((F.col("pair") >= 0) & (F.col("pair") < CODES * CODES)).groupBy("y", "pair").count()
    seen = [[[0.0] * CODES for _ in range(CODES)] for _ in range(2)]
    for r in counts.collect():
        seen[r["y"]][r["pair"] // CODES][r["pair"] % CODES] += r["count"]
    if not all(any(map(any, side)) for side in seen):
        return None
    letters = {x for side in seen for a in range(CODES) for b in range(CODES) if side[a][b] for x in (a, b)}
    weight = 0.5 * len(letters)
    rows = []
    for side in seen:  # a pair's rate, drawn to that of its second character, which in turn is drawn to an even one
        n = sum(map(sum, side))
        alone = [(sum(side[a][b] for a in range(CODES)) + 0.5) / (n + weight) for b in range(CODES)]
        rows.append([[(side[a][b] + weight * alone[b]) / (sum(side[a]) + weight) for b in range(CODES)] for a in range(CODES)])
    return json.dumps([round(math.log(rows[1][a][b] / rows[0][a][b]), 4) for a in range(CODES) for b in range(CODES)])


def ratio(token: Column, model: str) -> Column:
    """Sum of a token's log-likelihood ratios."""
    table = F.from_json(F.lit(model), "array<double>")

    def total(c):
        n = F.size(c) - 1
        each = F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(2), n), lambda a, b: F.coalesce(F.get(table, a * CODES + b), F.lit(0.0)))
        return F.aggregate(each, F.lit(0.0), lambda x, y: x + y)

    return _let(_codes(token), total)


def spans(model: str | None) -> Column:
    """All spans of an annotated row: array<struct<start, kind, end>>, sorted by start and kind (its place in KINDS).

    A run that the method picks is left out where a base span overlaps it."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    shape = lambda part, kind: F.coalesce(F.transform(part, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))), empty)
    parts = [shape(p, k) for k, p in enumerate(PARTS[:3])]
    if model is not None:
        judged = F.filter(PARTS[3], lambda s: _apart(s) & _let(ratio(s["found"], model), lambda r: (r >= ODDS) & (r >= MEAN * (F.char_length(s["found"]) - 1))))
        parts.append(shape(judged, 3))
    return F.array_sort(F.concat(*parts))


def joined(all_spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(all_spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each document.

    Null and empty text: no spans. Repeated rows and null doc_ids are rows like any other; without rows the result is empty;
    other columns are ignored.
    """
    found = stored(annotate(docs.select("doc_id", "text")).drop("text"), "secrets")
    every = found.withColumn("every", spans(train(found)))
    base = F.filter("every", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("every", lambda s: s["kind"] == k)).cast("long")
    return every.select(
        F.col("doc_id").cast("long").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("every")).alias("spans")
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with each secret in text replaced; spans that overlap become one. Columns stay, n_chars (if there) follows the text.

    Texts without secrets, null and empty texts among them, do not change. Repeated rows and null doc_ids are rows like any other; without rows the
    result is empty; other columns come along, whatever their names.
    """
    model = train(stored(annotate(docs.select("text")).drop("text"), "secrets"))
    every = annotate(docs.select(F.struct(*docs.columns).alias("row"), "text")).withColumn("every", spans(model))
    # Before each span, what lies behind the end of all spans before it is kept; so is what lies behind the last.
    every = every.withColumn("ends", F.concat(F.array(F.lit(0)), _running(F.transform("every", lambda s: s["end"]), lambda x, y: F.greatest(x, y))))
    between = F.transform("ends", lambda e, i: F.struct(e.alias("from"), F.coalesce(F.get("every", i)["start"], F.char_length("text")).alias("to")))
    pieces = F.filter(between, lambda k: k["to"] > k["from"])
    clean = F.transform(pieces, lambda k: F.substring(F.col("text"), k["from"] + 1, k["to"] - k["from"]))
    first_hidden = F.get("every", F.lit(0))["start"] == 0
    last_hidden = F.array_max("ends") >= F.char_length("text")
    text = F.concat(F.when(first_hidden, F.lit(mark)).otherwise(F.lit("")), F.array_join(clean, mark), F.when(last_hidden & (F.size(clean) > 0), F.lit(mark)).otherwise(F.lit("")))
    out = every.withColumn("text", F.when(F.size("every") > 0, text).otherwise(F.col("text")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("every") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
