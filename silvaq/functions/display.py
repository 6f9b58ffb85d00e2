"""What a tree is drawn from: text, spans, attributes, relations, notes, styles and labels of CoNLL-U sentences, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .validation import dependencies, features, kind, rows, surface

#: Forms of these letters alone are written from the right. A fixed value.
RIGHT_TO_LEFT = "^[\\u0591-\\u07FF\\uFB1D-\\uFDFD\\uFE70-\\uFEFC]+$"
_STYLE = r"^# *visual-style\s+"


def shown(form: Column) -> Column:
    """A form as it is drawn: letters written from the right are turned round."""
    return F.when(form.rlike(RIGHT_TO_LEFT), F.reverse(form)).otherwise(form)


def _keys(df: DataFrame) -> list[str]:
    return [c for c in ("shard", "graph_id") if c in df.columns]


def words(blocks: DataFrame) -> DataFrame:
    """Rows of the words; no multi-word tokens."""
    return rows(blocks).where(kind(F.col("id")) == "word")


def text(blocks: DataFrame) -> DataFrame:
    """keys, text: the words by spaces; if the surface tokens read otherwise, these in a second line."""
    line = lambda r, name: r.groupBy(*_keys(r)).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "form"))), lambda x: shown(x["form"])), " ").alias(name))
    both = line(words(blocks), "a").join(line(surface(blocks), "b"), _keys(blocks))
    return both.select(*_keys(blocks), F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.concat_ws("\n", "a", "b")).alias("text"))


def entities(blocks: DataFrame) -> DataFrame:
    """keys, id, upos, start, end of each word in the text's first line."""
    w = words(blocks)
    g = w.groupBy(*_keys(w)).agg(F.sort_array(F.collect_list(F.struct("row", "id", "upos", F.char_length("form").alias("n")))).alias("w"))
    before = lambda i: F.aggregate(F.slice("w", F.lit(1), i), F.lit(0), lambda a, y: a + y["n"] + 1)
    each = g.select(*_keys(w), F.explode(F.transform("w", lambda x, i: F.struct(x["id"].alias("id"), x["upos"].alias("upos"), before(i).alias("start"), x["n"].alias("n")))).alias("x"))
    return each.select(*_keys(w), "x.id", "x.upos", "x.start", (F.col("x.start") + F.col("x.n")).alias("end"))


def attributes(blocks: DataFrame) -> DataFrame:
    """keys, id, name, value of the words' features."""
    w = words(blocks)
    return features(w).join(w.select(*_keys(w), "row", "id"), [*_keys(w), "row"]).select(*_keys(w), "id", "name", "value")


def relations(blocks: DataFrame) -> DataFrame:
    """keys, head, dependent, label of each dependency between words, basic and in DEPS; each once."""
    w = words(blocks)
    at = [*_keys(w), "row"]
    named = dependencies(w).join(w.select(*at, F.col("id").alias("dependent")), at)
    heads = w.select(*_keys(w), F.col("id").alias("head")).distinct()
    return named.where("head <> '0'").join(heads, [*_keys(w), "head"]).select(*_keys(w), "head", "dependent", F.col("deprel").alias("label")).distinct()


def notes(blocks: DataFrame) -> DataFrame:
    """keys, id, note: each word's lemma, and its other tag and remarks where it has some."""
    w = words(blocks)
    told = lambda name, c: F.when(F.col(c) != "_", F.concat(F.lit(f"{name}: "), F.col(c)))
    each = F.array_compact(F.array(F.concat(F.lit("Lemma: "), F.col("lemma")), told("Postag", "xpos"), told("Misc", "misc")))
    return w.select(*_keys(w), "id", F.explode(each).alias("note"))


def labels(blocks: DataFrame) -> DataFrame:
    """keys, label: what the last sentence-label comment says."""
    said = F.transform(F.filter(F.split("block", "\n"), lambda x: x.rlike(r"^# *sentence-label\b")), lambda x: F.trim(F.regexp_replace(x, r"^# *sentence-label", "")))
    return blocks.select(*_keys(blocks), F.get(said, F.size(said) - 1).alias("label")).where("label IS NOT NULL")


def resolved_styles(blocks: DataFrame) -> DataFrame:
    """keys, target, style, value: a style of a word (its id) or of a dependency (head, dependent and label by spaces).

    A comment is "# visual-style", what it is for and the style, a value with a key or a colour alone: of dependencies the colour, of words that behind them.
    nodes and arcs stand for all words and all dependencies whose style of that key no comment of their own sets; of several such the first counts.
    """
    keys = _keys(blocks)
    marks = F.filter(F.split("block", "\n"), lambda x: x.rlike(_STYLE))
    each = blocks.select(*keys, F.posexplode(marks).alias("place", "m")).withColumn("m", F.regexp_replace("m", _STYLE, "")).where(F.col("m").rlike(r"^[^\t]+\s+\S+\s*$"))
    style = F.regexp_extract("m", r"(\S+)\s*$", 1)
    each = each.select(*keys, "place", F.trim(F.regexp_extract("m", r"^([^\t]+)\s+\S+\s*$", 1)).alias("target"), style.alias("s"))
    arc = (F.col("target") == "arcs") | F.col("target").contains(" ")
    named = each.select(*keys, "place", "target", F.when(F.col("s").contains(":"), F.regexp_extract("s", r"^(\S+):", 1)).when(arc, "color").otherwise("bgColor").alias("style"), F.regexp_extract("s", r"([^:\s]+)$", 1).alias("value"))
    own = named.where(~F.col("target").isin("nodes", "arcs"))
    nodes = words(blocks).select(*keys, F.lit("nodes").alias("target"), F.col("id").alias("each"))
    arcs = relations(blocks).select(*keys, F.lit("arcs").alias("target"), F.concat_ws(" ", "head", "dependent", "label").alias("each"))
    spread = named.join(nodes.union(arcs), [*keys, "target"]).drop("target").withColumnRenamed("each", "target")
    first = spread.groupBy(*keys, "target", "style").agg(F.min_by("value", "place").alias("value"))
    return own.select(*keys, "target", "style", "value").union(first.join(own, [*keys, "target", "style"], "left_anti").select(*keys, "target", "style", "value"))
