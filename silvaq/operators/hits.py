"""What is done with hits: grouping, limits, context, annotated output and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("shard", "graph_id")


def _keys(df: DataFrame) -> list[str]:
    return [k for k in KEYS if k in df.columns]


def group(hits: DataFrame) -> DataFrame:
    """keys, toks: one row per sentence with its tokens in order."""
    return hits.groupBy(*_keys(hits)).agg(F.sort_array(F.collect_set("tok")).alias("toks"))


def first(grouped: DataFrame, most: int, skip: int = 0) -> DataFrame:
    """The first sentences by shard and graph_id; most 0: all."""
    ordered = grouped.orderBy(*_keys(grouped))
    if skip:
        ordered = ordered.offset(skip)
    return ordered.limit(most) if most else ordered


def shuffled(grouped: DataFrame, seed: int = 0) -> DataFrame:
    """Shards in an order drawn by the seed (by a digest of both), sentences of a shard in theirs."""
    return grouped.orderBy(F.md5(F.concat_ws("/", F.col("shard"), F.lit(str(seed))).cast("binary")), "shard", "graph_id")


def counts(hits: DataFrame) -> DataFrame:
    """shard, sentences, tokens of the hits, and a row with shard null for all."""
    per = hits.groupBy("shard", "graph_id").agg(F.count("*").alias("k")).rollup("shard").agg(F.count("*").alias("sentences"), F.sum("k").alias("tokens"))
    return per


def context(found: DataFrame, sentences: DataFrame, width: int, *, same_document: bool = False) -> DataFrame:
    """keys, place (-width to width), kind, text of the sentences around each hit sentence, by graph_id.

    sentences: keys, text, and url if same_document is asked for. A hit reaches its neighbours by an equi-join on their own ids, so that nothing but hits is multiplied.
    """
    keys = _keys(found)
    rest = [k for k in keys if k != "graph_id"]
    near = found.select(*keys).distinct().withColumn("place", F.explode(F.sequence(F.lit(-width), F.lit(width)))).withColumn("at", F.col("graph_id") + F.col("place"))
    text = sentences.select(*rest, F.col("graph_id").alias("at"), "text", *(["url"] if same_document else []))
    out = near.join(text, [*rest, "at"])
    if same_document:
        own = out.where("place = 0").select(*keys, F.col("url").alias("own"))
        out = out.join(own, keys).where(F.col("url").eqNullSafe(F.col("own")))
    kind = F.when(F.col("place") < 0, "context-before").when(F.col("place") == 0, "context-hit").otherwise("context-after")
    return out.select(*keys, "place", kind.alias("kind"), "text")


def sentence_text(lines: Column) -> Column:
    """The forms of a sentence, by spaces."""
    return F.array_join(F.transform(lines, lambda x: F.split(x, "\t")[1]), " ")


def annotated(grouped: DataFrame, text: DataFrame | None, contexts: DataFrame | None = None) -> DataFrame:
    """keys, block: each hit sentence as CoNLL-U, its hits marked in comments before it.

    text: keys, comments, lines. Texts are read for hits alone: they are the small side of the join. None: grouped has them.
    """
    keys = _keys(grouped)
    out = grouped if text is None else grouped.join(text, keys)
    marks = F.flatten(F.transform("toks", lambda t: F.array(F.concat(F.lit("# visual-style\t"), F.split(F.get("lines", t), "\t")[0], F.lit("\tbgColor:lightgreen")), F.concat(F.lit("# hittoken:\t"), F.get("lines", t)))))
    head = [F.array(F.concat(F.lit("# db-name: "), F.col("shard")))] if "shard" in keys else []
    head.append(F.array(F.concat(F.lit("# graph id: "), F.col("graph_id").cast("string"))))
    parts = [*head, marks, F.col("comments")]
    if contexts is not None:
        around = contexts.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "kind", "text"))), lambda c: F.concat(F.lit("# "), c["kind"], F.lit(": "), c["text"])).alias("around"))
        out = out.join(around, keys, "left")
        parts.append(F.coalesce("around", F.array().cast("array<string>")))
    return out.select(*keys, F.concat(F.array_join(F.concat(*parts, F.col("lines")), "\n"), F.lit("\n")).alias("block"))


def write_conllu(blocks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes blocks in the order of their keys, an empty line behind each."""
    blocks.orderBy(*_keys(blocks)).select("block").write.mode(mode).text(path)


