"""Bounded samples of labelled rows, for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: Labels beyond this many are taken for a mistake: an error, no choice among them.
CLASSES = 10_000
#: Rows of a class that the bound on all rows leaves at least.
LEAST = 20
#: Bytes of a text that is learned from, and of all such texts.
LONGEST, BYTES = 1 << 18, 1 << 26


def sample(docs: DataFrame, labels: DataFrame, per_class: int, most: int) -> list[tuple[str, object]]:
    """(text, label) of a sample, on the driver: per_class rows of each class, or as many as it has.

    The bound: where classes times per_class exceed `most`, each class gets an even share of `most`, LEAST rows at least; so rare classes keep their
    rows. Texts of more than LONGEST bytes are not learned from, and of the rest those that come first within BYTES bytes. More than CLASSES labels are an error.

    docs: doc_id, text. labels: doc_id, label, of docs; null ids and labels are left out. An id that is there more than once counts once, with its smallest
    label and its smallest text. The choice and its order follow a hash of doc_id, so that they are the same in each run. Only ids and labels
    are counted and ranked; texts are read for the chosen ids alone and not shuffled. Without labelled rows the sample is empty.
    """
    slim = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "label")
    counts = slim.groupBy("label").agg(F.approx_count_distinct("doc_id").alias("n")).limit(CLASSES + 1).collect()
    if len(counts) > CLASSES:
        raise ValueError(f"more than {CLASSES} different labels")
    if not counts:
        return []
    spark = docs.sparkSession
    each = min(per_class, max(LEAST, most // len(counts)))
    # A class's share of ids is drawn wide enough for `each` of them, and cut to the first of these.
    shares = spark.createDataFrame([(r["label"], min(1.0, (1.3 * each + 50) / max(r["n"], 1))) for r in counts], slim.select("label").schema.add("share", "double"))
    place = F.xxhash64("doc_id", F.lit(7)) / F.lit(2.0**64) + F.lit(0.5)
    drawn = slim.withColumn("place", place).join(F.broadcast(shares), "label").where(F.col("place") < F.col("share"))
    first = Window.partitionBy("label").orderBy("place", "doc_id")
    chosen = drawn.groupBy("doc_id", "place").agg(F.min("label").alias("label")).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= each)
    picked = {r["doc_id"]: (r["label"], r["place"]) for r in chosen.collect()}
    if not picked:
        return []
    few = spark.createDataFrame([(i,) for i in picked], "doc_id long")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id").where(F.octet_length("text") <= LONGEST)
    found = stored(found.groupBy("doc_id").agg(F.min("text").alias("text")), "sample")
    room, kept = BYTES, []
    for r in sorted(found.select("doc_id", F.octet_length("text").alias("n")).collect(), key=lambda r: (r["doc_id"] * 0x9E3779B97F4A7C15 % 2**64, r["doc_id"])):
        room -= r["n"]
        if room < 0:
            break
        kept.append(r["doc_id"])
    of = {}
    for r in found.join(F.broadcast(spark.createDataFrame([(i,) for i in kept], "doc_id long")), "doc_id").toLocalIterator():
        of[r["doc_id"]] = r["text"]
    return [(of.pop(i), picked[i][0]) for i in kept]
