"""Indexes CoNLL-U files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import conllu


def follow(spark: SparkSession, source: str, index: str, checkpoint: str):
    """A streaming query that indexes each batch of new files in source into a shard of its own below index.

    A batch that runs again after a failure overwrites its shard, so that no sentence is counted twice.
    """
    lines = spark.readStream.option("lineSep", "\n\n").text(source)

    def batch(df: DataFrame, number: int) -> None:
        blocks = conllu.numbered(conllu.sentences_of(df)).select(F.format_string("batch_%08d", F.lit(number)).alias("shard"), F.col("pos").alias("graph_id"), "block")
        conllu.write_index(conllu.graphs(blocks), f"{index}/batch={number:08d}")

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
