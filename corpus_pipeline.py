"""From documents to token ids: five stages, each an operator of silvaq.llm whose decisions take effect.

In every stage null and repeated doc_ids are rows like any other, other columns come along under whatever names, texts of any length are taken whole, and
without documents there are none in the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from silvaq.llm.common import stored

THRESHOLD = 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field does not reject.

    Null and empty texts have no sign of toxicity and stay; rows that repeat a document share its fate. Without labels nothing is rejected.
    """
    from silvaq.llm.toxicity import reject, train

    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return reject(docs, model, threshold=THRESHOLD)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: word 5-grams with a Jaccard of 0.8 or more.

    The one of the smallest doc_id stays (ties: by the text's digest); groups without any doc_id keep one too. Null, empty and blank texts are like nothing
    and stay.
    """
    from silvaq.llm.ngram_join import distinct

    return distinct(docs, width=5, share=80, nameless=True)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced. Null and empty texts stay as they are."""
    from silvaq.llm.secrets import redact

    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, sources at their weights, each as often as passes over its source touch it.

    A null source is one of its own. Documents without words are not taken: they have no tokens to train on.
    """
    from silvaq.llm.mixing import arrange

    return arrange(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document. Null and empty texts have none."""
    import public_tokenizers

    from silvaq.llm.transducer import encode

    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity), ("ngram_join", ngram_join), ("secrets", secrets), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: SQL cannot express the first and the last stage; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each starts from the stored rows of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
