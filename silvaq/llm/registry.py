"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lsh_search(spark, sf_dir):
    from .lsh_search import search

    return search(_table(spark, sf_dir, "embeddings"))


def op2_mixing(spark, sf_dir):
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op3_ngram_join(spark, sf_dir):
    from .ngram_join import group

    return group(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_vector_dedup(spark, sf_dir):
    from .vector_dedup import dedup

    return dedup(_table(spark, sf_dir, "embeddings"))


def op6_language_model(spark, sf_dir):
    from .language_model import score

    return score(_table(spark, sf_dir, "documents"))


def op7_language_id(spark, sf_dir):
    from .language_id import identify

    return identify(_table(spark, sf_dir, "documents"))


def op8_secrets(spark, sf_dir):
    from .secrets import scan

    return scan(_table(spark, sf_dir, "documents"))


def op9_token_files(spark, sf_dir):
    import public_tokenizers

    from .token_files import encode_and_read

    return encode_and_read(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_sentencepiece(spark, sf_dir):
    import public_tokenizers

    from .transducer import encode

    return encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).drop("ids")


def queries() -> dict:
    return {f.__name__: f for f in (op1_lsh_search, op2_mixing, op3_ngram_join, op4_toxicity, op5_vector_dedup, op6_language_model, op7_language_id, op8_secrets, op9_token_files, op10_sentencepiece)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    from . import mixing, ngram_join, vector_dedup

    found = {"op2_mixing": mixing.ORACLE, "op3_ngram_join": ngram_join.ORACLE, "op5_vector_dedup": vector_dedup.ORACLE, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: sql for name, sql in found.items() if sql}
