"""The corpus pipeline: each stage takes (spark, docs, sf_dir), works on all its predecessor kept and decides.

Stages are written as Parquet and read again before the next one, so a lost executor repeats one stage at most; what a
stage wrote on its way is removed then.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from basketry.llm import language_id, near_dedup, packing, quality_rules, secret_scan
from basketry.llm.tables import finished, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go; ``lang`` is the recognised one."""
    return language_id.keep_identified(docs, public_tokenizers.path("piece_bpe_32k.model"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go from every text, and documents that break the rules or lose too much text go."""
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dedup.keep_one_of_each_group(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; no document goes."""
    return secret_scan.redact(docs, secret_scan.common_pieces(public_tokenizers.path("word_bpe_49k.json")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2,048 tokens."""
    # Beside what the earlier stages have left in an executor there is room for a smaller cache.
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cache_chunks=200_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("packing", packed),
]

#: Trained models, similarity on full sets and the tokenizer are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = finished(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
