"""A training corpus from raw documents: clean, deduplicate twice, pack.

Each stage takes (spark, docs, sf_dir) and the documents that its predecessor kept. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ocelens.llm import dart_minhash, packing, quality, substring_dedup
from ocelens.session import configure, materialise

LIMIT, END_ID = 2048, 1


def line_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, the others lose their failed lines."""
    configure(spark)
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every class stays."""
    configure(spark)
    return dart_minhash.deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay where they occur first."""
    configure(spark)
    return substring_dedup.deduplicate(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    configure(spark)
    cut = packing.cut(docs, public_tokenizers.path("word_bpe_49k.json"), LIMIT, END_ID, keep_ids=False)
    return packing.pack(cut, LIMIT)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", line_quality),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("packing", packed_sequences),
]

#: Line rules and tokenizers are beyond SQL; the tests compare with a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
