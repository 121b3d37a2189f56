"""A training corpus from ``documents`` in five stages, each one operator of ``twinscout.llm``.

Every stage reads what its predecessor kept, as Parquet, and returns the columns of
``documents``; the last one returns packed pieces.
"""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from twinscout.llm import line_dedup, mixing, packing, simhash, toxicity  # noqa: E402
from twinscout.llm.common import table  # noqa: E402
from twinscout.llm.queries import held_out  # noqa: E402
from twinscout.sources.shared import materialized  # noqa: E402


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    model = toxicity.learn(docs.where(~held_out()), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 code points in five documents or more stay in one of them."""
    return line_dedup.drop_lines(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8."""
    return simhash.drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4,096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxic_documents),
    ("line_dedup", repeated_lines),
    ("simhash", near_duplicates),
    ("mixing", source_mix),
    ("packing", packed),
]

#: Language models, SimHash components, hash-random order and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialized(stage(spark, docs, sf_dir), name)
    return docs
