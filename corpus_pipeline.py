"""The training-data pipeline: toxic documents go, exact copies and near copies go, sources are
mixed to their target weights, and what is left is encoded.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
Stages handle null texts, repeated rows, empty tables and extra columns as their operators do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiprop.llm import bpe_distinct, budget_mix, digest_index, simhash_vptree, toxicity_channel
from lexiprop.llm.common import documents, labels, stored
from lexiprop.llm.queries import tokenizer_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    return toxicity_channel.accepted(docs, toxicity_channel.fit(docs, labels(spark, sf_dir)))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays."""
    return digest_index.kept_documents(docs, digest_index.new_index(spark))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    return simhash_vptree.one_of_each(docs, shingle_words=4, max_bits=4)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return budget_mix.mixed_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids and decoded text, as digests."""
    return bpe_distinct.encode_documents(docs, tokenizer_path(), block_bytes=BPE_BLOCK_BYTES)


#: Smaller blocks than the operator has by default: more disk, but less memory after four other stages.
BPE_BLOCK_BYTES = 4 << 20

STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("bpe", bpe),
]

#: SQL can express neither the learned scores, the fingerprints nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
