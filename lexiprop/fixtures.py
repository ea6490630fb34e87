"""Fixture views over the driver's parquet tables (see FIXTURES.md).

Each ``*_fx`` function reads whole tables and derives the input shape an
operator expects; the same definitions exist as SQL in ``plans/oracle.py`` so
that Spark and DuckDB see identical inputs.  No id subsets or row caps: the
fixtures grow with the scale factor.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def corpus_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id string, text string)``: documents plus the characters the cleaning rules act on,
    and the document's own id followed by a tail (cut by T2)."""
    docs = table(spark, sf_dir, "documents")
    doc_id = F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.lit("X"))
    text = F.concat(F.lit("muß § 5 -vor- Maß_x "), F.col("text"), F.lit(" "), doc_id, F.lit(" tail"))
    return docs.select(doc_id.alias("doc_id"), text.alias("text"))


def concepts_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw thesaurus ``(concept bigint, pos bigint, class string, keys array<string>)``.

    One concept per sentence of every document (split on ``. ! ?`` and line
    ends); keys are the sentence's space-separated words, so keys carry capitals,
    punctuation and accents and a word belongs to many concepts.  Every fourth
    sentence is an antonym concept.
    """
    docs = table(spark, sf_dir, "documents")
    sentences = docs.select(
        "doc_id", F.posexplode(F.split(F.col("text"), "[.!?\n]", -1)).alias("sno", "sentence")
    ).filter(F.trim(F.col("sentence")) != "")
    concept = (F.col("doc_id") * 100000 + F.col("sno")).cast("long")
    return sentences.select(
        concept.alias("concept"),
        concept.alias("pos"),
        F.when((F.col("doc_id") + F.col("sno")) % 4 == 0, "antonym").otherwise("synonym").alias("class"),
        F.split(F.trim(F.col("sentence")), " ", -1).alias("keys"),
    )


def vec_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(word bigint, vector array<double>, synset int)`` from the embeddings table."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").alias("word"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.col("label").cast("int").alias("synset"),
    )


def scores_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic human scores ``(word, y_conf, n_train, n_pred, score)`` from events."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("word"),
        F.col("value").alias("y_conf"),
        (F.col("user_id") % 7).alias("n_train"),
        (F.col("event_id") % 11).alias("n_pred"),
        (F.col("event_id") % 3).cast("int").alias("score"),
    )


def runs_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run result per (series, iteration): ``(series, iter, mean_accuracy)``."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.col("event_type").alias("series"), (F.col("event_id") % 5 + 1).cast("int").alias("iter")).agg(
        F.round(F.avg("value") / 1000, 6).alias("mean_accuracy")
    )


SEEDS = (1, 2, 3)
