"""Incremental corpus cleaning with Structured Streaming.

The cleaning step (T14) is a stateless projection, so new corpus files can be
cleaned as they arrive: a file-source stream of JSON documents goes through the
same ``clean_corpus`` columns and lands in parquet.  The checkpoint location
makes the sink exactly-once across restarts and lost executors.  No other part
of the library is streaming (the reference has no stream operators).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiprop.functions import text as tx
from lexiprop.operators.corpus import clean_corpus
from lexiprop.sources.io import SKIPPED_FILE


def corpus_stream(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """S1 as a stream: ``(doc_id, text)`` from JSON files appearing in ``folder``."""
    reader = spark.readStream.schema("Volltext string").option("multiLine", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    raw = reader.json(folder).select("Volltext", F.col("_metadata.file_name").alias("file_name"))
    return raw.filter(F.col("file_name") != SKIPPED_FILE).select(
        tx.doc_id_from_file_name(F.col("file_name")).alias("doc_id"), F.col("Volltext").alias("text")
    )


def start_cleaning(
    spark: SparkSession,
    folder: str,
    out_path: str,
    checkpoint_location: str,
    actions: Sequence[str] = tx.DEFAULT_CORPUS_ACTIONS,
    available_now: bool = True,
) -> StreamingQuery:
    """Clean every new corpus file into parquet ``(doc_id, clean)``."""
    cleaned = clean_corpus(corpus_stream(spark, folder), actions)
    writer = cleaned.writeStream.format("parquet").option("checkpointLocation", checkpoint_location).outputMode("append")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(out_path)
