"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiprop.session import checkpoint_dir

#: A run of white space and a word, as the operators' contracts define them (ASCII white space only).
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A group with over 1/HOT_SHARE of all rows is joined by broadcast; there are at most HOT_SHARE such groups.
HOT_SHARE = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "labels.parquet"))


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below the folder that driver and executors share (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage is cut, and a lost
    executor costs no work that was finished."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """The text with A-Z lower-cased and all other characters as they are."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(text) == F.length(text)  # the quick way, right for ASCII
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, letters, letters.lower()))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def texts_of(batch, at: int, rows: int = 512):
    """The texts of an Arrow batch's column, a few at a time."""
    for i in range(0, batch.num_rows, rows):
        yield from batch.column(at).slice(i, rows).to_pylist()


def release_memory() -> None:
    """Gives memory that a Python task no longer uses back to the system; workers outlive their tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def column(df: DataFrame, name: str, kind: str) -> Column:
    """Column ``name`` as ``kind``; all null where the table has no such column."""
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def row_hash(docs: DataFrame) -> Column:
    """Hash over all columns, which tells apart rows that share a doc_id."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def join_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, total: int) -> DataFrame:
    """``rows`` joined with the one row that ``groups`` holds for each value of ``key``.

    ``size`` counts the rows of a group and ``total`` all rows. Groups with over 1/1000 of
    the rows (at most 1000 groups, whatever the input) are joined by broadcast, so a group
    that holds a third of all rows stays spread; the others go through a shuffle join.
    """
    is_hot = F.col(size) * F.lit(HOT_SHARE) > F.lit(total)
    hot = groups.filter(is_hot)
    hot_part = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(*([key] if isinstance(key, str) else key))), key, "left_anti")
    return hot_part.unionByName(rest.join(groups.filter(~is_hot), key).select(*hot_part.columns))
