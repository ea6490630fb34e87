"""Readers and writers for the reference's file formats.

Parquet is the main form between stages; the text formats below exist so a
user of the reference can bring their files in and take results out.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiprop.functions.text import doc_id_from_file_name, parse_int_list
from lexiprop.session import cut_lineage

SKIPPED_FILE = ".DS_Store"  # fixed value: the file name the corpus scan ignores
SHEET_HEADER_ROWS = 7  # fixed value: rows above the scores in a reviewed sheet

THESAURUS_SCHEMA = T.StructType(
    [
        T.StructField("Class", T.StringType()),
        T.StructField("Concept", T.LongType()),
        T.StructField("Keys", T.ArrayType(T.StringType())),
        T.StructField("ExpansionKeys", T.ArrayType(T.StringType())),
    ]
)


# --- corpus ---------------------------------------------------------------------

def _shared_files(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder and the folder's name there; ``file:/x`` is the same as ``file:///x``."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def write_corpus_json(docs: DataFrame, folder: str) -> list[str]:
    """Each row as a JSON document (null columns left out) in a file of its own; returns the folders to read.

    Tasks write the files themselves, each attempt into a new folder below ``folder``: Spark's writer opens,
    checks and moves every file, which takes far longer than a document. Only folders of attempts that ended
    are returned, so what a lost task left behind is not read. One row a task reaches the driver.
    """
    try:
        where, name = _shared_files(folder)
    except pa.ArrowInvalid:  # a store that only Spark reaches
        docs.write.option("maxRecordsPerFile", 1).json(folder)
        return [folder]
    where.create_dir(name)

    def write(batches):
        store, base = _shared_files(folder)
        own = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        store.create_dir(f"{base}/{own}")
        n = 0
        for batch in batches:
            for line in batch.column(0):
                with store.open_output_stream(f"{base}/{own}/{n:09d}.json") as out:
                    out.write(line.as_buffer())
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([own])], ["own"])

    lines = docs.select(F.to_json(F.struct(*docs.columns)).alias("json"))
    return [f"{folder}/{r.own}" for r in lines.mapInArrow(write, "own string").collect()] or [folder]


def read_corpus_json(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """One JSON document per file; ``Volltext`` is the text, the id comes from the file name.
    A file that is no JSON is an error. Spark counts a file as 4 MB at least and puts few of them in a
    partition; of the folders that ``write_corpus_json`` returns, a task takes as many partitions as a writing task's share."""
    raw = (
        spark.read.schema("Volltext string")
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .json(folder)
        .select("Volltext", F.col("_metadata.file_name").alias("file_name"))
    )
    if not isinstance(folder, str):
        raw = raw.coalesce(max(len(folder), 4 * spark.sparkContext.defaultParallelism))
    return raw.filter(F.col("file_name") != SKIPPED_FILE).select(
        doc_id_from_file_name(F.col("file_name")).alias("doc_id"), F.col("Volltext").alias("text")
    )


def write_clean_corpus(clean: DataFrame, path: str, single_line: bool, mode: str = "overwrite") -> None:
    """The cleaned corpus as text.

    Every document is written as its text plus one space.  Multiple-lines mode
    ends each document with a newline; single-line mode uses the space itself
    as the record separator, so the part files (range-partitioned by
    ``doc_id``, in order) concatenate to the one-line corpus.
    """
    if single_line:
        clean.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(F.col("clean").alias("value")).write.mode(
            mode
        ).option("lineSep", " ").text(path)
    else:
        clean.select(F.concat(F.col("clean"), F.lit(" ")).alias("value")).write.mode(mode).text(path)


# --- embeddings -------------------------------------------------------------------

def write_word2vec_text(vectors: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``n d`` header line, then ``word v1 ... vd`` (words sorted; header first)."""
    n = vectors.count()
    d = vectors.select(F.size("vector").alias("d")).agg(F.max("d")).first()[0] or 0
    spark = vectors.sparkSession
    header = spark.createDataFrame([(0, "", f"{n} {d}")], "k int, word string, value string")
    body = vectors.select(
        F.lit(1).alias("k"),
        F.col("word").cast("string").alias("word"),
        F.concat_ws(" ", F.col("word").cast("string"), F.array_join(F.transform("vector", lambda x: x.cast("string")), " ")).alias(
            "value"
        ),
    )
    header.unionByName(body).orderBy("k", "word").select("value").write.mode(mode).text(path)


def read_word2vec_text(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """``(word, vector array<double>)`` from word2vec text; with ``header`` the
    ``n d`` line is dropped (GloVe output has none)."""
    parts = spark.read.text(path).select(F.split(F.col("value"), " ", -1).alias("p"))
    if header:
        is_header = (F.size("p") == 2) & F.col("p")[0].rlike("^[0-9]+$") & F.col("p")[1].rlike("^[0-9]+$")
        parts = parts.filter(~is_header)
    return parts.select(
        F.col("p")[0].alias("word"),
        F.transform(F.slice(F.col("p"), 2, F.size("p") - 1), lambda x: x.cast("double")).alias("vector"),
    )


# --- graph --------------------------------------------------------------------------

def write_graph(edges: DataFrame, nodes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Edges ``(src, dst, weight)`` and the node list as parquet."""
    edges.write.mode(mode).parquet(f"{path}/edges")
    nodes.select("word").write.mode(mode).parquet(f"{path}/nodes")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/nodes")


# --- thesaurus ------------------------------------------------------------------------

def read_thesaurus_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of ``{Class, Concept, Keys, ...}`` -> ``(concept, pos, class, keys)``.

    ``pos`` is the position in file order (file name, then offset in the file).
    """
    raw = (
        spark.read.schema(THESAURUS_SCHEMA)
        .option("multiLine", True)
        .json(path)
        .select("*", F.col("_metadata.file_name").alias("_file"), F.monotonically_increasing_id().alias("_id"))
    )
    return _with_position(raw)


def read_thesaurus_sequence(spark: SparkSession, path: str) -> DataFrame:
    """Pretty-printed JSON objects written one after another (no enclosing array).

    Objects never nest here; each is matched with its strings, so braces inside a
    string are no boundary.
    """
    whole = spark.read.text(path, wholetext=True).select(
        F.col("value"), F.col("_metadata.file_name").alias("_file")
    )
    each = F.regexp_extract_all(F.col("value"), F.lit(r'\{(?:[^{}"]|"(?:[^"\\]|\\.)*")*+\}'), 0)
    as_array = F.concat(F.lit("["), F.array_join(each, ","), F.lit("]"))
    parsed = whole.select("_file", F.posexplode(F.from_json(as_array, T.ArrayType(THESAURUS_SCHEMA))).alias("_id", "c"))
    return _with_position(parsed.select("_file", F.col("_id").cast("long").alias("_id"), "c.*"))


_OFFSET_BITS = 33  # row offset bits of monotonically_increasing_id


def _with_position(raw: DataFrame) -> DataFrame:
    """``pos`` orders concepts by file name, then by offset inside the file.

    A JSON document file is read whole by one task, so the low bits of the row
    id are the offset; the file rank comes from the (small) list of file names.
    """
    files = raw.select("_file").distinct()
    ranked = files.withColumn("_fr", (F.row_number().over(Window.orderBy("_file")) - 1).cast("long"))
    j = raw.join(ranked, "_file")
    offset = F.col("_id").bitwiseAND(F.lit((1 << _OFFSET_BITS) - 1))
    pos = F.shiftleft(F.col("_fr"), _OFFSET_BITS) + offset
    return j.select(
        F.col("Concept").alias("concept"),
        pos.cast("long").alias("pos"),
        F.col("Class").alias("class"),
        F.col("Keys").alias("keys"),
    )


# --- space separated tables ---------------------------------------------------------------

def write_space_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Space-separated text with a header line; list columns as ``"[a, b, c]"`` (quoted,
    as pandas writes a field that contains the separator)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            cols.append(F.concat(F.lit("["), F.array_join(F.col(f.name), ", "), F.lit("]")).alias(f.name))
        else:
            cols.append(F.col(f.name))
    df.select(*cols).write.mode(mode).option("sep", " ").option("header", True).csv(path)


def read_space_table(spark: SparkSession, path: str, schema: str, list_columns: tuple[str, ...] = ()) -> DataFrame:
    """Read a space-separated table with header; ``list_columns`` (declared as
    string in ``schema``) are parsed from ``[a, b, c]`` into ``array<int>``."""
    df = spark.read.option("sep", " ").option("header", True).schema(schema).csv(path)
    return df.select(*[parse_int_list(F.col(c)).alias(c) if c in list_columns else F.col(c) for c in df.columns])


# --- statistics and run results -------------------------------------------------------------

def write_stats_json(stats: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Statistics rows (nested structs allowed) as JSON lines."""
    stats.write.mode(mode).json(path)


def read_run_stats(spark: SparkSession, pattern: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Every run's statistics file with its path (``run_path``)."""
    reader = spark.read.option("multiLine", True)
    if schema:
        reader = reader.schema(schema)
    return reader.json(pattern).withColumn("run_path", F.col("_metadata.file_path"))


# --- review sheets ------------------------------------------------------------------------------

def write_review_sheet(sheet: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Review rows as CSV with header (one file per partition)."""
    sheet.write.mode(mode).option("header", True).csv(path)


def read_scored_sheet(spark: SparkSession, path: str | list[str], word_col: int = 4, score_col: int = 6) -> DataFrame:
    """A reviewed sheet exported as CSV: skip the 7 header rows, take the word and
    score columns (E and G by default), drop rows without a word."""
    # the sheet's columns up to the last one read, whatever the width of its title rows
    cols = [f"_c{i}" for i in range(max(word_col, score_col) + 1)]
    raw = spark.read.option("header", False).schema(", ".join(f"{c} string" for c in cols)).csv(path).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_id")
    )
    ranked = raw.withColumn("_line", F.row_number().over(Window.partitionBy("_file").orderBy("_id")))
    body = ranked.filter(F.col("_line") > SHEET_HEADER_ROWS)
    return body.select(
        F.col(cols[word_col]).alias("word"), F.col(cols[score_col]).cast("double").cast("int").alias("score")
    ).filter(F.col("word").isNotNull())


def write_projector(rows: DataFrame, vectors_path: str, labels_path: str, mode: str = "overwrite") -> None:
    """Vectors as TSV without header, labels (word, label) as TSV with header.

    Both come from one evaluation of ``rows``: evaluated twice, they could lie in other part files or in another order.
    """
    rows = cut_lineage(rows)
    rows.select(F.array_join(F.transform("vector", lambda x: x.cast("string")), "\t").alias("value")).write.mode(mode).text(
        vectors_path
    )
    rows.select("word", "label").write.mode(mode).option("sep", "\t").option("header", True).csv(labels_path)
