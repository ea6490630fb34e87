"""Corpus cleaning, token streams and corpus statistics.

Cleaning is one projection per document; the action list chooses the column
expressions in the reference's fixed order, not in list order, and the
exclusive groups (``muß``/all ``ß``; the three character classes) keep only
their first selected member.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiprop.functions import text as tx
from lexiprop.functions.ranking import exact_quantiles, value_prefix

SENTENCE_TOKENS = 10_000  # fixed value: tokens per training sentence in single-line mode


def clean_corpus(
    corpus: DataFrame,
    actions: Sequence[str] = tx.DEFAULT_CORPUS_ACTIONS,
    doc_id: str = "doc_id",
    text: str = "text",
    max_texts: int | None = None,
) -> DataFrame:
    """``(doc_id, clean)`` with the cleaning chosen by ``actions``.

    ``max_texts`` (R1) keeps the first n documents in ``doc_id`` order.
    A line mode (single or multiple lines) must be selected.
    """
    acts = set(actions)
    if tx.ACTION_SINGLE_LINE not in acts and tx.ACTION_MULTIPLE_LINES not in acts:
        raise ValueError("select save_as_single_line or save_as_multiple_lines")
    if max_texts:
        corpus = corpus.orderBy(doc_id).limit(int(max_texts))
    c = tx.cut_at_own_id(F.col(text), F.col(doc_id))
    if tx.ACTION_REMOVE_NEWLINES in acts:
        c = tx.remove_newlines(c)
    if tx.ACTION_SZ_IN_MUSS in acts:
        c = tx.replace_sz_in_muss(c)
    elif tx.ACTION_ALL_SZ in acts:
        c = tx.replace_all_sz(c)
    if tx.ACTION_PARAGRAPH_WORD in acts:
        c = tx.replace_paragraph_sign(c)
    if tx.ACTION_NON_GERMAN in acts:
        c = tx.replace_non_german(c)
    elif tx.ACTION_PUNCTUATION in acts:
        c = tx.replace_punctuation(c)
    elif tx.ACTION_PUNCTUATION_KEEP_HYPHEN in acts:
        c = tx.replace_punctuation_keep_hyphen(c)
    tokens = tx.split_on_space(c)
    if tx.ACTION_MIN_TWO_CHARS in acts:
        tokens = tx.drop_short_tokens(tokens)
    if tx.ACTION_LOWERCASE in acts:
        tokens = tx.lowercase_tokens(tokens)
    return corpus.select(F.col(doc_id).alias("doc_id"), tx.join_tokens(tokens).alias("clean"))


def line_mode(actions: Sequence[str]) -> str:
    if tx.ACTION_SINGLE_LINE in actions:
        return "single"
    if tx.ACTION_MULTIPLE_LINES in actions:
        return "multiple"
    raise ValueError("no line mode selected")


def training_tokens(clean: DataFrame) -> DataFrame:
    """Whitespace tokens of the cleaned corpus with their position: ``(doc_id, pos, token)``."""
    return clean.select("doc_id", F.posexplode(tx.whitespace_tokens(F.col("clean"))).alias("pos", "token"))


def sentences(clean: DataFrame, actions: Sequence[str]) -> DataFrame:
    """Training sentences ``(sentence_id, tokens array)``.

    Multiple-lines mode: one sentence per document.  Single-line mode: the
    concatenated corpus (``doc_id`` order) cut every 10,000 tokens; the global
    position comes from a prefix sum over document lengths, so no single task
    sees the whole stream.
    """
    if line_mode(actions) == "multiple":
        return clean.select(F.col("doc_id").cast("string").alias("sentence_id"), tx.whitespace_tokens(F.col("clean")).alias("tokens"))
    chunks = stream_chunks(clean)
    grouped = chunks.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("gpos", "token"))).alias("_t"))
    return grouped.select(
        F.col("chunk").cast("string").alias("sentence_id"), F.transform("_t", lambda x: x["token"]).alias("tokens")
    )


def stream_chunks(clean: DataFrame, chunk_tokens: int = SENTENCE_TOKENS) -> DataFrame:
    """Tokens of the single-line stream with global position and chunk number.

    Output ``(doc_id, pos, token, gpos, chunk)``.
    """
    docs = clean.select("doc_id", tx.whitespace_tokens(F.col("clean")).alias("_t"))
    # document lengths are the histogram weights: 'before' = tokens of earlier documents
    offsets = value_prefix(docs.select("doc_id", F.size("_t").alias("n")), "doc_id", weight="n")
    # one row for each document is joined; tokens are exploded after it
    placed = docs.join(offsets.select("doc_id", F.col("before").alias("_off")), "doc_id")
    return placed.select("doc_id", "_off", F.posexplode("_t").alias("pos", "token")).select(
        "doc_id",
        "pos",
        "token",
        (F.col("_off") + F.col("pos")).alias("gpos"),
        F.floor((F.col("_off") + F.col("pos")) / chunk_tokens).alias("chunk"),
    )


def chunk_summary(chunks: DataFrame) -> DataFrame:
    """Per chunk: size and first/last token position (checks the chunk boundaries)."""
    first = F.min(F.struct("gpos", "doc_id", "pos"))
    last = F.max(F.struct("gpos", "doc_id", "pos"))
    return chunks.groupBy("chunk").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        first["doc_id"].alias("first_doc_id"),
        first["pos"].alias("first_pos"),
        last["doc_id"].alias("last_doc_id"),
        last["pos"].alias("last_pos"),
    )


def single_line_text(clean: DataFrame) -> DataFrame:
    """S2 rows: each document's text followed by one space, in ``doc_id`` order (write with ``coalesce(1)`` only for small outputs)."""
    return clean.orderBy("doc_id").select(F.concat(F.col("clean"), F.lit(" ")).alias("value"))


def multiple_lines_text(clean: DataFrame) -> DataFrame:
    """S3 rows: one line per document (the reference writes the text plus one space)."""
    return clean.select(F.concat(F.col("clean"), F.lit(" ")).alias("value"))


# --- corpus statistics (raw text, whitespace tokens) -----------------------

def raw_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", F.explode(tx.whitespace_tokens(F.col(text))).alias("token"))


def tokens_per_document(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", F.size(tx.whitespace_tokens(F.col(text))).cast("long").alias("n_tokens"))


def describe(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, sample std, min, 25/50/75 % (linear), max, sum — exact and skew-safe."""
    base = df.agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).cast("double").alias("min"),
        F.max(value).cast("double").alias("max"),
        F.sum(value).cast("long").alias("sum"),
    )
    q = exact_quantiles(df, value, [0.25, 0.5, 0.75], ["p25", "p50", "p75"])
    # two one-row frames merged by union + aggregate (no join needed)
    merged = base.unionByName(q, allowMissingColumns=True)
    cols = ["count", "mean", "std", "min", "p25", "p50", "p75", "max", "sum"]
    return merged.agg(*[F.max(c).alias(c) for c in cols])


def token_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    return raw_tokens(docs, text).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def top_tokens(docs: DataFrame, n: int = 10, text: str = "text") -> DataFrame:
    """R2: the n most common tokens (ties by token)."""
    return token_frequencies(docs, text).orderBy(F.col("n").desc(), F.col("token").asc()).limit(n)


def vocabulary_size(docs: DataFrame, text: str = "text") -> DataFrame:
    return token_frequencies(docs, text).agg(F.count(F.lit(1)).alias("n_distinct_tokens"), F.sum("n").alias("n_tokens"))
