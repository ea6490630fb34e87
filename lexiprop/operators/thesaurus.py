"""Thesaurus cleaning and statistics.

Concepts are ``(concept, pos, class, keys array<string>)``; ``pos`` is the
position in the source file (ties of the largest-synset rule go to the later
concept).  Array functions keep the per-concept work in one projection; the
word -> synset choice is an aggregation, so a word shared by many concepts
never needs a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiprop.operators.corpus import describe

# Action names of the thesaurus stage.
ACTION_LOWERCASE = "transform_to_lowercase"
ACTION_NO_SPACE_OR_HYPHEN = "remove_keys_with_space_or_hyphen"
ACTION_NO_SPACE_KEEP_HYPHEN = "remove_keys_with_space_keep_hyphen"
ACTION_ALL_SZ = "replace_all_sz"
ACTION_LARGEST_WINS = "create_n_1_mapping_largest_sysnet_wins_key"
ACTION_IN_CORPUS = "remove_keys_not_in_corpus"
ACTION_MIN_TWO_KEYS = "remove_synsets_with_less_than_two_keys"
DEFAULT_THESAURUS_ACTIONS = (
    ACTION_LOWERCASE,
    ACTION_NO_SPACE_OR_HYPHEN,
    ACTION_LARGEST_WINS,
    ACTION_IN_CORPUS,
    ACTION_MIN_TWO_KEYS,
)
SYNONYM_CLASS = "synonym"


def synonym_concepts(concepts: DataFrame) -> DataFrame:
    """concepts of class ``synonym``."""
    return concepts.filter(F.col("class") == SYNONYM_CLASS)


def clean_keys(concepts: DataFrame, actions: Sequence[str]) -> DataFrame:
    """H1, F2/F3, H2, F4 on synonym concepts; returns ``(concept, pos, keys)``."""
    acts = set(actions)
    keys = F.col("keys")
    if ACTION_LOWERCASE in acts:
        keys = F.transform(keys, lambda k: F.lower(k))
    if ACTION_NO_SPACE_OR_HYPHEN in acts:
        keys = F.filter(keys, lambda k: ~F.contains(k, F.lit(" ")) & ~F.contains(k, F.lit("-")))
    elif ACTION_NO_SPACE_KEEP_HYPHEN in acts:
        keys = F.filter(keys, lambda k: ~F.contains(k, F.lit(" ")))
    if ACTION_ALL_SZ in acts:
        keys = F.transform(keys, lambda k: F.replace(k, F.lit("ß"), F.lit("ss")))
    cleaned = synonym_concepts(concepts).select("concept", "pos", keys.alias("keys"))
    return cleaned.filter(F.size("keys") > 0)


def largest_synset_wins(cleaned: DataFrame) -> DataFrame:
    """H3/H4: ``(word, synset)`` where each word maps to the concept with most keys.

    Key counts include duplicate keys; ties go to the concept later in file order.
    """
    pairs = cleaned.select(
        "concept", "pos", F.size("keys").alias("n_keys"), F.explode("keys").alias("word")
    )
    best = F.max(F.struct("n_keys", "pos", "concept"))
    return pairs.groupBy("word").agg(best["concept"].alias("synset"))


def keep_in_vocabulary(mapping: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Keep words present in the vocabulary (left semi join)."""
    return mapping.join(vocabulary.select("word"), "word", "left_semi")


def drop_small_synsets(mapping: DataFrame, min_words: int = 2) -> DataFrame:
    """remove synsets with fewer than ``min_words`` words (aggregate + semi join)."""
    big = mapping.groupBy("synset").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_words)
    return mapping.join(big.select("synset"), "synset", "left_semi").select("word", "synset")


def clean_thesaurus(concepts: DataFrame, vocabulary: DataFrame, actions: Sequence[str] = DEFAULT_THESAURUS_ACTIONS) -> DataFrame:
    """H6: the whole thesaurus stage; H4, H5 and F5 are mandatory."""
    acts = set(actions)
    for required in (ACTION_LARGEST_WINS, ACTION_IN_CORPUS, ACTION_MIN_TWO_KEYS):
        if required not in acts:
            raise NotImplementedError(required)
    mapping = largest_synset_wins(clean_keys(concepts, actions))
    return drop_small_synsets(keep_in_vocabulary(mapping, vocabulary))


# --- statistics -----------------------------------------------------------

def class_counts(concepts: DataFrame) -> DataFrame:
    """Concepts per class."""
    return concepts.groupBy("class").agg(F.count(F.lit(1)).alias("n_concepts"))


def keys_per_concept(concepts: DataFrame) -> DataFrame:
    return synonym_concepts(concepts).select("concept", F.size("keys").cast("long").alias("n_keys"))


def size_describe(concepts: DataFrame) -> DataFrame:
    """describe() and sum of the key counts of synonym concepts."""
    return describe(keys_per_concept(concepts), "n_keys")


def key_counts(concepts: DataFrame) -> DataFrame:
    """All keys, unique keys, keys occurring more than once (repeats inside a concept count)."""
    per_key = (
        synonym_concepts(concepts)
        .select(F.explode("keys").alias("key"))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_key.agg(
        F.sum("n").alias("n_keys"),
        F.count(F.lit(1)).alias("n_unique_keys"),
        F.count(F.when(F.col("n") > 1, 1)).alias("n_keys_in_several"),
    )


def size_histogram(concepts: DataFrame) -> DataFrame:
    """Number of synonym concepts per key count."""
    return keys_per_concept(concepts).groupBy("n_keys").agg(F.count(F.lit(1)).alias("n_concepts"))
