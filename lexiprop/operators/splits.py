"""Seeded per-synset train/test splits.

A split is one DataFrame ``(split_id, word, synset, part)``; ``part`` is
``'train'`` or ``'test'``.  Several seeds are one job: every row is exploded
over the seed list (a literal array, no join).  The random order is
``md5('<seed>:<word>')``, identical in Spark and DuckDB, and ranks inside a
synset come from the salted exact ``rank_by_hash``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiprop.functions.ranking import rank_by_hash, seeded_hash

VARIANTS = ("sample_each_concept_frac", "sample_each_concept_n", "all_as_training")
DEFAULT_SEEDS = (1, 2, 3)


def _with_seeds(thesaurus: DataFrame, seeds: Sequence[int]) -> DataFrame:
    return thesaurus.select(
        F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("split_id"), "word", "synset"
    )


def split_thesaurus(
    thesaurus: DataFrame,
    variant: str = "sample_each_concept_frac",
    *,
    frac: float = 0.5,
    n_test: int = 1,
    seeds: Sequence[int] = (1,),
) -> DataFrame:
    """P1/P2/P3 (+P5 over ``seeds``)."""
    if variant not in VARIANTS:
        raise NotImplementedError(variant)
    rows = _with_seeds(thesaurus, seeds)
    if variant == "all_as_training":
        return rows.withColumn("part", F.lit("train"))
    hashed = rows.withColumn("_h", seeded_hash(F.col("split_id"), F.col("word")))
    ranked = rank_by_hash(hashed, ["split_id", "synset"], "_h", out="_rn", group_size="_cnt")
    if variant == "sample_each_concept_frac":
        n_train = F.bround(F.lit(float(frac)) * F.col("_cnt"), 0)
        part = F.when(F.col("_rn") <= n_train, "train").otherwise("test")
    else:
        too_small = ranked.filter(F.col("_cnt") < n_test).limit(1).count()
        if too_small:
            raise ValueError(f"a synset has fewer than n_test={n_test} words")
        part = F.when(F.col("_rn") <= F.lit(n_test), "test").otherwise("train")
    return ranked.select("split_id", "word", "synset", part.alias("part"))


def train_part(split: DataFrame) -> DataFrame:
    return split.filter(F.col("part") == "train").select("split_id", "word", "synset")


def test_part(split: DataFrame) -> DataFrame:
    return split.filter(F.col("part") == "test").select("split_id", "word", "synset")


def complement(thesaurus_split: DataFrame, sampled: DataFrame) -> DataFrame:
    """Rows of ``thesaurus_split`` whose word was not sampled (left anti join)."""
    return thesaurus_split.join(sampled.select("split_id", "word"), ["split_id", "word"], "left_anti")


def shuffled_order(df: DataFrame, group_cols: list[str], key: str, seed: int, out: str = "order") -> DataFrame:
    """A seeded random order inside each group (1-based)."""
    hashed = df.withColumn("_h", seeded_hash(F.lit(seed), F.col(key)))
    return rank_by_hash(hashed, group_cols, "_h", out=out).drop("_h")
