"""Thesaurus cleaning rules and split invariants."""

import pytest
from pyspark.sql import functions as F

from lexiprop.operators import splits as sp
from lexiprop.operators import thesaurus as th


def _concepts(spark, rows):
    return spark.createDataFrame(rows, "concept long, pos long, class string, keys array<string>")


def test_largest_synset_wins_and_ties_go_later(spark):
    c = _concepts(
        spark,
        [
            (10, 0, "synonym", ["Auto", "Wagen"]),
            (11, 1, "synonym", ["auto", "kfz", "pkw"]),
            (12, 2, "synonym", ["kfz", "lkw", "bus"]),
            (13, 3, "antonym", ["auto", "a", "b", "c", "d"]),
            (14, 4, "synonym", ["ab-c", "x y"]),
        ],
    )
    m = {r.word: r.synset for r in th.largest_synset_wins(th.clean_keys(c, th.DEFAULT_THESAURUS_ACTIONS)).collect()}
    assert m == {"auto": 11, "wagen": 10, "kfz": 12, "pkw": 11, "lkw": 12, "bus": 12}


def test_clean_thesaurus_requires_mandatory_actions(spark):
    c = _concepts(spark, [(1, 0, "synonym", ["a"])])
    v = spark.createDataFrame([("a",)], "word string")
    with pytest.raises(NotImplementedError):
        th.clean_thesaurus(c, v, (th.ACTION_LOWERCASE,))


def test_small_synsets_removed(spark):
    c = _concepts(spark, [(1, 0, "synonym", ["aa", "bb", "cc"]), (2, 1, "synonym", ["dd", "ee"])])
    v = spark.createDataFrame([("aa",), ("bb",), ("dd",)], "word string")
    out = {(r.word, r.synset) for r in th.clean_thesaurus(c, v).collect()}
    assert out == {("aa", 1), ("bb", 1)}


def _thes(spark, n_synsets=7, size=9):
    return spark.createDataFrame(
        [(f"w{s}_{i}", s) for s in range(n_synsets) for i in range(s + 2 if size is None else size)],
        "word string, synset int",
    )


def test_split_invariants(spark):
    thes = _thes(spark, size=None)
    parts = sp.split_thesaurus(thes, frac=0.5, seeds=(1, 2, 3)).cache()
    n = thes.count()
    for seed in (1, 2, 3):
        p = parts.filter(F.col("split_id") == seed)
        assert p.count() == n
        assert p.select("word").distinct().count() == n
    sizes = {(r.split_id, r.synset): r.n for r in parts.filter("part = 'train'").groupBy("split_id", "synset").agg(F.count("*").alias("n")).collect()}
    for (seed, s), k in sizes.items():
        assert k == round(0.5 * (s + 2))  # Python's round is half-even, like bround


def test_split_n_test_errors_when_too_small(spark):
    with pytest.raises(ValueError):
        sp.split_thesaurus(_thes(spark, size=2), "sample_each_concept_n", n_test=3)


def test_split_unknown_variant(spark):
    with pytest.raises(NotImplementedError):
        sp.split_thesaurus(_thes(spark), "random_split")


def test_rank_by_hash_is_exact_with_salt(spark):
    from lexiprop.functions.ranking import rank_by_hash, seeded_hash

    df = spark.range(5000).select(F.lit(1).alias("g"), F.col("id").cast("string").alias("k"))
    df = df.withColumn("h", seeded_hash(F.lit(3), F.col("k")))
    got = {r.k: r.rn for r in rank_by_hash(df, ["g"], "h", salt=64).collect()}
    expected = {k: i + 1 for i, (h, k) in enumerate(sorted((r.h, r.k) for r in df.collect()))}
    assert got == expected
