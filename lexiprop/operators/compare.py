"""Comparison of methods and run results.

Several methods' evaluation tables are stacked into one frame with a
``method`` column (position in the input list) instead of being joined
pairwise in driver loops; method pairs ``a < b`` come from one equi-join on
the shared keys, never from a cross join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiprop.functions.text import transliterate

TOP_PER_SYNSET = 10
RANK_DECIMALS = 9


def stack(evaluations: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    """Union of evaluation tables with ``method`` (index) and ``method_name`` columns."""
    out = None
    for i, (e, n) in enumerate(zip(evaluations, names)):
        t = e.select(F.lit(i).alias("method"), F.lit(n).alias("method_name"), *e.columns)
        out = t if out is None else out.unionByName(t)
    return out


def test_rows(stacked: DataFrame) -> DataFrame:
    """F6 on stacked evaluations: rows with a test label."""
    return stacked.filter(F.col("y_test").isNotNull())


def _later_methods(methods: Sequence[int], method):
    """For a row of ``method``: the methods after it, each making a pair with it."""
    every = F.array(*[F.struct(F.lit(i).alias("a"), F.lit(j).alias("b")) for i in methods for j in methods if i < j])
    return F.transform(F.filter(every, lambda p: p["a"] == method), lambda p: p["b"])


def pair_overlap(stacked: DataFrame, methods: Sequence[int], n: int = TOP_PER_SYNSET) -> DataFrame:
    """For each split and method pair (a, b), the mean over the synsets of the first
    method's evaluation (``y_train`` values, -1 included) of |A∩B| / max(|A|, |B|), where A
    and B are the top-n test words by confidence predicted as the synset (0 if a side has
    none), and the total number of shared words.

    ``methods`` are the method numbers of ``stacked``.
    Output ``(split_id, method_a, method_b, mean_overlap, shared_words)``.
    """
    tests = test_rows(stacked)
    w = Window.partitionBy("split_id", "method", "y_pred").orderBy(F.round("y_conf", RANK_DECIMALS).desc(), F.col("word").asc())
    top = tests.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    top = top.select("split_id", "method", F.col("y_pred").alias("synset"), "word")
    sizes = top.groupBy("split_id", "method", "synset").agg(F.count(F.lit(1)).alias("size"))
    a = top.select(
        "split_id", F.col("method").alias("method_a"), F.explode(_later_methods(methods, F.col("method"))).alias("method_b"), "synset", "word"
    )
    b = top.withColumnRenamed("method", "method_b")
    shared = (
        a.join(b, ["split_id", "method_b", "synset", "word"])
        .groupBy("split_id", "method_a", "method_b", "synset")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    pairs = [(i, j) for i in methods for j in methods if i < j]
    synsets = stacked.filter(F.col("method") == min(methods)).select("split_id", F.col("y_train").alias("synset")).distinct()
    per_pair = synsets.select(
        "split_id",
        "synset",
        F.explode(F.array(*[F.struct(F.lit(i).alias("method_a"), F.lit(j).alias("method_b")) for i, j in pairs])).alias("p"),
    ).select("split_id", "synset", "p.method_a", "p.method_b")
    sa = sizes.select("split_id", F.col("method").alias("method_a"), "synset", F.col("size").alias("size_a"))
    sb = sizes.select("split_id", F.col("method").alias("method_b"), "synset", F.col("size").alias("size_b"))
    joined = (
        per_pair.join(sa, ["split_id", "method_a", "synset"], "left")
        .join(sb, ["split_id", "method_b", "synset"], "left")
        .join(shared, ["split_id", "method_a", "method_b", "synset"], "left")
    )
    both = F.col("size_a").isNotNull() & F.col("size_b").isNotNull()
    ratio = F.when(both, F.coalesce(F.col("shared"), F.lit(0)) / F.greatest("size_a", "size_b")).otherwise(0.0)
    return joined.groupBy("split_id", "method_a", "method_b").agg(
        F.avg(ratio).alias("mean_overlap"),
        F.sum(F.when(both, F.coalesce(F.col("shared"), F.lit(0))).otherwise(0)).cast("long").alias("shared_words"),
    )


def pair_combined_accuracy(stacked: DataFrame, methods: Sequence[int]) -> DataFrame:
    """For each split and method pair, over all test words of the first method: the share
    both predict equally (neither -1) and the share where at least one of them is right.
    A word that the second method lacks counts with the first method's prediction alone.

    Output ``(split_id, method_a, method_b, equal_predictions, combined_accuracy)``.
    """
    tests = test_rows(stacked).select("split_id", "method", "word", "y_pred", "y_test")
    a = tests.select(
        "split_id",
        F.col("method").alias("method_a"),
        F.explode(_later_methods(methods, F.col("method"))).alias("method_b"),
        "word",
        F.col("y_pred").alias("pred_a"),
        "y_test",
    )
    b = tests.select("split_id", F.col("method").alias("method_b"), "word", F.col("y_pred").alias("pred_b"))
    j = a.join(b, ["split_id", "method_b", "word"], "left")
    equal = (F.col("pred_a") != -1) & (F.col("pred_b") != -1) & (F.col("pred_a") == F.col("pred_b"))
    right = (F.col("pred_a") == F.col("y_test")) | F.coalesce(F.col("pred_b") == F.col("y_test"), F.lit(False))
    return j.groupBy("split_id", "method_a", "method_b").agg(
        F.avg(F.when(equal, 1.0).otherwise(0.0)).alias("equal_predictions"),
        F.avg(F.when(right, 1.0).otherwise(0.0)).alias("combined_accuracy"),
    )


def chosen_words(evaluation: DataFrame, synsets: DataFrame, topx: int) -> DataFrame:
    """Train words of the chosen synsets, then the top-x suggestions of each
    (``y_train != s`` and ``y_pred == s``, by confidence); distinct words."""
    chosen = synsets.select(F.col("synset"))
    train = evaluation.join(chosen.withColumnRenamed("synset", "y_train"), "y_train", "left_semi").select("word")
    cand = evaluation.filter(F.col("y_train") != F.col("y_pred")).join(
        chosen.withColumnRenamed("synset", "y_pred"), "y_pred", "left_semi"
    )
    w = Window.partitionBy("y_pred").orderBy(F.round("y_conf", RANK_DECIMALS).desc(), F.col("word").asc())
    sugg = cand.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= topx).select("word")
    return train.unionByName(sugg).distinct()


def word_labels(left_eval: DataFrame, right_eval: DataFrame, synsets: DataFrame, topx: int = 50) -> DataFrame:
    """Each chosen word labelled ``training`` (train word of a chosen synset, wins),
    else ``left_only`` / ``right_only`` / ``both`` by the method that chose it."""
    lw = chosen_words(left_eval, synsets, topx).withColumn("_l", F.lit(True))
    rw = chosen_words(right_eval, synsets, topx).withColumn("_r", F.lit(True))
    merged = lw.join(rw, "word", "full")
    training = left_eval.join(synsets.select(F.col("synset").alias("y_train")), "y_train", "left_semi").select(
        "word", F.lit(True).alias("_t")
    )
    labelled = merged.join(training.distinct(), "word", "left")
    label = (
        F.when(F.col("_t"), "training")
        .when(F.col("_l") & F.col("_r"), "both")
        .when(F.col("_l"), "left_only")
        .otherwise("right_only")
    )
    return labelled.select("word", label.alias("label"))


def ordered_labels(labels: DataFrame) -> DataFrame:
    """V2: the labelled words in the order of their labels (alphabetical), then by word."""
    return labels.orderBy("label", "word")


def projector_rows(labels: DataFrame, vectors: DataFrame) -> DataFrame:
    """Transliterated word, label and the whole vector."""
    j = labels.join(vectors.select("word", "vector"), "word", "left")
    return j.select(transliterate(F.col("word").cast("string")).alias("word"), "label", "vector")


# --- run results ----------------------------------------------------------------

def runs_table(runs: DataFrame) -> DataFrame:
    """Mean accuracy by iteration (rows) and series (columns)."""
    return runs.groupBy("iter").pivot("series").agg(F.first("mean_accuracy"))


def select_runs(
    runs: DataFrame,
    positive: Sequence[str],
    negative: Sequence[str],
    dynamic: Sequence[str],
    take_first_of_two: bool = False,
) -> DataFrame:
    """per dynamic string, the one run whose ``params`` text contains all positive strings,
    none of the negative ones and the dynamic string.  No match, or more than one, is an error
    (two are allowed with ``take_first_of_two``; the first by ``run_id`` is kept).

    Output ``(dynamic, run_id, mean_accuracy)``.
    """
    cond = F.lit(True)
    for p in positive:
        cond = cond & F.contains(F.col("params"), F.lit(p))
    for n in negative:
        cond = cond & ~F.contains(F.col("params"), F.lit(n))
    base = runs.filter(cond)
    tagged = base.select(
        "*", F.explode(F.filter(F.array(*[F.lit(d) for d in dynamic]), lambda d: F.contains(F.col("params"), d))).alias("dynamic")
    )
    # one row for each of the caller's strings
    found = {r["dynamic"]: r["count"] for r in tagged.groupBy("dynamic").count().collect()}
    for d in dynamic:
        n = found.get(d, 0)
        if n != 1 and not (n == 2 and take_first_of_two):
            raise ValueError(f"{n} runs match {d!r}")
    w = Window.partitionBy("dynamic").orderBy("run_id")
    ranked = tagged.withColumn("_r", F.row_number().over(w))
    return ranked.filter(F.col("_r") == 1).select("dynamic", "run_id", "mean_accuracy")


# --- column conventions ---------------------------------------------------------

def seeded_view(vocabulary: DataFrame, train: DataFrame) -> DataFrame:
    """Vocabulary words with ``y_train`` (-1 when absent) and the constant top-3."""
    return vocabulary.select("word").join(
        train.select("word", F.col("synset").alias("y_train")), "word", "left"
    ).select(
        "word",
        F.coalesce(F.col("y_train"), F.lit(-1)).cast("int").alias("y_train"),
        F.array(F.lit(-1), F.lit(-1), F.lit(-1)).alias("y_top3_classes"),
    )
