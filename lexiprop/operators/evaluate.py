"""Evaluation table and statistics.

All statistics are grouped by ``split_id`` so one job evaluates every seed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiprop.functions.ranking import class_type
from lexiprop.operators.splits import test_part, train_part
from lexiprop.session import cut_lineage


def evaluation_table(predictions: DataFrame, split: DataFrame) -> DataFrame:
    """Predictions left-joined with train (-1 when absent) and test (NULL when absent).

    ``predictions`` carries ``split_id, word, y_pred, y_conf, y_top3_classes``.
    """
    kind = class_type((split, "synset"), (predictions, "y_pred"))
    train = train_part(split).select("split_id", "word", F.col("synset").alias("_train"))
    test = test_part(split).select("split_id", "word", F.col("synset").cast(kind).alias("y_test"))
    preds = predictions.drop("y_train")
    return (
        preds.join(train, ["split_id", "word"], "left")
        .join(test, ["split_id", "word"], "left")
        .select(
            "split_id",
            "word",
            F.coalesce(F.col("_train"), F.lit(-1)).cast(kind).alias("y_train"),
            F.col("y_pred").cast(kind).alias("y_pred"),
            "y_conf",
            "y_top3_classes",
            "y_test",
        )
    )


def group_sizes(evaluation: DataFrame) -> DataFrame:
    """A5: predicted group sizes per split (excluding -1, over all words)."""
    return (
        evaluation.filter(F.col("y_pred") != -1)
        .groupBy("split_id", "y_pred")
        .agg(F.count(F.lit(1)).alias("n_words"))
    )


def group_size_stats(evaluation: DataFrame) -> DataFrame:
    """describe() of the group sizes, their sum and the largest group's id.

    One row per split; the size table has one row per predicted synset.
    """
    sizes = group_sizes(evaluation)
    q = F.percentile(F.col("n_words"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    largest = F.max(F.struct(F.col("n_words"), (-F.col("y_pred")).alias("neg_id")))
    return sizes.groupBy("split_id").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("n_words").alias("mean"),
        F.stddev_samp("n_words").alias("std"),
        F.min("n_words").cast("double").alias("min"),
        q.alias("_q"),
        F.max("n_words").cast("double").alias("max"),
        F.sum("n_words").alias("sum_preds"),
        (-largest["neg_id"]).cast(class_type((evaluation, "y_pred"))).alias("max_group_id"),
    ).select(
        "split_id",
        "count",
        "mean",
        "std",
        "min",
        F.col("_q")[0].alias("p25"),
        F.col("_q")[1].alias("p50"),
        F.col("_q")[2].alias("p75"),
        "max",
        "sum_preds",
        "max_group_id",
    )


def test_stats(evaluation: DataFrame) -> DataFrame:
    """Accuracy, mean confidences, within-top-3 share and counts per split."""
    is_test = F.col("y_test").isNotNull()
    right = is_test & (F.col("y_pred") == F.col("y_test"))
    wrong = is_test & (F.col("y_pred") != F.col("y_test"))
    return evaluation.groupBy("split_id").agg(
        F.avg(F.when(is_test, F.when(right, 1.0).otherwise(0.0))).alias("accuracy"),
        F.avg(F.when(right, F.col("y_conf"))).alias("mean_conf_true"),
        F.avg(F.when(wrong, F.col("y_conf"))).alias("mean_conf_false"),
        F.avg(
            F.when(is_test, F.when(F.array_contains("y_top3_classes", F.col("y_test")), 1.0).otherwise(0.0))
        ).alias("mean_within_top3"),
        F.count(F.lit(1)).alias("count_all_words"),
        F.count(F.when(F.col("y_train") != -1, 1)).alias("count_train_set"),
        F.count(F.when(is_test, 1)).alias("count_test_set"),
        F.count(F.when(right, 1)).alias("count_correctly_predicted"),
    )


def evaluate(evaluation: DataFrame, materialize: bool = True) -> DataFrame:
    """A1: every statistic of a run in one row per split (flat columns).

    The evaluation table feeds two aggregations; with ``materialize`` it is
    written to the checkpoint folder once instead of being recomputed per branch.
    """
    if materialize:
        evaluation = cut_lineage(evaluation)
    return test_stats(evaluation).join(group_size_stats(evaluation), "split_id", "left")


def evaluate_nested(evaluation: DataFrame) -> DataFrame:
    """A1 in the nested layout of the reference's ``stats.json`` (one row per split)."""
    flat = evaluate(evaluation)
    return flat.select(
        "split_id",
        "accuracy",
        F.struct("mean_conf_true", "mean_conf_false").alias("conf_stats"),
        "mean_within_top3",
        F.struct(
            "count", "mean", "std", "min",
            F.col("p25").alias("25%"), F.col("p50").alias("50%"), F.col("p75").alias("75%"),
            "max", "sum_preds", "max_group_id",
        ).alias("pred_synsets_stats"),
        F.struct("count_all_words", "count_train_set", "count_test_set", "count_correctly_predicted").alias(
            "test_stats"
        ),
    )


def mean_over_splits(stats: DataFrame, group_cols: list[str] | None = None, metric: str = "accuracy") -> DataFrame:
    """A10: mean accuracy over splits and the per-split list ordered by split id."""
    group_cols = group_cols or []
    return stats.groupBy(*group_cols).agg(
        F.avg(metric).alias("mean_accuracy"),
        F.transform(
            F.sort_array(F.collect_list(F.struct("split_id", metric))), lambda x: x[metric]
        ).alias("accuracies"),
    )


def sort_evaluation(evaluation: DataFrame, by: str = "word") -> DataFrame:
    """The evaluation in the order of its words, or by falling confidence (ties by word)."""
    if by == "word":
        return evaluation.orderBy("word")
    if by == "confidence":
        return evaluation.orderBy(F.round("y_conf", 9).desc(), F.col("word").asc())
    raise ValueError(by)
