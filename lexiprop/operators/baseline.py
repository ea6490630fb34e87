"""Nearest-vector baseline, its k sweep, top-3 report and bipartite graph.

A synset vector is the normalised mean of the unit vectors of the synset's
train words.  Its k most similar words (own train words excluded) come from
the blocked similarity join, partitioned by ``split_id`` so every seed runs in
the same job.  Every per-word choice below is an aggregation (max of a struct),
never a window over a word or a synset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiprop.functions.text import synset_node_name
from lexiprop.functions.vectors import l2_normalize
from lexiprop.operators.evaluate import evaluation_table
from lexiprop.operators.similarity import similarity_join
from lexiprop.operators.splits import test_part, train_part
from lexiprop.session import cut_lineage

NO_SIMILARITY = -100.0  # fixed value: confidence of a word no synset reached
SWEEP_KS = (2, 4, 6, 8, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 22, 24, 26, 28, 30)  # fixed values
RANK_DECIMALS = 9


def synset_vectors(unit_vectors: DataFrame, split: DataFrame) -> DataFrame:
    """E5: ``(split_id, synset, vector)``, the normalised mean of the train words' unit vectors.

    The mean is an aggregation per (split, synset, dimension), so large synsets
    are combined map-side.
    """
    train = train_part(split)
    comps = train.join(unit_vectors.select("word", "vector"), "word").select(
        "split_id", "synset", F.posexplode("vector").alias("i", "x")
    )
    means = comps.groupBy("split_id", "synset", "i").agg(F.avg("x").alias("x"))
    vecs = means.groupBy("split_id", "synset").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("_v"))
    return vecs.select("split_id", "synset", l2_normalize(F.transform("_v", lambda e: e["x"])).alias("vector"))


def synset_topk(unit_vectors: DataFrame, split: DataFrame, k: int) -> DataFrame:
    """``(split_id, synset, word, similarity, rank)``: the k words most similar to each synset vector.

    Only the synset's own train words are excluded (train words of other
    synsets can be suggested).
    """
    sv = synset_vectors(unit_vectors, split)
    own = train_part(split).select("split_id", "word", F.col("synset").alias("own"))
    ids = sorted(r[0] for r in split.select("split_id").distinct().collect())  # bounded: one value per seed
    words = unit_vectors.select(
        F.explode(F.array(*[F.lit(s) for s in ids])).alias("split_id"), "word", "vector"
    ).join(own, ["split_id", "word"], "left")
    pairs = similarity_join(
        sv.withColumn("own", F.col("synset")),
        words,
        left_id="synset",
        right_id="word",
        metric="dot",
        k=k,
        exclude_key="own",
        by="split_id",
    )
    return pairs.select(
        "split_id",
        F.col("src").alias("synset"),
        F.col("dst").alias("word"),
        F.col("score").alias("similarity"),
        "rank",
    )


def assign_best_synset(topk: DataFrame, group_cols: Sequence[str] = ("split_id",)) -> DataFrame:
    """Per word the synset with the highest similarity; ties keep the smaller synset id."""
    best = F.max(F.struct(F.round("similarity", RANK_DECIMALS).alias("r"), (-F.col("synset")).alias("ns"), F.col("similarity").alias("s")))
    return topk.groupBy(*group_cols, "word").agg(best.alias("_b")).select(
        *group_cols, "word", (-F.col("_b.ns")).cast("int").alias("y_pred"), F.col("_b.s").alias("y_conf")
    )


def baseline_predictions(unit_vectors: DataFrame, split: DataFrame, k: int) -> DataFrame:
    """A17 + J3: every vocabulary word per split with its baseline prediction; unreached words get -1 / -100.0."""
    best = assign_best_synset(synset_topk(unit_vectors, split, k))
    ids = sorted(r[0] for r in split.select("split_id").distinct().collect())
    vocab = unit_vectors.select(F.explode(F.array(*[F.lit(s) for s in ids])).alias("split_id"), "word")
    return vocab.join(best, ["split_id", "word"], "left").select(
        "split_id",
        "word",
        F.coalesce("y_pred", F.lit(-1)).cast("int").alias("y_pred"),
        F.coalesce("y_conf", F.lit(NO_SIMILARITY)).alias("y_conf"),
        F.array(F.lit(-1), F.lit(-1), F.lit(-1)).alias("y_top3_classes"),  # T22
    )


def baseline_evaluation(unit_vectors: DataFrame, split: DataFrame, k: int) -> DataFrame:
    """The baseline's evaluation table (constant top-3 column, so within-top-3 is 0)."""
    return evaluation_table(baseline_predictions(unit_vectors, split, k), split)


def reached(evaluation: DataFrame) -> DataFrame:
    """words some synset reached (confidence is not the -100 sentinel)."""
    return evaluation.filter(F.col("y_conf") != NO_SIMILARITY)


def k_sweep(unit_vectors: DataFrame, split: DataFrame, ks: Sequence[int] = SWEEP_KS) -> DataFrame:
    """Accuracy for every k, mean over splits: ``(k, mean_accuracy, accuracies)``.

    The similarity join runs once for the largest k; each k keeps the ranks up
    to k (a literal list exploded on the rows, no join), then A17 and the
    accuracy are aggregations keyed by ``(split_id, k)``.
    """
    ks = sorted(set(int(k) for k in ks))
    topk = synset_topk(unit_vectors, split, max(ks))
    per_k = topk.select(
        "*", F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("rank"))).alias("k")
    )
    best = assign_best_synset(per_k, ("split_id", "k"))
    tests = (
        test_part(split)
        .join(unit_vectors.select("word"), "word", "left_semi")
        .select("split_id", "word", F.col("synset").alias("y_test"), F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    )
    acc = (
        tests.join(best, ["split_id", "k", "word"], "left")
        .groupBy("split_id", "k")
        .agg(F.avg(F.when(F.col("y_pred") == F.col("y_test"), 1.0).otherwise(0.0)).alias("accuracy"))
    )
    return acc.groupBy("k").agg(
        F.avg("accuracy").alias("mean_accuracy"),
        F.transform(F.sort_array(F.collect_list(F.struct("split_id", "accuracy"))), lambda x: x["accuracy"]).alias(
            "accuracies"
        ),
    )


def top3_report(unit_vectors: DataFrame, split: DataFrame, k: int = 200) -> DataFrame:
    """Per split, share of test words whose label is the first / among the top 3
    suggested synsets, and the number of test words without any suggestion."""
    topk = synset_topk(unit_vectors, split, k)
    w = Window.partitionBy("split_id", "word").orderBy(F.round("similarity", RANK_DECIMALS).desc(), F.col("synset").asc())
    top = topk.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 3)
    lists = top.groupBy("split_id", "word").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_r", "synset"))), lambda x: x["synset"]).alias("top3")
    )
    tests = test_part(split).select("split_id", "word", F.col("synset").alias("y_test"))
    joined = tests.join(lists, ["split_id", "word"], "left")
    has = F.col("top3").isNotNull()
    return joined.groupBy("split_id").agg(
        F.avg(F.when(has & F.array_contains("top3", F.col("y_test")), 1.0).otherwise(0.0)).alias("within_top3_mean"),
        F.avg(F.when(has & (F.col("top3")[0] == F.col("y_test")), 1.0).otherwise(0.0)).alias("top1_mean"),
        F.count(F.when(~has, 1)).alias("no_predictions"),
    )


def bipartite_edges(topk: DataFrame) -> DataFrame:
    """Undirected synset-word edges weighted by similarity, node key ``synset_<id>`` / word."""
    syn = synset_node_name(F.col("synset"))
    word = F.col("word").cast("string")
    w = F.col("similarity")
    both = F.array(
        F.struct(syn.alias("src"), word.alias("dst"), w.alias("weight")),
        F.struct(word.alias("src"), syn.alias("dst"), w.alias("weight")),
    )
    return topk.select("split_id", F.explode(both).alias("e")).select("split_id", "e.*")


def bipartite_spreading(
    unit_vectors: DataFrame,
    split: DataFrame,
    k: int = 200,
    alpha: float = 0.2,
    iterations: int = 15,
    checkpoint_every: int = 5,
) -> DataFrame:
    """Label spreading on the synset-word graph, seeds on synset nodes only;
    returns the evaluation table of the word nodes."""
    from lexiprop.operators.propagate import finalize, label_spreading

    topk = synset_topk(unit_vectors, split, k)
    edges = bipartite_edges(topk)
    ids = sorted(r[0] for r in split.select("split_id").distinct().collect())
    words = unit_vectors.select(
        F.explode(F.array(*[F.lit(s) for s in ids])).alias("split_id"),
        F.col("word").cast("string").alias("word"),
        F.lit(-1).alias("y_train"),
    )
    synsets = train_part(split).select("split_id", "synset").distinct().select(
        "split_id", synset_node_name(F.col("synset")).alias("word"), F.col("synset").cast("int").alias("y_train")
    )
    labels = cut_lineage(synsets.unionByName(words))  # read by every step's seeds and the final join
    state = label_spreading(edges, labels, iterations, alpha, checkpoint_every)
    preds = finalize(state, labels).join(words.select("split_id", "word"), ["split_id", "word"], "left_semi")
    word_type = unit_vectors.schema["word"].dataType
    preds = preds.withColumn("word", F.col("word").cast(word_type))
    return evaluation_table(preds, split)
