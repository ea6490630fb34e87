"""Selection of suggestions for human review and the scoring of reviewed sheets
(F8, F10, A16, J6, R3-R7, P6, P7, S12, U2, A19, A20, T17).

The evaluation table is the input (``split_id, word, y_train, y_pred, y_conf,
y_top3_classes, y_test``).  Per-synset ranking uses ``row_number() <= n``,
which Spark limits map-side (``WindowGroupLimit``), so a synset predicted for a
third of all words still ships only n rows per partition to the window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiprop.functions.ranking import average_rank, seeded_hash
from lexiprop.session import cut_lineage

# Band cut-offs of the two studies and the group layout.
MAIN_STUDY_CUTS = (0.20, 0.40, 0.60, 0.80)
PRE_STUDY_CUTS = (0.10, 0.45, 0.55, 0.90)
BANDS = ("low", "mid", "high")
CONF_ORDERS = ("high_first", "low_first", "random")
SUGGESTIONS_PER_SYNSET = 10
MIN_PRED_EXTRA_GROUP = 10
RANK_DECIMALS = 9


def sanity_counts(evaluation: DataFrame) -> DataFrame:
    """F8: rows without train label, test label and prediction; test rows without prediction."""
    no_train = F.col("y_train") == -1
    no_pred = F.col("y_pred") == -1
    return evaluation.groupBy("split_id").agg(
        F.count(F.when(no_train & F.col("y_test").isNull() & no_pred, 1)).alias("n_without_anything"),
        F.count(F.when(no_train & F.col("y_test").isNotNull() & no_pred, 1)).alias("n_test_without_prediction"),
    )


def synset_counts(evaluation: DataFrame) -> DataFrame:
    """Train words per synset (-1 excluded) with predicted words per synset (all words)."""
    train = (
        evaluation.filter(F.col("y_train") != -1)
        .groupBy("split_id", F.col("y_train").alias("synset"))
        .agg(F.count(F.lit(1)).alias("n_train"))
    )
    pred = evaluation.groupBy("split_id", F.col("y_pred").alias("synset")).agg(F.count(F.lit(1)).alias("n_pred"))
    return train.join(pred, ["split_id", "synset"], "left")


def quantile_bands(counts: DataFrame, cuts: Sequence[float] = MAIN_STUDY_CUTS) -> DataFrame:
    """Per synset the low/mid/high bands of its train and predicted counts (inclusive bounds).

    Cut-offs are linear-interpolation quantiles over the synsets of a split
    (missing predicted counts are skipped, as in pandas).  A synset can be in
    several bands.
    """
    lo, mid_a, mid_b, hi = cuts
    probs = F.array(*[F.lit(float(c)) for c in cuts])
    q = counts.groupBy("split_id").agg(
        F.percentile("n_train", probs).alias("qt"), F.percentile("n_pred", probs).alias("qp")
    )
    with_q = counts.join(q, "split_id")

    def bands(col: str, qcol: str):
        v = F.col(col)
        return (
            (v <= F.col(qcol)[0]).alias(f"{col}_low"),
            ((v >= F.col(qcol)[1]) & (v <= F.col(qcol)[2])).alias(f"{col}_mid"),
            (v >= F.col(qcol)[3]).alias(f"{col}_high"),
        )

    return with_q.select("split_id", "synset", "n_train", "n_pred", *bands("n_train", "qt"), *bands("n_pred", "qp"))


def review_groups(banded: DataFrame, extra_group: bool = False) -> DataFrame:
    """``(split_id, group, synset, n_train, n_pred)`` for the nine band pairs g1..g9
    (train band major); rows with a missing count are dropped.  ``extra_group``
    adds g10: high train band and at least 10 predicted words."""
    complete = banded.filter(F.col("n_pred").isNotNull())
    members = []
    for ti, tb in enumerate(BANDS):
        for pi, pb in enumerate(BANDS):
            g = ti * 3 + pi + 1
            members.append(F.when(F.col(f"n_train_{tb}") & F.col(f"n_pred_{pb}"), F.lit(g)))
    if extra_group:
        members.append(F.when(F.col("n_train_high") & (F.col("n_pred") >= MIN_PRED_EXTRA_GROUP), F.lit(10)))
    groups = F.filter(F.array(*members), lambda x: x.isNotNull())
    return complete.select("split_id", F.explode(groups).alias("group"), "synset", "n_train", "n_pred")


def sample_groups(groups: DataFrame, per_group: int, seed: int) -> DataFrame:
    """``per_group`` synsets from every group, no synset in two groups.

    Deterministic replacement of the reference's rejection loop: groups are
    served in order; each takes its ``per_group`` lowest-hash synsets not yet
    taken by an earlier group (short groups keep what is left).  The loop runs
    once per group (a fixed, small number), each step an anti join.
    """
    # the membership table (one row per synset and group) is written once, and so is
    # every pick, so each step's plan is a scan plus one anti join (no plan growth)
    hashed = cut_lineage(groups.withColumn("_h", seeded_hash(F.lit(seed), F.col("synset"))))
    group_ids = sorted(r[0] for r in hashed.select("group").distinct().collect())  # at most 10 values
    taken = None
    picks = []
    w = Window.partitionBy("split_id").orderBy("_h")
    for g in group_ids:
        cand = hashed.filter(F.col("group") == g)
        if taken is not None:
            cand = cand.join(taken, ["split_id", "synset"], "left_anti")
        pick = cut_lineage(cand.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= per_group))
        picks.append(pick)
        chosen = pick.select("split_id", "synset")
        taken = chosen if taken is None else taken.unionByName(chosen)
    out = picks[0]
    for p in picks[1:]:
        out = out.unionByName(p)
    return out.drop("_h")


def suggestions(evaluation: DataFrame, order: str = "high_first", n: int = SUGGESTIONS_PER_SYNSET, seed: int = 1) -> DataFrame:
    """The top-n new words suggested for every synset.

    Suggestions are words predicted as the synset that are not its train words
    (``y_train != y_pred``).  ``order``: confidence descending, ascending, or a
    seeded random order.
    """
    cand = evaluation.filter((F.col("y_train") != F.col("y_pred")) & (F.col("y_pred") != -1))
    if order == "high_first":
        keys = [F.round("y_conf", RANK_DECIMALS).desc(), F.col("word").asc()]
    elif order == "low_first":
        keys = [F.round("y_conf", RANK_DECIMALS).asc(), F.col("word").asc()]
    elif order == "random":
        keys = [seeded_hash(F.lit(seed), F.col("word")).asc()]
    else:
        raise NotImplementedError(order)
    w = Window.partitionBy("split_id", "y_pred").orderBy(*keys)
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(
        "split_id", F.col("y_pred").alias("synset"), "rank", "word", F.col("y_conf").alias("conf")
    )


def review_sheet(evaluation: DataFrame, sample: DataFrame, order: str = "high_first", seed: int = 1) -> DataFrame:
    """Rows of the review sheet for the sampled synsets.

    ``(split_id, group, synset, section, rank, word, conf, remark)``: the
    synset's train words (section ``training``, no rank), then its ranked
    suggestions (section ``suggestion``); the score column is left for the
    reviewer.
    """
    chosen = sample.select(
        "split_id",
        "group",
        "synset",
        F.concat(
            F.lit(f"conf_order: {order}, y_train: "),
            F.col("n_train").cast("string"),
            F.lit(", y_pred: "),
            F.col("n_pred").cast("string"),
        ).alias("remark"),
    )
    train = evaluation.filter(F.col("y_train") != -1).select(
        "split_id", F.col("y_train").alias("synset"), F.lit("training").alias("section"),
        F.lit(None).cast("int").alias("rank"), "word", F.lit(None).cast("double").alias("conf"),
    )
    sugg = suggestions(evaluation, order, seed=seed).select(
        "split_id", "synset", F.lit("suggestion").alias("section"), F.col("rank").cast("int").alias("rank"), "word", "conf"
    )
    rows = train.unionByName(sugg)
    return chosen.join(rows, ["split_id", "synset"]).select(
        "split_id", "group", "synset", "section", "rank", "word", "conf", "remark", F.lit(None).cast("int").alias("score")
    )


# --- scoring of reviewed sheets -----------------------------------------------

def percent(part, total):
    """Percentage with one decimal, rounded half up on the exact ratio (integer arithmetic)."""
    tenths = F.floor((F.lit(2000) * part + total) / (F.lit(2) * total))
    return (tenths / 10.0).alias("percent")


def score_distribution(scores: DataFrame) -> DataFrame:
    """Count and percentage of each score (0, 1, 2)."""
    counts = scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    # one row per distinct score: a window over the whole (tiny) table gives the total
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("score", "n", percent(F.col("n"), total))


def spearman(scores: DataFrame, x: str, y: str = "score") -> DataFrame:
    """Spearman correlation of two columns (Pearson correlation of average ranks)."""
    rx = average_rank(scores.select(x, y), x, "_rx")
    ry = average_rank(rx, y, "_ry")
    return ry.agg(F.corr("_rx", "_ry").alias(f"spearman_{x}"))
