"""Iterative label diffusion over the graph as joins and aggregations.

The label distribution is a sparse long table ``state(split_id, word, synset,
score)``; only non-zero scores exist.  One step is one equi-join of the
(persisted) edge table with the state on the edge target and one ``groupBy``
sum on the edge source — a sparse matrix product.  Every ``checkpoint_every``
steps (every step of a graph with ``STEP_EDGES`` edges), and after the last, the state is written to the reliable checkpoint folder, so the
plan stays small and a lost executor only recomputes the last few steps; the state before it and, in the end, the
written graph are removed, as nobody reads them any more.  The edges of hub
nodes are dealt into parts, and only the hubs' state is repeated for them.

Several splits (seeds) run in the same job: ``split_id`` is part of every key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiprop.functions.ranking import class_type
from lexiprop.operators.graph import symmetric_normalized, transition
from lexiprop.session import cut_lineage, forget

METHODS = ("label_propagation", "label_spreading")
RANK_DECIMALS = 9  # ties: round(conf, 9) desc, synset asc
HUB_SHARE, HUB_FACTOR = 1000, 20
STEP_EDGES = 1 << 20  # edges from which on every step is written, as the shuffles of several would fill the disk


def seed_labels(nodes: DataFrame, train: DataFrame, split_ids: Sequence[int]) -> DataFrame:
    """Every graph node per split with its train label, -1 if none."""
    per_split = nodes.select(
        F.explode(F.array(*[F.lit(int(s)) for s in split_ids])).alias("split_id"), "word"
    )
    return (
        per_split.join(train.select("split_id", "word", "synset"), ["split_id", "word"], "left")
        .select("split_id", "word", F.coalesce(F.col("synset"), F.lit(-1)).cast(class_type((train, "synset"))).alias("y_train"))
    )


def one_hot(labels: DataFrame) -> DataFrame:
    """L2: the seed state, one row with score 1.0 per labelled node."""
    return labels.filter(F.col("y_train") != -1).select(
        "split_id", "word", F.col("y_train").alias("synset"), F.lit(1.0).alias("score")
    )


def split_hubs(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges`` with a ``part`` number, and the hubs ``(dst, parts)``.

    A hub is a node with over 1/HUB_SHARE of all edges and over HUB_FACTOR times the mean
    number of edges into a node (so there are fewer than HUB_SHARE hubs, at any size). Its
    edges are dealt into parts by their source; the other nodes have one part.
    """
    degrees = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    total, nodes = degrees.agg(F.sum("n"), F.count(F.lit(1))).first()
    least = max((total or 0) / HUB_SHARE, HUB_FACTOR * (total or 0) / max(nodes, 1))
    hubs = degrees.filter(F.col("n") > least).select("dst", F.ceil(F.col("n") / F.lit(max(least, 1.0))).cast("int").alias("parts"))
    hubs = cut_lineage(hubs)
    part = F.pmod(F.xxhash64("src"), F.coalesce("parts", F.lit(1))).cast("int")
    return edges.join(F.broadcast(hubs), "dst", "left").withColumn("part", part).drop("parts"), hubs


def _meet(edges: DataFrame, state: DataFrame, hubs: DataFrame) -> DataFrame:
    """Edges joined with the state of their targets; the state of a hub goes to each of its parts."""
    parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    spread = state.withColumnRenamed("word", "dst").join(F.broadcast(hubs), "dst", "left").withColumn("part", F.explode(parts)).drop("parts")
    return edges.join(spread, [c for c in ("split_id", "dst", "part") if c in edges.columns])


def _partitioned(edges: DataFrame) -> DataFrame:
    """The edges where every step meets them."""
    keys = [c for c in ("split_id", "dst", "part") if c in edges.columns]
    return edges.repartition(*keys).persist(StorageLevel.MEMORY_AND_DISK)


def _replaced(state: DataFrame, spent: list[DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """The state, written; the one that was written before goes."""
    now = cut_lineage(state)
    forget(*spent)
    return now, [now]


def label_propagation(
    edges: DataFrame,
    labels: DataFrame,
    iterations: int = 3,
    checkpoint_every: int = 5,
) -> DataFrame:
    """Y <- D^-1 A Y, then labelled rows reset to their seeds; returns the state."""
    seeds = one_hot(labels)
    # the graph is read by the degree aggregates and by the join: written once
    written = cut_lineage(edges)
    p, hubs = split_hubs(transition(written))
    p = _partitioned(p)
    labelled = seeds.select("split_id", "word")
    state, spent = seeds, []
    often = 1 if written.count() >= STEP_EDGES else checkpoint_every
    for step in range(1, iterations + 1):
        moved = (
            _meet(p, state, hubs)
            .groupBy("split_id", F.col("src").alias("word"), "synset")
            .agg(F.sum(F.col("p") * F.col("score")).alias("score"))
        )
        # labelled rows are reset every step
        state = moved.join(labelled, ["split_id", "word"], "left_anti").unionByName(seeds)
        if step == iterations or often and step % often == 0:
            state, spent = _replaced(state, spent)
    p.unpersist()
    forget(written)
    return state


def label_spreading(
    edges: DataFrame,
    labels: DataFrame,
    iterations: int = 3,
    alpha: float = 0.2,
    checkpoint_every: int = 5,
) -> DataFrame:
    """Y <- alpha S Y + (1 - alpha) Y0 (seeds mixed, not clamped); returns the state."""
    seeds = one_hot(labels)
    # the graph is read by the degree aggregates and by the joins: written once
    written = cut_lineage(edges)
    s, hubs = split_hubs(symmetric_normalized(written))
    s = _partitioned(s)
    base = seeds.select("split_id", "word", "synset", (F.col("score") * (1.0 - alpha)).alias("score"))
    state, spent = seeds, []
    often = 1 if written.count() >= STEP_EDGES else checkpoint_every
    for step in range(1, iterations + 1):
        moved = _meet(s, state, hubs).select(
            "split_id", F.col("src").alias("word"), "synset", (F.lit(alpha) * F.col("s") * F.col("score")).alias("score")
        )
        state = (
            moved.unionByName(base)
            .groupBy("split_id", "word", "synset")
            .agg(F.sum("score").alias("score"))
        )
        if step == iterations or often and step % often == 0:
            state, spent = _replaced(state, spent)
    s.unpersist()
    forget(written)
    return state


def finalize(state: DataFrame, labels: DataFrame) -> DataFrame:
    """L8-L11 (+L10 via ``labels``' nodes): confidences, argmax and top-3 per node.

    Output ``(split_id, word, y_train, y_pred, y_conf, y_top3_classes)``.
    """
    kind = class_type((state, "synset"))
    w_word = Window.partitionBy("split_id", "word")
    conf = state.withColumn(
        "conf",
        F.coalesce(F.try_divide(F.col("score"), F.sum("score").over(w_word)), F.lit(0.0)),
    )
    w_rank = w_word.orderBy(F.round("conf", RANK_DECIMALS).desc(), F.col("synset").asc())
    top = conf.withColumn("_r", F.row_number().over(w_rank)).filter(F.col("_r") <= 3)
    agg = top.groupBy("split_id", "word").agg(
        F.sort_array(F.collect_list(F.struct("_r", "synset", "conf"))).alias("_top")
    )
    first = F.col("_top")[0]
    top3 = F.transform(F.col("_top"), lambda x: F.when(x["conf"] != 0.0, x["synset"]).otherwise(F.lit(-1)))
    padded = F.concat(top3, F.array_repeat(F.lit(-1), F.lit(3) - F.size(top3)))
    preds = agg.select(
        "split_id",
        "word",
        F.when(first["conf"] != 0.0, first["synset"]).otherwise(F.lit(-1)).cast(kind).alias("y_pred"),
        first["conf"].alias("y_conf"),
        padded.cast(f"array<{kind}>").alias("y_top3_classes"),
    )
    return labels.join(preds, ["split_id", "word"], "left").select(
        "split_id",
        "word",
        "y_train",
        F.coalesce(F.col("y_pred"), F.lit(-1)).cast(kind).alias("y_pred"),
        F.coalesce(F.col("y_conf"), F.lit(0.0)).alias("y_conf"),
        F.coalesce(F.col("y_top3_classes"), F.array(F.lit(-1), F.lit(-1), F.lit(-1))).alias("y_top3_classes"),
    )


def propagate(
    edges: DataFrame,
    labels: DataFrame,
    method: str = "label_propagation",
    iterations: int = 3,
    alpha: float = 0.2,
    checkpoint_every: int = 5,
) -> DataFrame:
    """Method dispatch; an unknown method raises like the reference.

    ``labels`` (one row per node and split) feed the seeds of every step and the
    final join, so they are written to the checkpoint folder once.
    """
    if method not in METHODS:
        raise NotImplementedError(method)
    labels = cut_lineage(labels)
    if method == "label_propagation":
        state = label_propagation(edges, labels, iterations, checkpoint_every)
    elif method == "label_spreading":
        state = label_spreading(edges, labels, iterations, alpha, checkpoint_every)
    else:
        raise NotImplementedError(method)
    return finalize(state, labels)
