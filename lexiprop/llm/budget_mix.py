"""Mixing sources to target weights by fitting word budgets exactly.

1. Word totals by source give each source's target: weights 5, 2, 1 in turn over the
   sources in code point order (null last) share a budget; a target stops at ``cap`` times
   its source and the excess is shared again by weight.
2. Documents are counted by source and exact word length.
3. For each source the target is whole passes over it plus a rest. Every length first gives
   its proportional share of the rest, rounded down; a knapsack over the lengths and the
   documents left of each then fits all that remains, to the word where any choice of them does.
   Its table is bounded by the longest text; a rest that fits it is met as nearly as any choice can.
4. Documents are chosen by count for each length in a seeded hash order. Long lists are
   numbered in cells, so one length that holds a third of all rows is not ranked in one task.

Defined cases: a null text has 0 words; a document without words is taken by whole passes
only and counts nothing; a null source is a source of its own; rows equal in all columns
are taken as separate documents; an empty table gives no rows; other columns only break ties.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiprop.llm.common import column, join_groups, row_hash, stored, word_count

WEIGHTS = (5, 2, 1)
BUDGET = Fraction(3, 2)
CAP = 2
SEED = 17
#: Least width of the knapsack table in words, and documents numbered in one cell.
KNAPSACK_WORDS = 1 << 16
#: The table has room for two of the longest texts, and for eight where that takes at most so many words.
ROOMY_WORDS = 1 << 23
CELL_ROWS = 4096
#: One row a source goes to the driver; more sources than this are refused, not cut.
MAX_SOURCES = 1_000_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, budget: Fraction = BUDGET, cap: int = CAP) -> list[Fraction]:
    """Each source's target, for source sizes in their order."""
    weight = [Fraction(weights[i % len(weights)]) for i in range(len(sizes))]
    out = [Fraction(0)] * len(sizes)
    left, free = budget * sum(sizes), sum(weight)
    # in order of the level at which a source is full, each gets its share of what is left
    for i in sorted(range(len(sizes)), key=lambda i: cap * sizes[i] / weight[i]):
        out[i] = min(Fraction(cap * sizes[i]), left * weight[i] / free)
        left -= out[i]
        free -= weight[i]
    return out


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length (at most ``counts``) bring the sum nearest to ``budget``."""
    chosen = np.zeros(len(lengths), np.int64)
    usable = np.flatnonzero((counts > 0) & (lengths > 0))
    if budget <= 0 or not len(usable):
        return chosen
    width = min(2 * budget, budget + int(lengths[usable].max()))  # any sum beyond is farther off than some sum within
    reached = np.zeros(width + 1, bool)
    reached[0] = True
    by = np.full(width + 1, -1, np.int32)
    items = []
    for i in usable:
        left, step = min(int(counts[i]), width // int(lengths[i])), 1
        while left > 0 and not reached[budget]:
            k = min(step, left)
            w = k * int(lengths[i])
            new = np.flatnonzero(reached[:-w] & ~reached[w:]) + w if w <= width else np.empty(0, int)
            by[new] = len(items)
            reached[new] = True
            items.append((i, k, w))
            left, step = left - k, step * 2
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        i, k, w = items[by[at]]
        chosen[i] += k
        at -= w
    return chosen


def fit(lengths: np.ndarray, counts: np.ndarray, target: int, width: int = KNAPSACK_WORDS) -> tuple[int, np.ndarray]:
    """``(passes, extra)``: whole passes over all documents, and how many of each length once more."""
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if not total or target <= 0:
        return 0, np.zeros(len(lengths), np.int64)
    passes, rest = divmod(target, total)
    longest = int(lengths[counts > 0].max())
    width = max(width, 2 * longest, min(8 * longest, ROOMY_WORDS))
    extra = np.array([int(c) * rest // total if n else 0 for n, c in zip(lengths, counts)], np.int64)
    left = rest - int((extra * lengths).sum())
    order = np.argsort(-lengths, kind="stable")
    for most in (1, None):  # what the table can't hold goes to long documents, one of each length first
        for i in order:
            n = int(lengths[i])
            if n and left - width >= n:
                k = min(int(counts[i] - extra[i]), (left - width) // n, most or left)
                extra[i] += k
                left -= k * n
    extra = extra + knapsack(lengths, counts - extra, left)
    missed = abs(rest - int((extra * lengths).sum()))
    if missed and rest <= width + longest:  # the shares given first may stand in the way of a nearer sum
        whole = knapsack(lengths, counts, rest)
        extra = whole if abs(rest - int((whole * lengths).sum())) < missed else extra
    return passes, extra


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    budget: Fraction = BUDGET,
    cap: int = CAP,
    seed: int = SEED,
    width: int = KNAPSACK_WORDS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``(doc_id, size, source, source_size, target, taken, copies, row_hash)`` for every row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(
        column(docs, "doc_id", "long").alias("doc_id"),
        column(docs, "source", "string").alias("source"),
        word_count(column(docs, "text", "string")).alias("size"),
        row_hash(docs).alias("row_hash"),
    )
    rows = stored(rows, "sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    aims = targets([r.words for r in found], weights, budget, cap)
    sources = spark.createDataFrame(
        [(r.source, i, r.words, float(t), round(t)) for i, (r, t) in enumerate(zip(found, aims))],
        "name string, s int, source_size long, target double, aim long",
    )
    rows = rows.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("name"))).drop("name")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        passes, extra = fit(pdf["size"].to_numpy(), pdf["n"].to_numpy(), int(pdf["aim"].iloc[0]), width)
        return pdf[["s", "size", "n"]].assign(passes=passes, extra=extra)

    lengths = rows.groupBy("s", "size", "aim").agg(F.count(F.lit(1)).alias("n"))
    wanted = stored(lengths.groupBy("s").applyInPandas(plan, "s int, size long, n long, passes int, extra long"), "lengths")
    drawn = F.xxhash64(F.lit(seed), "doc_id", "row_hash")
    given = join_groups(rows, wanted, ["s", "size"], "n", sum(r.n for r in found)).withColumns(
        {"h": drawn, "cell": F.pmod(drawn, F.ceil(F.col("n") / F.lit(cell_rows)))}
    )
    before = Window.partitionBy("s", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = given.groupBy("s", "size", "cell").agg(F.count(F.lit(1)).alias("in_cell"))
    cells = cells.withColumn("before", F.coalesce(F.sum("in_cell").over(before), F.lit(0)))
    order = Window.partitionBy("s", "size", "cell").orderBy("h", "doc_id", "row_hash")
    numbered = given.withColumn("at", F.row_number().over(order)).join(cells, ["s", "size", "cell"])
    copies = F.col("passes") + F.when(F.col("before") + F.col("at") <= F.col("extra"), 1).otherwise(0)
    return numbered.select(
        "doc_id", "size", "source", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.cast("int").alias("copies"), "row_hash"
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns, whatever their names.

    Texts are joined once with a narrow table of copies. Of rows equal in all columns each gives an even part of
    their copies and one of them the rest.
    """
    same = mix(docs, **options).groupBy("doc_id", "row_hash")
    share = same.agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("members")).filter("copies > 0")
    name = lambda doc_id, h: F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), h.cast("string"))
    key = name(column(docs, "doc_id", "long"), row_hash(docs))
    rows = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = rows.join(share.select(name(F.col("doc_id"), F.col("row_hash")).alias("key"), "copies", "members"), "key")
    even = found.select("row", F.floor(F.col("copies") / F.col("members")).alias("n"))
    uneven = found.filter("copies % members > 0").groupBy("key").agg(F.first("row").alias("row"), F.max(F.expr("copies % members")).alias("n"))
    taken = even.unionByName(uneven.select("row", "n")).filter("n > 0")
    return taken.select("row", F.explode(F.expr("sequence(1L, n)")).alias("copy")).select("row.*")
