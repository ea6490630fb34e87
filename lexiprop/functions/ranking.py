"""Skew-safe exact ranks, quantiles and prefix sums built from aggregations.

* ``rank_by_hash`` numbers rows inside a group in the order of a uniformly
  distributed hash (md5 hex).  The hash prefix doubles as a salt, so a group
  holding a third of all rows is split over ``salt`` window partitions while the
  numbering stays exact (bucket offsets come from a small aggregate).
* ``value_prefix`` gives, for every distinct value of a column, the number of
  rows with a smaller value.  It works on the value histogram (partial
  aggregation first) and spreads the prefix sum over range buckets.
* ``exact_quantiles`` / ``average_rank`` are built on ``value_prefix``; they
  equal pandas' linear-interpolation quantiles and average ranks exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_PREFIX_HEX = 6  # 24 bits of the md5 used to pick the salt bucket
DEFAULT_SALT = 16


def seeded_hash(seed: Column | int, key: Column) -> Column:
    """md5 of ``'<seed>:<key>'`` (hex), the engine-independent random order."""
    seed_col = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat(seed_col.cast("string"), F.lit(":"), key.cast("string")))


def _hash_bucket(h: Column, salt: int) -> Column:
    prefix = F.conv(F.substring(h, 1, HASH_PREFIX_HEX), 16, 10).cast("long")
    return F.floor(prefix * F.lit(salt) / F.lit(16**HASH_PREFIX_HEX)).cast("int")


def rank_by_hash(
    df: DataFrame,
    group_cols: list[str],
    hash_col: str,
    out: str = "rn",
    group_size: str | None = None,
    salt: int = DEFAULT_SALT,
) -> DataFrame:
    """1-based ``row_number`` within ``group_cols`` ordered by ``hash_col`` ascending.

    ``hash_col`` must be a hex string whose prefix is uniform (md5).  Optionally
    also adds the group size as ``group_size``.
    """
    b = "_salt_bucket"
    with_b = df.withColumn(b, _hash_bucket(F.col(hash_col), salt))
    counts = with_b.groupBy(*group_cols, b).agg(F.count(F.lit(1)).alias("_n"))
    w_before = Window.partitionBy(*group_cols).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w_before), F.lit(0)))
    if group_size:
        offsets = offsets.withColumn(group_size, F.sum("_n").over(Window.partitionBy(*group_cols)))
    offsets = offsets.drop("_n")
    local = Window.partitionBy(*group_cols, b).orderBy(F.col(hash_col))
    ranked = with_b.join(offsets, [*group_cols, b]).withColumn(
        out, (F.col("_before") + F.row_number().over(local)).cast("long")
    )
    return ranked.drop(b, "_before")


def class_type(*columns: tuple[DataFrame, str]) -> str:
    """The type of class numbers that come from these columns: ``bigint`` if one of them is, else ``int``."""
    return "bigint" if any(isinstance(df.schema[c].dataType, T.LongType) for df, c in columns) else "int"


def value_prefix(
    df: DataFrame,
    value: str,
    weight: str | None = None,
    n_buckets: int | None = None,
) -> DataFrame:
    """Histogram ``(value, cnt, before, total)``: rows with the value, rows below it, all rows.

    With ``weight`` every row counts as that many rows.  The histogram has one
    row per distinct value, so range buckets over it are balanced even if one
    value holds most rows.
    """
    size = F.sum(F.col(weight)).cast("long") if weight else F.count(F.lit(1))
    hist = df.groupBy(value).agg(size.alias("cnt")).filter(F.col(value).isNotNull())
    # range buckets over the distinct values (any orderable type), as many as their size
    # asks for; a reliable checkpoint freezes them, so every later read sees the same buckets
    from lexiprop.session import cut_lineage

    ranged = hist.repartitionByRange(n_buckets, value) if n_buckets else hist.repartitionByRange(value)
    bucketed = cut_lineage(ranged.withColumn("_bucket", F.spark_partition_id()))
    totals = bucketed.groupBy("_bucket").agg(F.sum("cnt").alias("_bt"))
    # one row per bucket: a window without partition is fine here
    w_all = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_bucket",
        F.coalesce(F.sum("_bt").over(w_all), F.lit(0)).alias("_off"),
        F.sum("_bt").over(Window.partitionBy()).alias("total"),
    )
    w_local = Window.partitionBy("_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = bucketed.withColumn("_lb", F.coalesce(F.sum("cnt").over(w_local), F.lit(0)))
    return (
        local.join(F.broadcast(offsets), "_bucket")
        .select(value, "cnt", (F.col("_off") + F.col("_lb")).alias("before"), "total")
    )


def exact_quantiles(
    df: DataFrame, value: str, probs: list[float], names: list[str], n_buckets: int | None = None
) -> DataFrame:
    """One row with the linear-interpolation quantiles of ``value`` (pandas/numpy default)."""
    pre = value_prefix(df, value, n_buckets=n_buckets)
    cols = []
    for p, name in zip(probs, names):
        pos = F.lit(p) * (F.col("total") - 1)
        lo = F.floor(pos)
        hi = F.ceil(pos)
        # value at 0-based rank r: before <= r < before + cnt
        v_lo = F.min(F.when((F.col("before") <= lo) & (lo < F.col("before") + F.col("cnt")), F.col(value)))
        v_hi = F.min(F.when((F.col("before") <= hi) & (hi < F.col("before") + F.col("cnt")), F.col(value)))
        frac = F.max(pos - lo)
        cols.append((v_lo.cast("double") + (v_hi.cast("double") - v_lo.cast("double")) * frac).alias(name))
    return pre.agg(*cols)


def average_rank(df: DataFrame, value: str, out: str, n_buckets: int | None = None) -> DataFrame:
    """Adds the average rank (1-based, ties share the mean rank) of ``value``."""
    pre = value_prefix(df, value, n_buckets=n_buckets).select(
        value, (F.col("before") + (F.col("cnt") + 1) / 2.0).alias(out)
    )
    return df.join(pre, value, "left")
