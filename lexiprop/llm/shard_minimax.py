"""Contiguous shards whose largest is as small as it can be (DataFrame operations only).

Documents are ordered by the smallest doc_id of their group of equal texts; a group is
never cut. A distributed prefix sum gives every group the bytes up to its end. A binary
search finds the smallest capacity at which filling shards greedily needs no more than
the wanted number, and the cuts are where that filling makes them.

The driver never holds the groups: it keeps the least and greatest group end of each of at
most ``cells`` stretches of the byte axis. With these a greedy check gives a lower and an
upper bound; the stretches in which a cut could still lie are read again in finer cells,
until the bounds meet. The result is exact.

Defined cases: a null text counts no bytes and equals the empty text; rows without a doc_id
come last; repeated rows share a group; an empty table gives no rows; with fewer groups
than shards the last shards stay empty; a group larger than an even share makes a shard
alone at least that large; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiprop.llm.common import column, join_groups, stored

SHARDS = 40
ROW_BYTES = 16
CELLS = 1 << 16
#: Rows of a range partition in the prefix sum, and the most partitions (one small row each is broadcast).
RANGE_ROWS = 100_000
MAX_RANGES = 20_000


class Ends:
    """What is known of the sorted group ends: ``(least, greatest, count)`` of each cell that has any."""

    def __init__(self, cells: list[tuple[int, int, int]]):
        self.cells = sorted(cells)
        self.least = [c[0] for c in self.cells]

    def below(self, x: int, surely: bool) -> int:
        """The last group end up to ``x``: a bound from below if ``surely``, else one from above."""
        i = bisect_right(self.least, x) - 1
        if i < 0:
            return 0
        least, greatest, n = self.cells[i]
        if x >= greatest:
            return greatest
        return least if surely or n <= 2 else x

    def fill(self, capacity: int, shards: int, surely: bool) -> list[int]:
        """Where greedy filling ends each shard."""
        cuts, at = [], 0
        for _ in range(shards):
            at = self.below(at + capacity, surely)
            cuts.append(at)
        return cuts

    def smallest(self, low: int, high: int, shards: int, surely: bool) -> int:
        """The smallest capacity that fills everything into ``shards``, by binary search."""
        total = self.cells[-1][1]
        while low < high:
            mid = (low + high) // 2
            if self.fill(mid, shards, surely)[-1] >= total:
                high = mid
            else:
                low = mid + 1
        return low

    def doubtful(self, low: int, high: int, shards: int) -> list[tuple[int, int]]:
        """Stretches in which a cut of some capacity from ``low`` to ``high`` may lie between known ends."""
        found: list[tuple[int, int]] = []
        first = [0, *self.fill(low, shards, True)]
        last = [0, *self.fill(high, shards, False)]
        for a, b in zip(first[:-1], last[:-1]):
            i = max(0, bisect_right(self.least, a + low) - 1)
            j = bisect_right(self.least, b + high)
            open_ = [c for c in self.cells[i:j] if c[2] > 2 and c[1] > a + low and c[0] <= b + high]
            if open_:
                lo, hi = open_[0][0], max(c[1] for c in open_)
                if found and lo <= found[-1][1]:
                    found[-1] = (found[-1][0], max(hi, found[-1][1]))
                else:
                    found.append((lo, hi))
        return found

    def finer(self, parts: list[tuple[int, int]], cells: list[tuple[int, int, int]]) -> Ends:
        """With the cells inside ``parts`` replaced by what was read anew."""
        kept = [c for c in self.cells if not any(lo <= c[0] and c[1] <= hi for lo, hi in parts)]
        return Ends(kept + cells)


def _cells(ends: DataFrame, width: int) -> list[tuple[int, int, int]]:
    by = F.floor(F.col("end") / F.lit(width)) if width > 1 else F.col("end")
    found = ends.groupBy(by.alias("cell")).agg(F.min("end"), F.max("end"), F.count(F.lit(1))).collect()
    return [(r[1], r[2], r[3]) for r in found]


def cut_points(ends: DataFrame, total: int, largest: int, shards: int, cells: int = CELLS) -> list[int]:
    """The byte positions at which the shards end, for the least possible largest shard.

    ``ends`` has one row ``end`` a group: the bytes up to and with it.
    """
    width = max(1, total // cells)
    known = Ends(_cells(ends, width))
    low, high = max(largest, -(-total // shards)), total
    while True:
        low, high = known.smallest(low, high, shards, False), known.smallest(low, high, shards, True)
        parts = known.doubtful(low, high, shards)
        if not parts:
            return known.fill(high, shards, True)
        width = max(1, min(width // 4, sum(hi - lo for lo, hi in parts) // cells))
        inside = F.lit(False)
        for lo, hi in parts:
            inside = inside | F.col("end").between(lo, hi)
        known = known.finer(parts, _cells(ends.filter(inside), width))


def ordered_sums(rows: DataFrame, n: int, order: list[str], size: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``sum_to`` (sizes up to and with the row) and ``place`` (from 0) in the order of ``order``."""
    ranges = min(MAX_RANGES, max(1, -(-n // range_rows)))
    cut = stored(rows.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "ordered")
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = cut.groupBy("range").agg(F.sum(size).alias("b"), F.count(F.lit(1)).alias("n"))
    before = before.select("range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("b", "n")])
    within = Window.partitionBy("range").orderBy(*order)
    up_to = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = cut.withColumns({"sum_to": F.sum(size).over(up_to), "place": F.row_number().over(within) - 1})
    return summed.join(F.broadcast(before), "range").select(
        *rows.columns, (F.col("sum_to") + F.col("b_before")).alias("sum_to"), (F.col("place") + F.col("n_before")).alias("place")
    )


def shard(docs: DataFrame, shards: int = SHARDS, cells: int = CELLS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row of ``docs``."""
    text = F.coalesce(column(docs, "text", "string"), F.lit(""))
    rows = docs.select(
        column(docs, "doc_id", "long").alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).alias("same"),
    )
    rows = stored(rows, "sizes")
    groups = rows.groupBy("same").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("members"), F.sum("size").alias("bytes"))
    groups = stored(groups, "groups")
    whole = groups.agg(F.sum("bytes"), F.max("bytes"), F.sum("members")).first()
    total, largest, n = whole[0] or 0, whole[1] or 0, whole[2] or 0
    placed = join_groups(rows, groups.select("same", "first", "members"), "same", "members", n)
    nulls_last = F.lit(2**63 - 1)
    keys = {"o1": F.coalesce("first", nulls_last), "o2": F.col("same"), "o3": F.coalesce("doc_id", nulls_last)}
    placed = placed.select("doc_id", "size", "text_crc32", *[c.alias(k) for k, c in keys.items()])
    summed = stored(ordered_sums(placed, n, list(keys), "size", range_rows), "summed")
    ends = stored(summed.groupBy("o1", "o2").agg(F.max("sum_to").alias("end")).select("end"), "ends")
    cuts = cut_points(ends, total, largest, shards, cells) if n else []
    number = sum((F.when(F.col("sum_to") > c, 1).otherwise(0) for c in cuts[:-1]), F.lit(0))
    numbered = summed.withColumn("shard", number.cast("int"))
    starts = numbered.groupBy("shard").agg(F.min("place").alias("start"))  # one row a shard
    return numbered.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("start")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
