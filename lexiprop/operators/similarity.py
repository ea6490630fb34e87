"""Exact all-pairs similarity join over vectors, blocked for bounded memory.

Both inputs are hashed into blocks (uniform, since ids are unique).  Every left
block meets every right block in one ``applyInArrow`` group; ``blocks`` finds the
pairs of the two in tiles of the product, and only the local top-k per
row (or the pairs within the radius) leave the task, some at a time.  The second shuffle
therefore carries at most ``rows * blocks * k`` rows, and the final top-k is a
``row_number`` window that Spark limits map-side (``WindowGroupLimit``).

Self joins (``right is left``) use unordered block pairs ``p <= q``: each row is
replicated to ``B`` groups instead of ``2B``.  The block size follows a per-side memory budget,
so a group holds at most two blocks of ``_SIDE_CELLS`` doubles whatever the input size, and there
are enough blocks for every core. Where the copies of all blocks would fill the disk, the k closest are
found in rounds of block pairs that shuffle about ``ROUND_CELLS`` doubles, and only the closest so far are kept.

Right sides of more than ``PIVOT_ROWS`` rows go through ``pivots`` where a bounded sample shows that
triangle bounds of pivot cells exclude half of the pairs or more: the same pairs and the same result, but
blocks meet only where a match is possible. Vectors without clusters meet block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiprop.operators.blocks import Skipped, equal_codes, nearest, within
from lexiprop.operators.pivots import CELL_ROWS, PivotIndex, visited_pairs, visited_share, visits
from lexiprop.session import cut_lineage, remove, stored

# Doubles per block side (32 MB); the block row count is this over the dimension.
_SIDE_CELLS = 1 << 22
DEFAULT_BLOCK_ROWS = None  # derived from the vector dimension
ROUND_CELLS = 1 << 29  # doubles that a round of block pairs shuffles, about (4 GB)
_BATCH_PAIRS = 1 << 16  # pairs that leave a task at once


_MIN_BLOCK_ROWS = 2048
PIVOT_ROWS = 4096  # right rows from which on pivot cells may pay
PIVOT_SHARE = 0.5  # of the pairs, which pivot cells must exclude at least


def _parallelism(df: DataFrame) -> int:
    try:
        return int(df.sparkSession.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001 - e.g. no SparkContext on this client
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))


def _blocks(n: int, block_rows: int) -> int:
    return max(1, math.ceil(n / max(1, block_rows)))


def _size(df: DataFrame, vec: str, id_col: str) -> tuple[int, int, bool]:
    """Rows, dimension, and whether every row has an id."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("d"), F.count(id_col).alias("ids")).first()
    return int(row["n"]), int(row["d"] or 1), row["ids"] == row["n"]


def similarity_join(
    left: DataFrame,
    right: DataFrame,
    *,
    left_id: str,
    right_id: str,
    vec: str = "vector",
    metric: str = "euclidean",
    k: int | None = None,
    radius: float | None = None,
    exclude_same_id: bool = False,
    exclude_key: str | None = None,
    by: str | None = None,
    block_rows: int | None = DEFAULT_BLOCK_ROWS,
    cell_rows: int | None = None,
) -> DataFrame:
    """Pairs ``(src, dst, score)`` between ``left`` and ``right`` vectors.

    * ``metric='euclidean'``: score is the Euclidean distance, smaller is closer.
    * ``metric='dot'``: score is the dot product, larger is closer.
    * ``k``: keep the k closest right rows per left row (ties by ``dst``), adds ``rank``.
    * ``radius``: keep every pair with distance <= radius (euclidean only).
    * ``exclude_same_id``: skip pairs whose ids are equal (self pairs).
    * ``exclude_key``: column present on both sides; pairs whose values are
      equal and not null are skipped (e.g. a synset and its own train words).
    * ``by``: column present on both sides; only rows with equal values pair up
      (e.g. ``split_id``), and it is kept in the output.
    * ``cell_rows``: rows of a pivot cell; by default cells are used on large right sides only.
    """
    if (k is None) == (radius is None):
        raise ValueError("give exactly one of k or radius")
    if radius is not None and metric != "euclidean":
        raise ValueError("radius needs the euclidean metric")
    if metric not in ("euclidean", "dot"):
        raise NotImplementedError(metric)

    symmetric = right is left and left_id == right_id
    src_type = left.schema[left_id].dataType
    dst_type = right.schema[right_id].dataType
    ex_type = left.schema[exclude_key].dataType if exclude_key else T.IntegerType()
    part_type = left.schema[by].dataType if by else T.IntegerType()

    n_left, dims, named = _size(left, vec, left_id)
    n_right, _, right_named = (n_left, dims, named) if symmetric else _size(right, vec, right_id)
    rows_per_block = block_rows or max(1_000, _SIDE_CELLS // max(1, dims))
    b_left = _blocks(n_left, rows_per_block)
    b_right = b_left if symmetric else _blocks(n_right, rows_per_block)
    if block_rows is None:
        # enough block pairs to keep every core busy (blocks of at least _MIN_BLOCK_ROWS)
        want = 4 * _parallelism(left)
        if symmetric:
            b_par = 1
            while b_par * (b_par + 1) // 2 < want:
                b_par += 1
            b_left = b_right = max(b_left, min(b_par, _blocks(n_left, _MIN_BLOCK_ROWS)))
        else:
            b_right = max(b_right, min(math.ceil(want / b_left), _blocks(n_right, _MIN_BLOCK_ROWS)))

    whole_numbers = all(isinstance(t, T.IntegralType) for t in (src_type, dst_type)) and named and right_named
    key_type = T.LongType() if whole_numbers else T.StringType()

    def prepared(df: DataFrame, id_col: str, side: int) -> DataFrame:
        return df.select(
            (F.col(by) if by else F.lit(0)).cast(part_type).alias("part"),
            F.lit(side).alias("side"),
            F.col(id_col).cast(key_type).alias("key"),
            F.col(vec).cast("array<double>").alias("v"),
            (F.col(exclude_key).cast(ex_type) if exclude_key else F.lit(None).cast(ex_type)).alias("ex"),
            F.pmod(F.xxhash64(F.col(id_col)), F.lit(b_left if side == 0 else b_right)).cast("int").alias("blk"),
        )

    if symmetric:
        rows = prepared(left, left_id, 0)
        both = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(b_left - 1))).alias("_o")).select(
            "part", "side", "key", "v", "ex", "blk",
            F.least("blk", "_o").alias("lb"), F.greatest("blk", "_o").alias("rb"),
        )
    else:
        lrows = prepared(left, left_id, 0).select(
            "*", F.col("blk").alias("lb"), F.explode(F.sequence(F.lit(0), F.lit(b_right - 1))).alias("rb")
        )
        rrows = prepared(right, right_id, 1).select(
            "*", F.explode(F.sequence(F.lit(0), F.lit(b_left - 1))).alias("lb"), F.col("blk").alias("rb")
        )
        both = lrows.unionByName(rrows)

    out_schema = T.StructType(
        [
            T.StructField("part", part_type),
            T.StructField("src", key_type),
            T.StructField("dst", key_type),
            T.StructField("score", T.DoubleType()),
        ]
    )
    use_dot = metric == "dot"
    same_id = exclude_same_id
    number_keys = isinstance(dst_type, T.IntegralType)

    def order_of(keys: np.ndarray) -> np.ndarray:
        """Numbers in the order of the ids, for ties."""
        return keys.astype(np.int64) if number_keys else np.unique(keys.astype(str), return_inverse=True)[1]

    def skipped(akey, bkey, aex, bex) -> Skipped:
        codes = [equal_codes(akey, bkey, True)] if same_id else []
        if pd.notna(aex).any() and pd.notna(bex).any():
            codes.append(equal_codes(aex, bex, False))
        return Skipped(codes)

    def close_pairs(avec, bvec, akey, bkey, aex, bex, both_ways: bool, one_block: bool = False):
        """``(i, j, score, flipped)`` of the closest pairs of every left row (and, if ``both_ways``, of every right row).

        ``one_block``: both sides are the same rows; a distance is then worked out from one end and given from both.
        """
        skip = skipped(akey, bkey, aex, bex)
        if k is None:
            for i, j, score in within(avec, bvec, radius, skip, one_block):
                yield i, j, score, False
                if both_ways:
                    yield i, j, score, True
                elif one_block:
                    others = i != j
                    yield i[others], j[others], score[others], True
            return
        for i, j, score in nearest(avec, bvec, k, use_dot, order_of(bkey), skip):
            yield i, j, score, False
        if both_ways:
            for j, i, score in nearest(bvec, avec, k, use_dot, order_of(akey), skip.flipped()):
                yield i, j, score, True

    def block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list, list] = ([], [])
        part, lb, rb = None, 0, 0
        for batch in batches:
            if part is None:
                part, lb, rb = (batch.column(batch.schema.get_field_index(n))[0] for n in ("part", "lb", "rb"))
            of, marks = ("blk", (lb.as_py(), rb.as_py())) if symmetric else ("side", (0, 1))
            mark = batch.column(batch.schema.get_field_index(of)).to_numpy(zero_copy_only=False)
            for own, value in zip(sides, marks):
                rows = batch.select(["key", "v", "ex"]).filter(pa.array(mark == value))
                if rows.num_rows:
                    vectors = rows.column(1)
                    if vectors.null_count or len(np.unique(np.diff(vectors.offsets.to_numpy()))) > 1:
                        raise ValueError("a vector is null or has another length than the others")
                    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
                    own.append((flat.reshape(rows.num_rows, -1).copy(), rows.column(0), rows.column(2).to_pandas().to_numpy(dtype=object)))
        if not sides[0] or not sides[1]:
            return
        one_block = symmetric and lb.as_py() == rb.as_py()
        (avec, akeys, aex), (bvec, bkeys, bex) = (
            (np.concatenate([x[0] for x in own]), pa.concat_arrays([x[1] for x in own]), np.concatenate([x[2] for x in own])) for own in sides
        )
        akey, bkey = (x.to_numpy(zero_copy_only=False) for x in (akeys, bkeys))

        def rows_of(found: list) -> pa.RecordBatch:
            src = pa.concat_arrays([(bkeys if flipped else akeys).take(pa.array(j if flipped else i)) for i, j, _, flipped in found])
            dst = pa.concat_arrays([(akeys if flipped else bkeys).take(pa.array(i if flipped else j)) for i, j, _, flipped in found])
            score = np.concatenate([x[2] for x in found])
            return pa.RecordBatch.from_arrays([pa.repeat(part, len(score)), src, dst, pa.array(score)], ["part", "src", "dst", "score"])

        waiting: list = []
        for found in close_pairs(avec, bvec, akey, bkey, aex, bex, symmetric and not one_block, one_block):
            waiting.append(found)
            if sum(len(x[0]) for x in waiting) >= _BATCH_PAIRS:
                yield rows_of(waiting)
                waiting = []
        if waiting:
            yield rows_of(waiting)

    def visited(a: pd.DataFrame, b: pd.DataFrame, rows: np.ndarray, cells: np.ndarray) -> dict | None:
        """The pairs of left rows ``a`` with the cells of ``b`` that they visit, cut to k by (score, dst)."""
        avec, bvec = (np.stack(x["v"].to_numpy()).astype(np.float64, copy=False) for x in (a, b))
        akey, bkey, aex, bex, bcell = a["key"].to_numpy(), b["key"].to_numpy(), a["ex"].to_numpy(), b["ex"].to_numpy(), b["cell"].to_numpy()
        out: list = []
        for c in np.unique(cells):
            i, j = rows[cells == c], np.flatnonzero(bcell == c)
            if len(j):
                found = close_pairs(avec[i], bvec[j], akey[i], bkey[j], aex[i], bex[j], False)
                out += [(akey[i[x]], bkey[j[y]], score) for x, y, score, _ in found]
        if not out:
            return None
        src, dst, score = (np.concatenate([o[n] for o in out]) for n in range(3))
        if k is not None and len(out) > 1:
            source = np.unique(src.astype(str), return_inverse=True)[1]
            order = np.lexsort((order_of(dst), -score if use_dot else score, source))
            source = source[order]
            keep = order[np.arange(len(order)) - np.searchsorted(source, source) < k]
            src, dst, score = src[keep], dst[keep], score[keep]
        return {"src": src, "dst": dst, "score": score}

    def by_pivots() -> DataFrame:
        lrows, rrows = (prepared(df, key, side).select("part", "key", "v", "ex") for df, key, side in ((left, left_id, 0), (right, right_id, 1)))
        # bins and blocks small enough for every core to have some
        most = rows_per_block if block_rows else min(rows_per_block, max(_MIN_BLOCK_ROWS, _blocks(n_right, _parallelism(left))))
        index = PivotIndex(rrows, n_right, most, cell_rows or CELL_ROWS)
        lrows = lrows.withColumn("bound", F.lit(float("inf")))

        def searched(rows: DataFrame, home_only: bool) -> DataFrame:
            found = cut_lineage(visits(rows, index, use_dot, most, n_left, home_only, radius))
            return visited_pairs(found, index, visited, out_schema)

        if k is None:
            return searched(lrows, False)
        first = cut_lineage(searched(lrows, True))
        badness = -F.col("score") if use_dot else F.col("score")
        best = Window.partitionBy("part", "src").orderBy(badness)
        kth = first.select("part", F.col("src").alias("key"), F.row_number().over(best).alias("at"), badness.alias("kth")).filter(F.col("at") == k)
        rest = lrows.drop("bound").join(kth.select("part", "key", F.col("kth").alias("bound")), ["part", "key"], "left")
        rest = rest.select("part", "key", "v", "ex", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
        return first.unionByName(searched(rest, False))

    pays = bool(cell_rows)
    if not pays and block_rows is None and n_left and n_right > PIVOT_ROWS:
        pays = visited_share(*(df.select(F.col(i).alias("key"), F.col(vec).cast("array<double>").alias("v")) for df, i in ((left, left_id), (right, right_id))), n_right, use_dot, k, radius) <= 1 - PIVOT_SHARE
    def block_rounds() -> list:
        """Conditions on ``lb`` and ``rb`` that cut all block pairs into rounds."""
        if symmetric:  # by the distance of the blocks around a ring: a row has two copies for each
            ring = F.col("rb") - F.col("lb")
            value, last, cells = F.least(ring, F.lit(b_left) - ring), b_left // 2 + 1, 2 * n_left * dims
        else:
            value, last, cells = F.col("rb"), b_right, (n_left + n_right * b_left / b_right) * dims
        step = max(1, int(ROUND_CELLS // max(cells, 1)))
        return [value.between(lo, lo + step - 1) for lo in range(0, last, step)]

    def closest(pairs: DataFrame) -> DataFrame:
        order = F.col("score").desc() if use_dot else F.col("score").asc()
        w = Window.partitionBy("part", "src").orderBy(order, F.col("dst").cast(dst_type).asc())
        return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("rank")

    def of_blocks(rows: DataFrame) -> DataFrame:
        return rows.groupBy("part", "lb", "rb").applyInArrow(block_pairs, out_schema)

    if n_left and n_right and pays:
        pairs = by_pivots()
    elif k is None or len(rounds := block_rounds()) == 1:
        pairs = of_blocks(both)
    else:
        pairs, path = stored(closest(of_blocks(both.filter(rounds[0]))), "closest")
        for some in rounds[1:]:
            before = path
            pairs, path = stored(closest(pairs.unionByName(of_blocks(both.filter(some)))), "closest")
            remove(left.sparkSession, before)
    pairs = pairs.select(
        *([F.col("part").alias(by)] if by else []),
        F.col("src").cast(src_type).alias("src"),
        F.col("dst").cast(dst_type).alias("dst"),
        "score",
    )
    if k is None:
        return pairs
    order = F.col("score").desc() if use_dot else F.col("score").asc()
    w = Window.partitionBy(*([by] if by else []), "src").orderBy(order, F.col("dst").asc())
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
