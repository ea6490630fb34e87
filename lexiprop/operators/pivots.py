"""Exact nearest neighbours, radius and largest inner products with pivot cells and triangle bounds.

1. At most ``MAX_PIVOTS`` right rows (smallest hashes) are pivots; every right row belongs to the cell of its
   nearest pivot. One row a cell (rows, largest distance from the pivot) reaches the driver.
2. Neighbouring cells share a bin of bounded size (a crowded cell takes several); a left row's
   home is the cell that can hold its best match, and left rows with the same home bin make blocks.
3. For the k closest, a first round searches the home cells; its k-th score bounds what can still count.
4. A left row then visits only cells whose bound can beat that (or reach into the radius): a cell with
   pivot p and reach r holds nothing closer to x than ``|x - p| - r``, and no larger inner product than
   ``x . p + |x| r``. A bin is sent to a left block only if one of its rows visits it.

Each right row is in one cell, so no pair comes twice. In the worst case (no bound excludes anything) all
blocks meet all bins, as in a join without bounds; the result is exact either way. Ties are kept to the end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiprop.session import cut_lineage

MAX_PIVOTS = 4096
CELL_ROWS = 256  # right rows of a cell, about
SHARE_ROWS, SHARE_ASKS = 4096, 64  # sampled rows that tell whether cells pay
_ROWS_AT_ONCE = 2048


@dataclass
class Cells:
    """Pivots, and of each cell its reach, its first bin and how many bins it takes (on the driver, bounded)."""

    pivots: np.ndarray
    reach: np.ndarray
    first_bin: np.ndarray
    bins_of: np.ndarray

    @property
    def bins(self) -> int:
        return int((self.first_bin + self.bins_of).max())


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Exact to a few units of rounding, also far from the origin."""
    centre = pivots.mean(axis=0)
    a, b = x - centre, pivots - centre
    square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


def rounding(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """What a bound of each row may be off by, generously."""
    size = np.sqrt(np.einsum("ij,ij->i", x, x)) + np.sqrt(np.einsum("ij,ij->i", pivots, pivots)).max(initial=0.0)
    return 1e-6 * size + 1e-12


def best_bounds(x: np.ndarray, cells: Cells, dot: bool) -> np.ndarray:
    """For each row and cell the best score that the cell can hold; smaller is better (inner products negated)."""
    if dot:
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        bound = -(x @ cells.pivots.T) - norm[:, None] * cells.reach[None, :]
    else:
        bound = distances(x, cells.pivots) - cells.reach[None, :]
    slack = rounding(x, cells.pivots)
    if dot:
        slack = slack * (1.0 + norm)
    return bound - slack[:, None]


def grouped_cells(pivots: np.ndarray, rows: np.ndarray, bin_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins of neighbouring cells with at most ``bin_rows`` rows; a larger cell takes several of its own."""
    first, several = np.zeros(len(pivots), np.int64), np.ones(len(pivots), np.int64)
    free = np.ones(len(pivots), bool)
    at = 0
    for c in np.argsort(-rows, kind="stable"):
        if not free[c]:
            continue
        if rows[c] > bin_rows:
            several[c] = -(-rows[c] // bin_rows)
            first[c], free[c] = at, False
            at += several[c]
            continue
        near = np.flatnonzero(free)
        near = near[np.argsort(((pivots[near] - pivots[c]) ** 2).sum(axis=1), kind="stable")]
        near = np.concatenate([[c], near[near != c]])
        taken = near[np.cumsum(rows[near]) <= bin_rows]
        first[taken], free[taken] = at, False
        at += 1
    return first, several


def _slices(pdf: pd.DataFrame):
    """Some rows at a time, strings as plain objects (chunked string columns can't be sent back)."""
    pdf = pdf.assign(key=pdf["key"].astype(object))
    for i in range(0, len(pdf), _ROWS_AT_ONCE):
        yield pdf.iloc[i : i + _ROWS_AT_ONCE]


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64, copy=False)


def choose_pivots(right: DataFrame, n: int, cell_rows: int = CELL_ROWS) -> np.ndarray:
    """A bounded sample of the right rows ``(key, v)``: those with the smallest hashes of their keys."""
    most = max(1, min(MAX_PIVOTS, -(-n // cell_rows)))
    rows = right.select("v", F.xxhash64("key").alias("h"), "key").orderBy("h", "key").limit(most).collect()
    return np.unique(np.array([r["v"] for r in rows], dtype=np.float64), axis=0)


def visited_share(left: DataFrame, right: DataFrame, n: int, dot: bool, k: int | None, radius: float | None) -> float:
    """About which share of the right rows the left rows would visit by cells, from bounded samples ``(key, v)``."""

    def some(df: DataFrame, most: int) -> np.ndarray:
        rows = df.filter(F.col("v").isNotNull()).select("v", F.xxhash64("key").alias("h"), "key").orderBy("h", "key").limit(most).collect()
        return np.array([r["v"] for r in rows], dtype=np.float64)

    rows, asks = some(right, SHARE_ROWS), some(left, SHARE_ASKS)
    if not len(rows) or not len(asks):
        return 1.0
    pivots = np.unique(rows[: max(1, min(len(rows) // 4, -(-n // CELL_ROWS)))], axis=0)
    off = distances(rows, pivots)
    cell = off.argmin(axis=1)
    used, sizes = np.unique(cell, return_counts=True)
    reach = np.array([off[cell == c, c].max() for c in used])
    cells = Cells(pivots[used], reach, np.zeros(len(used), np.int64), np.ones(len(used), np.int64))
    if radius is not None:
        limit = np.full(len(asks), radius)
    else:  # the sample's closest stand for those of all rows; a row itself does not count
        score = -(asks @ rows.T) if dot else distances(asks, rows)
        score = np.sort(score, axis=1)
        limit = score[:, min(score.shape[1] - 1, max(1, round(k * len(rows) / max(n, 1))))]
    return float(((best_bounds(asks, cells, dot) <= limit[:, None]) * sizes).sum() / (len(asks) * len(rows)))


def placed_rows(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` with their ``cell`` and the distance ``off`` from its pivot."""
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("off", T.DoubleType())])

    def run(frames):
        for pdf in frames:
            for part in _slices(pdf):
                d = distances(_stack(part["v"]), pivots)
                cell = d.argmin(axis=1)
                yield part.assign(cell=cell.astype(np.int32), off=d[np.arange(len(part)), cell])

    return rows.mapInPandas(run, schema)


class PivotIndex:
    """The right side of a join: its rows in bins, and the cells' bounds.

    ``right`` has the columns ``(part, key, v, ex)``.
    """

    def __init__(self, right: DataFrame, n: int, bin_rows: int, cell_rows: int = CELL_ROWS):
        pivots = choose_pivots(right, n, cell_rows)
        rows = cut_lineage(placed_rows(right, pivots))
        found = rows.groupBy("cell").agg(F.max("off").alias("reach"), F.count(F.lit(1)).alias("n")).collect()
        reach, counts = np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
        for r in found:
            reach[r["cell"]], counts[r["cell"]] = r["reach"] * (1 + 1e-6) + 1e-9, r["n"]
        used = np.flatnonzero(counts)  # a pivot is in its own cell, so only equal ones go
        first, several = grouped_cells(pivots[used], counts[used], bin_rows)
        self.cells = Cells(pivots[used], reach[used], first, several)
        number = {int(c): i for i, c in enumerate(used)}
        spark = right.sparkSession
        table = [(c, i, int(first[i]), int(several[i])) for c, i in number.items()]  # at most MAX_PIVOTS rows
        at = spark.createDataFrame(table, "cell int, at int, first int, several int")
        bin_ = F.col("first") + F.pmod(F.xxhash64("key"), F.col("several")).cast("int")
        self.rows = cut_lineage(rows.join(F.broadcast(at), "cell").select("part", "key", "v", "ex", F.col("at").alias("cell"), bin_.alias("bin")))


def visits(left: DataFrame, index: PivotIndex, dot: bool, block_rows: int, n_left: int, home_only: bool, radius: float | None = None) -> DataFrame:
    """Left rows ``(part, key, v, ex, bound)`` once for each bin they visit, with the cells: ``(..., lblk, bin, cells)``.

    ``home_only``: just the home cell; else the cells within ``radius``, or the others that can beat ``bound``.
    """
    cells = index.cells
    salt = max(1, -(-n_left // block_rows))
    fields = [f for f in left.schema.fields]
    schema = T.StructType([*fields, T.StructField("home", T.IntegerType()), T.StructField("bin", T.IntegerType()), T.StructField("cells", T.ArrayType(T.IntegerType()))])

    def run(frames):
        for pdf in frames:
            for part in _slices(pdf):
                bounds = best_bounds(_stack(part["v"]), cells, dot)
                home = bounds.argmin(axis=1)
                if home_only:
                    row, cell = np.arange(len(part)), home
                else:
                    limit = np.full(len(part), radius) if radius is not None else part["bound"].to_numpy(np.float64)
                    go = bounds <= limit[:, None]
                    if radius is None:
                        go[np.arange(len(part)), home] = False  # the first round was there
                    row, cell = np.nonzero(go)
                times = cells.bins_of[cell]
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                step = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                bin_ = cells.first_bin[cell] + step
                if not len(row):
                    continue
                order = np.lexsort((cell, bin_, row))
                row, cell, bin_ = row[order], cell[order], bin_[order]
                starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (bin_[1:] != bin_[:-1])])
                out = part.iloc[row[starts]].copy()
                out["home"] = cells.first_bin[home[row[starts]]].astype(np.int32)
                out["bin"] = bin_[starts].astype(np.int32)
                out["cells"] = [c.astype(np.int32) for c in np.split(cell, starts[1:])]
                yield out

    found = left.mapInPandas(run, schema)
    # left rows of one home make a block; a crowded home is dealt over as many blocks as all rows would fill
    return found.withColumn("lblk", F.concat_ws(":", F.col("home"), F.pmod(F.xxhash64("key"), F.lit(salt))))


def visited_pairs(found: DataFrame, index: PivotIndex, kernel, out_schema: T.StructType) -> DataFrame:
    """``kernel(left, right)`` over every left block and bin with a visit."""
    needed = found.select("part", "lblk", "bin").distinct()
    none = F.lit(None)
    right = index.rows.join(needed, ["part", "bin"]).select(
        "part", "lblk", "bin", F.lit(1).alias("side"), "key", "v", "ex", "cell", none.cast("array<int>").alias("cells")
    )
    left = found.select("part", "lblk", "bin", F.lit(0).alias("side"), "key", "v", "ex", none.cast("int").alias("cell"), "cells")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        empty = pd.DataFrame({f.name: pd.Series([], dtype=object) for f in out_schema.fields})
        if a.empty or b.empty:
            return empty
        visit = np.repeat(np.arange(len(a)), a["cells"].map(len)), np.concatenate(a["cells"].to_numpy())
        found = kernel(a, b, *visit)
        if found is None:
            return empty
        ids = {n: pd.Series(found[n], dtype=object) for n in ("src", "dst")}
        return pd.DataFrame({"part": pdf["part"].iloc[0], **ids, "score": found["score"]})

    return left.unionByName(right).groupBy("part", "lblk", "bin").applyInPandas(run, out_schema)
