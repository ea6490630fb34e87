"""SimHash near-duplicates, linked through vantage-point trees over Hamming distance.

1. Fingerprints are computed where the documents are read; equal ones become one row.
2. A bounded sample of fingerprints builds the trees on the driver. Distances between
   unrelated 64-bit fingerprints crowd around 32, so a ball of radius 4 would cross nearly
   every boundary of one tree over all bits. The bits are therefore cut into blocks, with
   a tree and a reach for each: as the reaches, plus one each, add up to ``max_bits + 1``,
   two fingerprints at most ``max_bits`` apart are within its reach on some block.
3. Every fingerprint becomes resident of one leaf in each tree. Where the triangle bound
   lets a partner lie beyond a boundary, the fingerprint nearer to the vantage point is
   also sent across as a visitor; both branches are followed only where the bound allows.
4. A leaf above ``crowded_rows`` gets trees of its own over the bits its blocks left out, from a
   bounded sample of its rows, and its rows are routed again, as often as it takes (LEVELS at
   most). The blocks' reaches hold there as well, since a pair at most ``max_bits`` apart is so on
   any of the bits.
5. Each leaf compares its residents with its residents and visitors on all 64 bits and
   returns a spanning set of the links found, never all pairs. Leaves above
   ``cell_rows`` are cut into cells of row and column chunks, so one crowded leaf is
   shared among tasks and stays exact.
6. Connected components run over the links; copies of a fingerprint share its component.

Defined cases: a null or empty text has fingerprint zero and links like any other; rows
without a doc_id get a component but never name it; repeated rows each come out; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiprop.llm.common import column, free_name, join_groups, release_memory, stored, texts_of
from lexiprop.llm.components import components

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: Fingerprints that build the trees (smallest seeded hashes first); bounds the driver's and the broadcast's memory.
SAMPLE = 65_536
BLOCKS = 4
LEAF_ROWS = 512
CELL_ROWS = 8_192
#: A leaf with more rows is split again; the rows a leaf's own trees are built from and those routed by one task at once.
CROWDED_ROWS, LEAF_SAMPLE, CHUNK_ROWS = 8_192, 4_096, 65_536
#: Rows of the cells that one task compares one after another, about.
BATCH_ROWS = 131_072
#: How often leaves may be split, and the bits a split needs; what stays crowded is cut into cells.
LEVELS, LEAST_BITS = 4, 16
#: Rows aimed at by splits of a crowded leaf.
SPLIT_ROWS = 128
_ROWS_AT_ONCE = 256
_HASHES_AT_ONCE = 1 << 18


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the text's word shingles, repeats included (XXH64, seed 42)."""
    import xxhash

    words = (text or "").encode().lower().split()  # on bytes both touch ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        hashes = iter([xxhash.xxh64_intdigest(joined, SEED)])
        n = 1
    else:
        ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
        starts = [0, *(e + 1 for e in ends[:-1])]
        n = len(words) - shingle_words + 1
        digest = xxhash.xxh64_intdigest
        hashes = (digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle_words - 1 :]))
    ones = np.zeros(64, np.int64)
    left = n
    while left:
        h = np.fromiter(hashes, "<u8", min(left, _HASHES_AT_ONCE))
        left -= len(h)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp)``, the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle_words) for t in texts_of(b, 1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])
        release_memory()

    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def bit_blocks(max_bits: int, blocks: int, used: int = 0) -> list[tuple[int, int]]:
    """``(mask, reach)`` of each block of the bits that are not ``used``: two values ``max_bits`` apart
    or less are within reach on one of them. A block with a longer reach is wider, as its tree
    needs more room to prune."""
    free = [i for i in range(64) if not used >> i & 1]
    blocks = min(blocks, max_bits + 1)
    whole, more = divmod(max_bits + 1, blocks)
    reaches = [whole - 1 + (i < more) for i in range(blocks)]
    edges = [round(len(free) * x / sum(r + 1.5 for r in reaches)) for x in accumulate((r + 1.5 for r in reaches), initial=0)]
    return [(sum(1 << i for i in free[lo:hi]), r) for lo, hi, r in zip(edges, edges[1:], reaches)]


def build_tree(sample: np.ndarray, mask: int, leaf_sample: int, seed: int = SEED) -> list[tuple]:
    """Nodes ``(vantage, radius, inner, outer)`` in a list; a child below zero is leaf ``-1 - child``.

    The vantage point of a node is the candidate whose distances spread most; the radius
    is the one that halves the node's sample best.
    """
    rng = np.random.default_rng(seed)
    nodes: list[tuple] = []
    leaves = 0

    def grow(own: np.ndarray) -> int:
        nonlocal leaves
        best = None
        if len(own) > leaf_sample:
            for c in own[rng.integers(0, len(own), 6)]:
                d = np.bitwise_count((own ^ c) & np.uint64(mask))
                cut = int(np.median(d))
                for r in (cut - 1, cut):
                    share = abs(float((d <= r).mean()) - 0.5)
                    if r >= 0 and share < 0.45 and (best is None or (share - 0.02 * d.std()) < best[0]):
                        best = (share - 0.02 * d.std(), int(c), r, d <= r)
        if best is None:
            leaves += 1
            return -leaves
        at = len(nodes)
        nodes.append(())
        _, vantage, radius, inside = best
        nodes[at] = (vantage, radius, grow(own[inside]), grow(own[~inside]))
        return at

    grow(sample)
    return nodes


def route(fps: np.ndarray, nodes: list[tuple], mask: int, reach: int, lives: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(index, leaf, is_resident)`` of every place where a fingerprint belongs; those that don't
    live here (``lives``) stay visitors."""
    index, leaf, resident = [], [], []
    work = [(0 if nodes else -1, np.arange(len(fps)), np.ones(len(fps), bool) if lives is None else lives)]
    while work:
        node, own, lives = work.pop()
        if not len(own):
            continue
        if node < 0:
            index.append(own)
            leaf.append(np.full(len(own), -1 - node, np.int32))
            resident.append(lives)
            continue
        vantage, radius, inner, outer = nodes[node]
        d = np.bitwise_count((fps[own] ^ np.uint64(vantage)) & np.uint64(mask)).astype(np.int64)
        # a resident lives on its side; what lies inside within reach of the boundary also visits outside;
        # a visitor looks for residents and goes wherever the triangle bound leaves one possible
        to_inner = np.where(lives, d <= radius, d <= radius + reach)
        to_outer = np.where(lives, d > radius, d > radius - reach)
        crosses = lives & (d <= radius) & (d > radius - reach)
        work.append((inner, own[to_inner], lives[to_inner]))
        far = to_outer | crosses
        work.append((outer, own[far], (lives & ~crosses)[far]))
    if not index:
        return np.empty(0, int), np.empty(0, np.int32), np.empty(0, bool)
    return np.concatenate(index), np.concatenate(leaf), np.concatenate(resident)


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes (numbers below ``n``) as ``a[i] - b[i]``, one a node at most."""
    low = np.arange(n)
    while True:
        was = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        low = low[low]
        if (low == was).all():
            break
    linked = np.flatnonzero(low != np.arange(n))
    return linked, low[linked]


def links_within(rows: np.ndarray, cols: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among the values of ``rows`` and ``cols`` that are at most ``max_bits`` apart."""
    both, where = np.unique(np.concatenate([rows, cols]), return_inverse=True)
    at_row, at_col = where[: len(rows)], where[len(rows) :]
    a, b = np.empty(0, int), np.empty(0, int)
    for i in range(0, len(rows), _ROWS_AT_ONCE):
        d = np.bitwise_count(rows[i : i + _ROWS_AT_ONCE, None] ^ cols[None, :])
        x, y = np.nonzero(d <= max_bits)
        x, y = at_row[x + i], at_col[y]
        other = x != y
        if other.any():
            a, b = spanning(np.concatenate([a, x[other]]), np.concatenate([b, y[other]]), len(both))
    return both[a], both[b]


def leaf_trees(drawn: np.ndarray, rows: int, used: int, max_bits: int, aim: int = SPLIT_ROWS) -> list[tuple[list[tuple], int, int]]:
    """``(nodes, mask, reach)`` of the trees of a crowded leaf of ``rows`` rows over the bits not ``used``.

    There are enough blocks for every reach to be zero: no row visits a second leaf of a tree. None
    are returned where they would not halve the comparisons, as for one crowd of near copies.
    """
    least = max(4, int(aim * len(drawn) / max(rows, 1)))
    trees, work = [], 0.0
    for i, (mask, reach) in enumerate(bit_blocks(max_bits, max_bits + 1, used)):
        nodes = build_tree(drawn, mask, least, SEED + i)
        _, leaf, _ = route(drawn, nodes, mask, reach)
        work += float(np.square(np.bincount(leaf).astype(float)).sum())
        trees.append((nodes, mask, reach))
    return trees if 2 * work <= float(len(drawn)) ** 2 else []


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


PLACED = "path string, used long, resident boolean, fp long"
_NODES = "path string, block int, mask long, reach int, vantage array<long>, radius array<int>, inner array<int>, outer array<int>"


def split_crowded(placed: DataFrame, max_bits: int, crowded_rows: int, level: int) -> tuple[DataFrame, DataFrame] | None:
    """The rows ``PLACED`` of leaves that are small enough, and those of the others in new, smaller
    leaves; None if no leaf is crowded."""
    spare = 64 - F.bit_count("used") >= max(LEAST_BITS, 2 * (max_bits + 1))
    sizes = placed.groupBy("path", "used").agg(F.count(F.lit(1)).alias("n"))
    crowded = stored(sizes.filter((F.col("n") > crowded_rows) & spare), "crowded")
    if crowded.isEmpty():
        return None
    total = placed.count()
    rows = join_groups(placed, crowded.select("path", "n"), "path", "n", total)
    # a share of the rows that follows from the leaf's size, so a sample is bounded whatever the leaf
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit(level), "fp"), F.col("n")) < LEAF_SAMPLE)

    aim = max(1, min(SPLIT_ROWS, crowded_rows // 4))

    def build(own: pd.DataFrame) -> pd.DataFrame:
        fps = np.unique(own["fp"].to_numpy()).view(np.uint64)
        out = []
        for i, (nodes, mask, reach) in enumerate(leaf_trees(fps, int(own["n"].iloc[0]), int(own["used"].iloc[0]) & (1 << 64) - 1, max_bits, aim)):
            vantage, radius, inner, outer = ([x[j] for x in nodes] for j in range(4))
            out.append((own["path"].iloc[0], i, _signed(mask), reach, [_signed(v) for v in vantage], radius, inner, outer))
        return pd.DataFrame(out, columns=["path", "block", "mask", "reach", "vantage", "radius", "inner", "outer"])

    trees = stored(drawn.groupBy("path").applyInPandas(build, _NODES), "leaf_trees")
    chunks = F.ceil(F.col("n") / F.lit(CHUNK_ROWS)).cast("int")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("fp"), chunks).cast("int"))
    numbers = crowded.select(F.col("path").alias("leaf"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    every = trees.join(numbers, F.col("path") == F.col("leaf")).drop("leaf")

    def place(own: pd.DataFrame, grown: pd.DataFrame) -> pd.DataFrame:
        fps, lives = own["fp"].to_numpy().view(np.uint64), own["resident"].to_numpy()
        parts = [pd.DataFrame({"path": [], "used": [], "resident": [], "fp": []}).astype({"used": "int64", "resident": "bool", "fp": "int64"})]
        if len(own) and not len(grown):  # a split does not pay: the leaf stays as it is, and none is tried again
            parts.append(own[["path", "used", "resident", "fp"]].assign(used=-1))
        for t in grown.itertuples() if len(own) else ():
            mask = t.mask & (1 << 64) - 1
            nodes = [(int(v) & (1 << 64) - 1, int(r), int(i), int(o)) for v, r, i, o in zip(t.vantage, t.radius, t.inner, t.outer)]
            index, leaf, resident = route(fps, nodes, mask, t.reach, lives)
            used = _signed(int(own["used"].iloc[0]) & (1 << 64) - 1 | mask)
            path = own["path"].iloc[0]
            names = np.array([f"{path}/{t.block}.{x}" for x in range(int(leaf.max(initial=0)) + 1)], object)
            parts.append(pd.DataFrame({"path": names[leaf], "used": used, "resident": resident, "fp": fps[index].view(np.int64)}))
        return pd.concat(parts)

    finer = rows.groupBy("path", "chunk").cogroup(every.groupBy("path", "chunk")).applyInPandas(place, PLACED)
    return placed.join(crowded.select("path"), "path", "left_anti"), stored(finer, "leaves")


def near_links(
    distinct: DataFrame,
    n: int,
    max_bits: int = MAX_BITS,
    blocks: int = BLOCKS,
    sample: int = SAMPLE,
    leaf_rows: int = LEAF_ROWS,
    cell_rows: int = CELL_ROWS,
    crowded_rows: int = CROWDED_ROWS,
) -> DataFrame:
    """Links ``(a, b)`` that join every two of the ``n`` distinct fingerprints ``fp`` at most
    ``max_bits`` apart, directly or through others that are."""
    chosen = [r[0] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()]
    drawn = np.array(chosen, np.int64).view(np.uint64)
    leaf_sample = max(4, int(leaf_rows * len(drawn) / max(n, 1)))
    trees = [(build_tree(drawn, mask, leaf_sample, SEED + i), mask, reach) for i, (mask, reach) in enumerate(bit_blocks(max_bits, blocks))]

    def place(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for k, (nodes, mask, reach) in enumerate(trees):
                index, leaf, resident = route(fps.view(np.uint64), nodes, mask, reach)
                names = np.array([f"{k}.{x}" for x in range(int(leaf.max(initial=0)) + 1)], object)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[leaf], pa.string()), pa.array(np.full(len(index), _signed(mask))), pa.array(resident), pa.array(fps[index])],
                    ["path", "used", "resident", "fp"],
                )

    ready, placed = [], stored(distinct.select("fp").mapInArrow(place, PLACED), "leaves")
    for level in range(LEVELS):
        parts = split_crowded(placed, max_bits, crowded_rows, level)
        if parts is None:
            break
        ready.append(parts[0])
        placed = parts[1]
    for part in ready:
        placed = placed.union(part.select(*placed.columns))
    # stored, so that its size decides how it is joined
    size = F.count(F.lit(1))
    chunks = stored(placed.groupBy("path").agg(size.alias("n"), F.ceil(size / F.lit(cell_rows)).cast("int").alias("chunks")), "chunks")
    batches = max(1, -(-(chunks.agg(F.sum(2 * F.col("n") * F.col("chunks"))).first()[0] or 0) // BATCH_ROWS))
    cut = placed.join(chunks.drop("n"), "path")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    as_column = cut.select("path", F.explode(every).alias("i"), own.alias("j"), F.lit(False).alias("row"), "fp")
    as_row = cut.filter("resident").select("path", own.alias("i"), F.explode(every).alias("j"), F.lit(True).alias("row"), "fp")

    def compare(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("cell", kind="stable")
        cell, fps, row = batch["cell"].to_numpy(), batch["fp"].to_numpy().view(np.uint64), batch["row"].to_numpy()
        ends = np.r_[np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell)]
        found = [links_within(fps[lo:hi][row[lo:hi]], fps[lo:hi][~row[lo:hi]], max_bits) for lo, hi in zip(np.r_[0, ends[:-1]], ends)]
        a, b = (np.concatenate([x[n] for x in found]) for n in range(2))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    # most cells are small, so a task takes many; two cells of one number are compared as one, which finds no wrong link
    cells = as_column.union(as_row).select(F.xxhash64("path", "i", "j").alias("cell"), "row", "fp")
    cells = cells.withColumn("batch", F.pmod("cell", F.lit(batches)))
    return cells.groupBy("batch").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, **limits: int) -> DataFrame:
    """``(doc_id, fingerprint, component_id, copies)`` for every row: the smallest doc_id
    reachable over links of at most ``max_bits`` bits; ``copies`` rows share the fingerprint."""
    rows = stored(fingerprints(docs, shingle_words), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "distinct")
    roots = components(near_links(distinct, distinct.count(), max_bits, **limits))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = stored(placed, "rooted")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "root").select("fp", "copies", "component_id")
    out = join_groups(rows, named, "fp", "copies", rows.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies")


def one_of_each(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component, with all their columns.

    Rows without a doc_id stay only where their component has no other.
    """
    found = near_duplicates(docs, shingle_words, max_bits)
    name = free_name(docs, "__id")
    stays = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    same = column(docs, "doc_id", "long").eqNullSafe(F.col(name))
    return docs.join(stays, same, "left_semi").select(*docs.columns)
