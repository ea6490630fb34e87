"""Similarity joins by pivot cells against brute force, and how much the bounds exclude."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiprop.operators import pivots as pv
from lexiprop.operators.similarity import similarity_join


def _vectors(spark, m, ids=None, **more):
    names = list(more)
    rows = [(i if ids is None else ids[i], [float(x) for x in v], *[more[n][i] for n in names]) for i, v in enumerate(m)]
    kinds = "".join(f", {n} int" for n in names)
    return spark.createDataFrame(rows, f"id {'long' if ids is None else 'string'}, vector array<double>{kinds}")


def _clusters(n=1200, dims=6, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(24, dims)) * 20
    m = centres[rng.integers(0, 24, n)] + rng.normal(size=(n, dims))
    m[n // 10 : n // 9] = m[n // 10]  # repeated rows and ties
    return m


def _brute(a, b, score, k=None, limit=None, skip=lambda i, j: False):
    out = set()
    for i in range(len(a)):
        s = [(round(float(score(a[i], b[j])), 9), j) for j in range(len(b)) if not skip(i, j)]
        s = sorted(s)[:k] if k else [x for x in s if x[0] <= limit]
        out |= {(i, j, x) for x, j in s}
    return out


def _pairs(df, sign=1):
    return {(r.src, r.dst, round(sign * r.score, 9)) for r in df.collect()}


def _distance(x, y):
    return np.sqrt(((x - y) ** 2).sum())


@pytest.mark.parametrize("shift", [0.0, 1e5])
def test_nearest_equal_brute_force(spark, shift):
    m = _clusters(400) + shift
    df = _vectors(spark, m)
    got = similarity_join(df, df, left_id="id", right_id="id", k=4, exclude_same_id=True, cell_rows=16, block_rows=90)
    exp = _brute(m, m, _distance, k=4, skip=lambda i, j: i == j)
    assert {(a, b) for a, b, _ in _pairs(got)} == {(a, b) for a, b, _ in exp}


def test_radius_equals_brute_force_without_duplicates(spark):
    m = _clusters(400)
    df = _vectors(spark, m)
    got = similarity_join(df, df, left_id="id", right_id="id", radius=2.0, cell_rows=16, block_rows=50)
    rows = got.collect()
    assert len(rows) == len({(r.src, r.dst) for r in rows})
    assert _pairs(got) == _brute(m, m, _distance, limit=2.0)


def test_inner_products_with_parts_and_exclusions(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(80, 5)) * rng.uniform(0.1, 9, (80, 1)), rng.normal(size=(300, 5)) * rng.uniform(0.1, 9, (300, 1))
    ka, kb, pa, pb = rng.integers(0, 4, 80), rng.integers(0, 4, 300), rng.integers(0, 2, 80), rng.integers(0, 2, 300)
    left = _vectors(spark, a, ex=[int(x) for x in ka], split=[int(x) for x in pa])
    right = _vectors(spark, b, ex=[int(x) for x in kb], split=[int(x) for x in pb])
    got = similarity_join(left, right, left_id="id", right_id="id", metric="dot", k=3, exclude_key="ex", by="split", cell_rows=10, block_rows=40)
    exp = _brute(a, b, lambda x, y: -(x @ y), k=3, skip=lambda i, j: ka[i] == kb[j] or pa[i] != pb[j])
    assert _pairs(got, -1) == exp


def test_fewer_rows_than_k_and_string_ids(spark):
    m = _clusters(9)
    df = _vectors(spark, m, ids=[f"w{i}" for i in range(9)])
    got = similarity_join(df, df, left_id="id", right_id="id", k=20, exclude_same_id=True, cell_rows=2, block_rows=3)
    assert got.count() == 9 * 8


def test_bounds_exclude_most_cells_of_clustered_vectors(spark):
    m = _clusters(1200)
    rows = _vectors(spark, m).select(F.lit(0).alias("part"), F.col("id").cast("string").alias("key"), F.col("vector").alias("v"), F.lit(None).cast("int").alias("ex"))
    index = pv.PivotIndex(rows, 1200, bin_rows=100, cell_rows=16)
    found = pv.visits(rows.withColumn("bound", F.lit(3.0)), index, False, 100, 1200, False)
    cells, bins = found.agg(F.sum(F.size("cells")), F.countDistinct("lblk", "bin")).first()
    assert cells < 0.2 * 1200 * len(index.cells.pivots)
    assert bins < 0.5 * found.select("lblk").distinct().count() * index.cells.bins
    sizes = [r["count"] for r in index.rows.groupBy("bin").count().collect()]
    assert sum(sizes) == 1200 and max(sizes) < 200


def test_a_crowded_cell_takes_several_bins():
    first, several = pv.grouped_cells(np.array([[0.0], [1.0], [9.0]]), np.array([1000, 10, 10]), 100)
    assert several.tolist() == [10, 1, 1] and first[0] == 0 and sorted(first[1:]) == [10, 10]
