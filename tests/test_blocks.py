"""The kernel of the similarity join against brute force, and when pivot cells are used."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiprop.functions.vectors import l2_normalize
from lexiprop.operators import blocks as bk
from lexiprop.operators import pivots as pv
from lexiprop.operators import similarity as si
from lexiprop.operators.graph import radius_graph, symmetrize


def _vectors(n, seed=7, dims=8):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims))
    v[n // 4 : n // 3] = v[n // 4]  # copies
    return v


def _distances(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))


def _nothing():
    return bk.Skipped([])


@pytest.mark.parametrize("length", [1.0, 1e7, 1e30])
def test_nearest_with_ties_skips_and_one_long_vector(monkeypatch, length):
    monkeypatch.setattr(bk, "_ROWS", 16)
    monkeypatch.setattr(bk, "_COLS", 40)
    a, b = _vectors(70), np.concatenate([_vectors(150), _vectors(70)[:30]])
    b[3] *= length
    keys = np.arange(70), np.concatenate([np.arange(100, 250), np.arange(30)])
    skip = bk.Skipped([bk.equal_codes(*keys, True)])
    got = sorted((i, j) for x, y, _ in bk.nearest(a, b, 5, False, np.arange(180), skip) for i, j in zip(x.tolist(), y.tolist()))
    d = _distances(a, b)
    d[keys[0][:, None] == keys[1][None]] = np.inf
    assert got == sorted((i, int(j)) for i in range(70) for j in np.lexsort((np.arange(180), d[i]))[:5])


def test_all_of_the_first_columns_skipped(monkeypatch):
    monkeypatch.setattr(bk, "_COLS", 10)
    a, b = _vectors(6), _vectors(40, seed=8)
    skip = bk.Skipped([(np.zeros(6, np.int64), np.r_[np.zeros(25, np.int64), np.full(15, -1)])])
    found = {i: set(y[x == i].tolist()) for x, y, _ in bk.nearest(a, b, 4, True, np.arange(40), skip) for i in range(6)}
    for i in range(6):
        assert found[i] == {int(25 + j) for j in np.argsort(-(b[25:] @ a[i]), kind="stable")[:4]}


def test_within_radius_far_from_the_origin(monkeypatch):
    monkeypatch.setattr(bk, "_COLS", 32)
    v = _vectors(90) + 1e5
    got = {(i, j) for x, y, _ in bk.within(v, v, 2.5, _nothing()) for i, j in zip(x.tolist(), y.tolist())}
    assert got == set(zip(*(x.tolist() for x in np.nonzero(_distances(v, v) <= 2.5))))


def test_a_block_with_itself_works_a_distance_out_once(monkeypatch):
    monkeypatch.setattr(bk, "_ROWS", 16)
    monkeypatch.setattr(bk, "_COLS", 32)
    v, tiles, scored = _vectors(400), [], []
    tile, exact = bk._Product.tile, bk.exact_scores
    monkeypatch.setattr(bk._Product, "tile", lambda self, *at: tiles.append(at) or tile(self, *at))
    monkeypatch.setattr(bk, "exact_scores", lambda a, b, i, j, dot: scored.append(len(i)) or exact(a, b, i, j, dot))
    d, seen = _distances(v, v), []
    for i, j, score in bk.within(v, v, 1.5, _nothing(), True):
        assert np.allclose(score, d[i, j])
        seen += zip(i.tolist(), j.tolist())
    want = np.triu(d <= 1.5)
    assert len(seen) == len(set(seen)) and set(seen) == set(zip(*(x.tolist() for x in np.nonzero(want))))
    assert sum(scored) < 1.05 * want.sum() and len(tiles) < 0.6 * 25 * 13


@pytest.mark.parametrize("exclude", [False, True])
@pytest.mark.parametrize("block_rows", [1000, 40])
def test_radius_join_within_a_block_gives_both_ends_and_each_row_itself_once(spark, monkeypatch, exclude, block_rows):
    v = _vectors(130)
    df = _frame(spark, v).withColumn("word", F.when(F.col("word") < 125, F.col("word")).otherwise(F.lit(3).cast("long")))  # a word with several vectors
    word = [i if i < 125 else 3 for i in range(130)]
    d = _distances(v, v)
    want = sorted((word[i], word[j], round(d[i, j], 9)) for i, j in zip(*np.nonzero(d <= 2.0)) if not (exclude and word[i] == word[j]))
    got = si.similarity_join(df, df, left_id="word", right_id="word", radius=2.0, exclude_same_id=exclude, block_rows=block_rows).collect()
    assert sorted((r.src, r.dst, round(r.score, 9)) for r in got) == want


def test_null_ids_match_each_other_and_null_values_nothing():
    a, b = bk.equal_codes(np.array(["x", None], object), np.array([None, "x", "y"], object), True)
    assert (a[:, None] == b[None]).tolist() == [[False, True, False], [True, False, False]]
    a, b = bk.equal_codes(np.array([1, None], object), np.array([None, 1], object), False)
    assert bk.Skipped([(a, b)]).kept(np.array([0, 1, 0]), np.array([1, 0, 0])).tolist() == [False, True, True]


def _frame(spark, v):
    return spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "word long, vector array<double>")


def test_pivot_cells_only_where_they_exclude_pairs(spark):
    rng = np.random.default_rng(2)
    loose = rng.normal(size=(1200, 40))
    loose /= np.linalg.norm(loose, axis=1, keepdims=True)
    tight = np.repeat(rng.normal(size=(24, 40)) * 20, 50, axis=0) + rng.normal(size=(1200, 40)) * 0.01
    share = []
    for v in (loose, tight):
        rows = _frame(spark, v).select(F.col("word").alias("key"), F.col("vector").alias("v"))
        share.append((pv.visited_share(rows, rows, 12_000, False, 3, None), pv.visited_share(rows, rows, 12_000, False, None, 0.5)))
    assert min(share[0]) > 1 - si.PIVOT_SHARE and max(share[1]) < 1 - si.PIVOT_SHARE


def test_vectors_without_clusters_meet_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(si, "PIVOT_ROWS", 50)
    monkeypatch.setattr(si, "PivotIndex", lambda *a: pytest.fail("cells that exclude nothing"))
    v = np.random.default_rng(4).normal(size=(120, 30))
    df = _frame(spark, v)
    d = _distances(v, v)
    np.fill_diagonal(d, np.inf)
    got = {(r.src, r.dst) for r in si.similarity_join(df, df, left_id="word", right_id="word", k=3, exclude_same_id=True).collect()}
    assert got == {(i, int(j)) for i in range(120) for j in np.argsort(d[i])[:3]}


def test_radius_graph_is_symmetric_without_an_aggregation(spark):
    df = _frame(spark, _vectors(60))
    for rows in (df, df.unionByName(df.limit(5)), df.unionByName(df.limit(1).withColumn("word", F.lit(None).cast("long")))):
        got = radius_graph(rows, radius=2.5, mode="distance")
        want = symmetrize(radius_graph(rows, radius=2.5, mode="distance", force_symmetric=False))
        key = lambda r: (r.src is None, r.src or 0, r.dst is None, r.dst or 0, r.weight)
        assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    plan = radius_graph(df, radius=2.5, mode="distance")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_normalising_works_the_norm_out_once(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([1.0, None],)], "v array<double>")
    assert [r.u for r in df.select(l2_normalize(F.col("v")).alias("u")).collect()] == [[0.6, 0.8], [0.0, 0.0], None, [1.0, None]]
    plan = df.select(l2_normalize(F.col("v")).alias("u"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


@pytest.mark.parametrize("odd", [None, [1.0], [1.0, 2.0, 3.0]])
def test_null_and_uneven_vectors_are_refused(spark, odd):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, odd), (3, odd), (4, [5.0, 6.0])], "word long, vector array<double>")
    with pytest.raises(Exception, match="a vector is null|reshape"):
        si.similarity_join(df, df, left_id="word", right_id="word", k=1).collect()
