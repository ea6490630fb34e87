"""The blocked similarity join against numpy brute force, with blocks forced small."""

import numpy as np
import pytest

from lexiprop.operators.similarity import similarity_join


def _vectors(spark, n=230, d=6, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    df = spark.createDataFrame([(f"w{i:03d}", [float(v) for v in x[i]]) for i in range(n)], "word string, vector array<double>")
    return x, df


@pytest.mark.parametrize("block_rows", [1000, 37])
def test_knn_self_join(spark, block_rows):
    x, df = _vectors(spark)
    got = similarity_join(df, df, left_id="word", right_id="word", k=4, exclude_same_id=True, block_rows=block_rows)
    got = {(r.src, r.dst) for r in got.collect()}
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = {(f"w{i:03d}", f"w{j:03d}") for i in range(len(x)) for j in np.argsort(d[i], kind="stable")[:4]}
    assert got == want


@pytest.mark.parametrize("block_rows", [1000, 29])
def test_radius_self_join(spark, block_rows):
    x, df = _vectors(spark)
    got = similarity_join(df, df, left_id="word", right_id="word", radius=2.0, block_rows=block_rows)
    got = {(r.src, r.dst): r.score for r in got.collect()}
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    want = {(f"w{i:03d}", f"w{j:03d}"): d[i, j] for i in range(len(x)) for j in range(len(x)) if d[i, j] <= 2.0}
    assert set(got) == set(want)
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want)


@pytest.mark.parametrize("block_rows", [1000, 23])
def test_dot_top_k_with_exclusions_and_partitions(spark, block_rows):
    from pyspark.sql import functions as F

    x, words = _vectors(spark, n=120, d=5, seed=11)
    rng = np.random.default_rng(5)
    q = rng.normal(size=(9, 5))
    own = {f"w{i:03d}": int(i % 9) for i in range(0, 120, 4)}
    rows = []
    for part in (1, 2):
        rows += [(part, s, [float(v) for v in q[s]]) for s in range(9)]
    queries = spark.createDataFrame(rows, "split_id int, synset int, vector array<double>").withColumn("own", F.col("synset"))
    owned = spark.createDataFrame([(p, w, s) for p in (1, 2) for w, s in own.items() if p == 1], "split_id int, word string, own int")
    right = words.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("split_id"), "word", "vector").join(
        owned, ["split_id", "word"], "left"
    )
    got = similarity_join(
        queries, right, left_id="synset", right_id="word", metric="dot", k=6, exclude_key="own", by="split_id", block_rows=block_rows
    )
    got = {(r.split_id, r.src, r.dst) for r in got.collect()}
    want = set()
    for part in (1, 2):
        for s in range(9):
            sims = x @ q[s]
            cands = [(-sims[i], f"w{i:03d}") for i in range(len(x)) if not (part == 1 and own.get(f"w{i:03d}") == s)]
            for _, w in sorted(cands)[:6]:
                want.add((part, s, w))
    assert got == want


def _brute(vectors, k=None, radius=None):
    n = len(vectors)
    d = np.sqrt(((vectors[:, None, :] - vectors[None, :, :]) ** 2).sum(axis=2))
    out = set()
    for i in range(n):
        js = sorted((d[i, j], j) for j in range(n) if j != i)
        out |= {(i, j) for _, j in js[:k]} if k else {(i, j) for x, j in js if x <= radius}
    return out


@pytest.mark.parametrize("offset,spread", [(0.0, 1.0), (1e5, 1e-2), (1e4, 1e-3)])
@pytest.mark.parametrize("block_rows", [17, 1000])
def test_vectors_far_from_the_origin(spark, offset, spread, block_rows):
    rng = np.random.default_rng(4)
    v = offset + spread * rng.standard_normal((60, 5))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "word long, vector array<double>")
    args = dict(left_id="word", right_id="word", exclude_same_id=True, block_rows=block_rows)
    got = {(r.src, r.dst) for r in similarity_join(df, df, k=5, **args).collect()}
    assert got == _brute(v, k=5)
    got = {(r.src, r.dst) for r in similarity_join(df, df, radius=2.0 * spread, **args).collect()}
    assert got == _brute(v, radius=2.0 * spread)


def test_equal_vectors_give_k_pairs_each(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(120)], "word long, vector array<double>")
    for block_rows in (25, 1000):
        out = similarity_join(df, df, left_id="word", right_id="word", exclude_same_id=True, k=3, block_rows=block_rows).collect()
        want = {(i, j) for i in range(120) for j in [x for x in range(5) if x != i][:3]}
        assert len(out) == 360 and {(r.src, r.dst) for r in out} == want
