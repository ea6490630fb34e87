"""Skew-safe prefix sums, quantiles and average ranks against pandas, including the multi-bucket path."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiprop.functions.ranking import average_rank, exact_quantiles, value_prefix


def _data(spark, n=3000, seed=4):
    rng = np.random.default_rng(seed)
    # heavy ties: a third of all rows share one value
    vals = np.concatenate([np.full(n // 3, 7), rng.integers(0, 500, size=n - n // 3)])
    return vals, spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "v": vals.astype("int64")}))


@pytest.mark.parametrize("n_buckets", [None, 7])
def test_quantiles_match_pandas(spark, n_buckets):
    vals, df = _data(spark)
    got = exact_quantiles(df, "v", [0.1, 0.25, 0.5, 0.75, 0.9], ["a", "b", "c", "d", "e"], n_buckets=n_buckets).first()
    want = pd.Series(vals).quantile([0.1, 0.25, 0.5, 0.75, 0.9]).tolist()
    assert [round(x, 9) for x in got] == [round(x, 9) for x in want]


@pytest.mark.parametrize("n_buckets", [None, 5])
def test_average_rank_matches_pandas(spark, n_buckets):
    vals, df = _data(spark, n=1200)
    got = {r.id: r.r for r in average_rank(df, "v", "r", n_buckets=n_buckets).collect()}
    want = pd.Series(vals).rank(method="average").tolist()
    assert all(abs(got[i] - want[i]) < 1e-9 for i in range(len(vals)))


def test_weighted_prefix(spark):
    df = spark.createDataFrame([("b", 3), ("a", 2), ("c", 5)], "doc string, n long")
    got = {r.doc: (r.before, r.total) for r in value_prefix(df, "doc", weight="n", n_buckets=4).collect()}
    assert got == {"a": (0, 10), "b": (2, 10), "c": (5, 10)}
