"""Diffusion on tiny hand-computed graphs, and a dense numpy brute force on a small random graph."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiprop.operators import graph as gr
from lexiprop.operators import propagate as pr


def _edges(spark, pairs, undirected=True):
    rows = []
    for a, b, w in pairs:
        rows.append((a, b, float(w)))
        if undirected:
            rows.append((b, a, float(w)))
    return spark.createDataFrame(rows, "src string, dst string, weight double")


def _labels(spark, nodes, seeds):
    return spark.createDataFrame([(1, n, int(seeds.get(n, -1))) for n in nodes], "split_id int, word string, y_train int")


def _run(spark, edges, labels, method="label_propagation", iterations=3, alpha=0.2):
    out = pr.propagate(edges, labels, method, iterations, alpha).collect()
    return {r["word"]: (r["y_pred"], round(r["y_conf"], 9), list(r["y_top3_classes"])) for r in out}


def test_path3_reaches_c_after_two_steps(spark):
    e = _edges(spark, [("a", "b", 1), ("b", "c", 1)])
    lab = _labels(spark, "abc", {"a": 0})
    one = _run(spark, e, lab, iterations=1)
    assert one["c"] == (-1, 0.0, [-1, -1, -1])
    assert one["b"][0] == 0
    two = _run(spark, e, lab, iterations=2)
    assert two["c"] == (0, 1.0, [0, -1, -1])
    assert two["a"] == (0, 1.0, [0, -1, -1])


def test_tie_goes_to_smaller_class(spark):
    e = _edges(spark, [("a", "c", 1), ("b", "c", 1)])
    res = _run(spark, e, _labels(spark, "abc", {"a": 0, "b": 1}), iterations=1)
    assert res["c"] == (0, 0.5, [0, 1, -1])


def test_isolated_nodes(spark):
    e = _edges(spark, [("a", "b", 1)])
    res = _run(spark, e, _labels(spark, "abcd", {"a": 0, "d": 1}), iterations=3)
    assert res["c"] == (-1, 0.0, [-1, -1, -1])
    assert res["d"] == (1, 1.0, [1, -1, -1])
    assert res["b"] == (0, 1.0, [0, -1, -1])


def test_negative_weights_symmetrize(spark):
    e = spark.createDataFrame(
        [("a", "b", -0.2), ("c", "d", -0.3), ("d", "c", -0.3)], "src string, dst string, weight double"
    )
    sym = {(r.src, r.dst): r.weight for r in gr.symmetrize(e).collect()}
    assert sym == {("c", "d"): -0.3, ("d", "c"): -0.3}


def test_fewer_than_three_classes_padded(spark):
    e = _edges(spark, [("a", "b", 1)])
    res = _run(spark, e, _labels(spark, "ab", {"a": 0}), iterations=2)
    assert res["b"] == (0, 1.0, [0, -1, -1])


def test_unknown_method_raises(spark):
    e = _edges(spark, [("a", "b", 1)])
    with pytest.raises(NotImplementedError):
        pr.propagate(e, _labels(spark, "ab", {"a": 0}), "label_magic", 1)


def _dense(n, edges, seeds, method, iterations, alpha):
    a = np.zeros((n, n))
    for i, j, w in edges:
        a[i, j] = w
    classes = sorted(set(seeds.values()))
    y0 = np.zeros((n, len(classes)))
    for i, c in seeds.items():
        y0[i, classes.index(c)] = 1.0
    deg = a.sum(axis=1)
    y = y0.copy()
    if method == "label_propagation":
        p = np.divide(a, deg[:, None], out=np.zeros_like(a), where=deg[:, None] != 0)
        unl = np.array([i not in seeds for i in range(n)])
        for _ in range(iterations):
            y = np.where(unl[:, None], p @ y, y0)
    else:
        dm = np.where(deg > 0, deg ** -0.5, 0.0)
        s = dm[:, None] * a * dm[None, :]
        for _ in range(iterations):
            y = alpha * s @ y + (1 - alpha) * y0
    tot = y.sum(axis=1, keepdims=True)
    conf = np.divide(y, tot, out=np.zeros_like(y), where=tot != 0)
    out = {}
    for i in range(n):
        order = sorted(range(len(classes)), key=lambda c: (-round(conf[i, c], 9), classes[c]))
        best = order[0]
        pred = classes[best] if conf[i, best] != 0 else -1
        out[i] = (pred, round(conf[i, best], 6))
    return out


@pytest.mark.parametrize("method,alpha", [("label_propagation", 0.2), ("label_spreading", 0.2), ("label_spreading", 0.95)])
def test_matches_dense_numpy(spark, method, alpha):
    rng = np.random.default_rng(7)
    n = 40
    edges = set()
    for i in range(n):
        for j in rng.choice(n, 3, replace=False):
            if i != j:
                edges.add((min(i, j), max(i, j)))
    wts = {e: float(rng.uniform(0.1, 1.0)) for e in edges}
    directed = [(i, j, w) for (i, j), w in wts.items()] + [(j, i, w) for (i, j), w in wts.items()]
    seeds = {i: int(rng.integers(0, 4)) for i in range(0, n, 3)}
    expected = _dense(n, directed, seeds, method, 6, alpha)
    e = spark.createDataFrame([(f"w{i}", f"w{j}", w) for i, j, w in directed], "src string, dst string, weight double")
    lab = _labels(spark, [f"w{i}" for i in range(n)], {f"w{i}": c for i, c in seeds.items()})
    got = _run(spark, e, lab, method, 6, alpha)
    for i in range(n):
        pred, conf, _ = got[f"w{i}"]
        assert (pred, round(conf, 6)) == expected[i], i


def test_spreading_can_relabel_train_word(spark):
    # a is seeded 0 but its neighbours (a clique) are seeded 1; with alpha near 1 the graph wins
    e = _edges(spark, [("a", "b", 1), ("a", "c", 1), ("a", "d", 1), ("b", "c", 1), ("c", "d", 1), ("b", "d", 1)])
    res = _run(spark, e, _labels(spark, "abcd", {"a": 0, "b": 1, "c": 1, "d": 1}), "label_spreading", 10, 0.99)
    assert res["a"][0] == 1
    lp = _run(spark, e, _labels(spark, "abcd", {"a": 0, "b": 1, "c": 1, "d": 1}), "label_propagation", 10)
    assert lp["a"][0] == 0


def test_confidences_sum_to_one_or_zero(spark):
    e = _edges(spark, [("a", "b", 1), ("b", "c", 1), ("c", "d", 1)])
    lab = _labels(spark, "abcde", {"a": 0, "d": 1})
    state = pr.label_propagation(e, lab, 3)
    tot = state.groupBy("word").agg(F.sum("score").alias("t"))
    conf = state.join(tot, "word").groupBy("word").agg(F.sum(F.col("score") / F.col("t")).alias("s")).collect()
    for r in conf:
        assert abs(r["s"] - 1.0) < 1e-12


def test_hubs_are_dealt_into_parts(spark):
    """A star: no partition of the kept edges holds more than a small share, and the results are those
    of the plain sums."""
    n = 3000
    spokes = [(f"s{i}", "hub", 1.0) for i in range(n)] + [("hub", f"s{i}", 1.0) for i in range(n)]
    ring = [(f"s{i}", f"s{(i + 1) % n}", 1.0) for i in range(n)]
    edges = spark.createDataFrame(spokes + ring, "src string, dst string, weight double")
    dealt, hubs = pr.split_hubs(edges)
    assert [r.dst for r in hubs.collect()] == ["hub"]
    parts = dealt.filter("dst = 'hub'").groupBy("part").count().collect()
    assert len(parts) > 5 and max(r["count"] for r in parts) < n / 5
    labels = spark.createDataFrame([(1, "hub", -1)] + [(1, f"s{i}", 1 if i < 10 else 2 if i < 15 else -1) for i in range(n)], "split_id int, word string, y_train int")
    out = {(r.word, r.synset): r.score for r in pr.label_propagation(edges, labels, 1).collect()}
    assert abs(out["hub", 1] - 10 / n) < 1e-9 and abs(out["hub", 2] - 5 / n) < 1e-9
    s = {(r.word, r.synset): r.score for r in pr.label_spreading(edges, labels, 1, 0.2).collect()}
    # D of the hub is n, of the others 2
    assert abs(s["hub", 1] - 0.2 * 10 / np.sqrt(2 * n)) < 1e-9
