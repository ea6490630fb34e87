import itertools
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from lexiprop.llm import budget_mix as bm
from lexiprop.llm import shard_minimax as sm

DOCS = "doc_id long, text string, source string, size string, shard string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows], DOCS)


def _resharing(sizes, weights=(5, 2, 1)):
    """The rule as it is stated: stop at twice the size, share the excess anew until none is above."""
    w = [weights[i % 3] for i in range(len(sizes))]
    target, left, free = [Fraction(0)] * len(sizes), Fraction(3, 2) * sum(sizes), set(range(len(sizes)))
    while free:
        share = {i: left * w[i] / sum(w[j] for j in free) for i in free}
        over = [i for i in free if share[i] > 2 * sizes[i]]
        if not over:
            for i in free:
                target[i] = share[i]
            break
        for i in over:
            target[i] = Fraction(2 * sizes[i])
            left -= target[i]
            free.discard(i)
    return target


@pytest.mark.parametrize("sizes", [[10, 10, 10], [100, 1, 1, 1, 5], [0, 3, 50], [7], [1000, 2, 3, 4, 5, 6, 7, 900], []])
def test_targets(sizes):
    assert bm.targets(sizes) == _resharing(sizes)


def test_knapsack_equals_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 14), 4)))
        counts = np.array([rng.randrange(4) for _ in lengths])
        budget = rng.randrange(0, 40)
        got = bm.knapsack(lengths, counts, budget)
        assert (got <= counts).all()
        sums = {int(sum(k * n for k, n in zip(ks, lengths))) for ks in itertools.product(*[range(c + 1) for c in counts])}
        best = min(abs(s - budget) for s in sums)
        assert abs(int((got * lengths).sum()) - budget) == best


def test_fit_meets_large_targets_exactly():
    rng = np.random.default_rng(1)
    lengths, counts = np.arange(0, 900), rng.integers(0, 50, 900)
    total = int((lengths * counts).sum())
    for target in (total // 7, total + 12345, 2 * total):
        for width in (500, 1 << 16):
            passes, extra = bm.fit(lengths, counts, target, width)
            assert (extra <= counts).all() and passes * total + int((extra * lengths).sum()) == target


def test_fit_of_long_documents_drops_no_budget():
    one = np.array([300_000]), np.array([1])
    assert [int(x) for x in (bm.fit(*one, 570_000)[0], bm.fit(*one, 570_000)[1][0])] == [1, 1]  # 600,000 is nearest
    assert bm.fit(np.array([80_000, 90_000, 100_000]), np.array([1, 1, 1]), 170_000)[1].tolist() == [1, 1, 0]
    assert bm.fit(np.array([2, 3]), np.array([3, 2]), 6)[1].tolist() in ([0, 2], [3, 0])
    lengths = np.arange(70_000, 74_000, 37)  # distinct lengths, so every proportional share is 0
    counts = np.ones(len(lengths), np.int64)
    target = int(lengths[[3, 20, 50, 70, 71, 90]].sum())
    passes, extra = bm.fit(lengths, counts, target)
    assert passes == 0 and (extra <= counts).all() and int((extra * lengths).sum()) == target


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 30)), rng.choice(["b", "é", "a", "a", "a", None])) for i in range(1500)]
    rows += [(2000 + i, "same length here", "a") for i in range(1500)]  # one length with half of all rows
    rows += [(None, None, None), (3, "w w", "b"), (3, "w w", "b"), (5000, "w " * 100_000, "z")]
    out = bm.mix(_docs(spark, rows), cell_rows=50).collect()
    assert len(out) == len(rows)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken in (0, r["size"], 2 * r["size"])
    names = sorted([s for s in size if s is not None]) + [None]
    assert [target[s] for s in names] == [float(t) for t in _resharing([size[s] for s in names])]
    assert all(r.source_size == size[r.source] for r in out)
    for s in names:
        if s != "z":
            assert abs(taken[s] - target[s]) <= 1
    again = bm.mix(_docs(spark, rows[::-1]).repartition(5), cell_rows=50).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    assert bm.mix(_docs(spark, [])).count() == 0


def test_mixed_documents_repeat_rows(spark):
    docs = _docs(spark, [(i, "w " * (1 + i % 5), "ab"[i % 9 == 0]) for i in range(90)] + [(4, "w " * 5, "a")])
    out = bm.mixed_documents(docs)
    assert out.columns == docs.columns
    want = sum(r.taken for r in bm.mix(docs).collect())
    assert sum(len(r.text.split()) for r in out.collect()) == want


def _minimax(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        used, room = 0, 0
        for s in sizes:
            if room < s:
                used, room = used + 1, mid
            room -= s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


def _check_shards(rows, out, shards):
    size = lambda t: len((t or "").encode()) + 16
    assert len(out) == len(rows)
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    far = 1 << 62
    order = sorted(groups, key=lambda t: min(far if i is None else i for i in groups[t]))
    sizes = [size(t) * len(groups[t]) for t in order]
    held = defaultdict(int)
    slots, by_text = defaultdict(list), defaultdict(set)
    crc = {zlib.crc32(t.encode()): t for t in groups}
    for r in out:
        held[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        by_text[crc[r.text_crc32]].add(r.shard)
        assert (r.law, r.grown_shard) == ("bytes", None) and r["size"] == size(crc[r.text_crc32])
    assert max(held.values()) == _minimax(sizes, shards) and max(held) < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in by_text.values())
    assert [min(by_text[t]) for t in order] == sorted(min(by_text[t]) for t in order)


@pytest.mark.parametrize("cells,range_rows,shards", [(8, 100, 7), (64, 1000, 40), (1 << 16, 100_000, 40)])
def test_shards_equal_brute_force(spark, cells, range_rows, shards):
    rng = random.Random(cells)
    rows = [(i * 3, "é" * rng.randrange(200) + str(rng.randrange(900)), None) for i in range(1200)]
    rows += [(5000 + i, "copied", None) for i in range(600)] + [(1, None, None), (2, "", None), (2, "", None), (None, "x", None), (7, "y" * 9000, None), (7, "z", None)]
    rng.shuffle(rows)
    _check_shards(rows, sm.shard(_docs(spark, rows), shards, cells, range_rows).collect(), shards)


def test_shards_of_few_rows(spark):
    assert sm.shard(_docs(spark, [])).count() == 0
    rows = [(1, "a", None), (2, "b", None), (3, "a", None)]
    _check_shards(rows, sm.shard(_docs(spark, rows), 40).collect(), 40)


def test_sharding_runs_no_python(spark):
    plan = sm.shard(_docs(spark, [(1, "a", None)]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
