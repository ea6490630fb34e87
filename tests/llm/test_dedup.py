import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexiprop.llm import digest_index as di
from lexiprop.llm import simhash_vptree as sv
from lexiprop.llm.components import components

DOCS = "doc_id long, text string, digest string, fp string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)


def _simhash(text, k=4):
    w = [x for x in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _groups(fps, ids, bits):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(fps))]


TEXTS = [None, "", " \n", "a b", "A  b", "one two three four five", "é É x\ty z", "w " * 3000, "One two three four five"]


def test_fingerprint_equals_brute_force():
    for t in TEXTS:
        assert sv.fingerprint(t) == _simhash(t)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(400)}" for _ in range(120)] for _ in range(40)]
    rows, i = [], 0
    for b in base:
        for _ in range(rng.randrange(1, 6)):
            t = list(b)
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = "changed"
            rows.append((i, " ".join(t)))
            i += 1
    rows += [(i + k, t) for k, t in enumerate(TEXTS)] + [(0, rows[0][1])]
    got = {(r.doc_id, r.fingerprint): r.component_id for r in sv.near_duplicates(_docs(spark, rows)).collect()}
    fps = [_simhash(t) for _, t in rows]
    want = _groups(fps, [i for i, _ in rows], 4)
    assert got == {(i, f"{f:016x}"): c for (i, _), f, c in zip(rows, fps, want)}
    assert sv.near_duplicates(_docs(spark, rows)).count() == len(rows)


@pytest.mark.parametrize("max_bits,blocks", [(4, 4), (4, 3), (4, 1), (7, 3), (1, 4), (0, 2)])
def test_blocks_reach_every_pair(max_bits, blocks):
    parts = sv.bit_blocks(max_bits, blocks)
    assert sum(m for m, _ in parts) == 2**64 - 1 and sum(r + 1 for _, r in parts) == max_bits + 1


@pytest.mark.parametrize("cell_rows,crowded_rows", [(16, 4096), (4096, 4096), (64, 24)])
def test_trees_lose_no_link(spark, cell_rows, crowded_rows):
    """Crowded and random fingerprints: the links join what a comparison of all pairs joins."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = set(map(int, rng.integers(0, 1 << 63, 500, dtype=np.uint64)))
    for c in map(int, centres):
        for _ in range(12):
            x = c
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    links = sv.near_links(df, len(fps), sample=200, leaf_rows=40, cell_rows=cell_rows, crowded_rows=crowded_rows)
    root = {r.node: r.root for r in components(links).collect()}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    ids = list(range(len(fps)))
    want = _groups(fps, ids, 4)
    by_root = {}
    for i, s in enumerate(signed):
        by_root.setdefault(root.get(s, s), []).append(i)
    got = [0] * len(fps)
    for members in by_root.values():
        for m in members:
            got[m] = min(members)
    assert got == want


@pytest.mark.parametrize("used", [0, (1 << 23) - 1, ((1 << 41) - 1) << 9, 1 << 63])
def test_blocks_of_the_bits_left(used):
    parts = sv.bit_blocks(4, 5, used)
    assert sum(m for m, _ in parts) == (2**64 - 1) ^ used and all(r == 0 for _, r in parts)


def test_a_crowd_of_near_copies_is_not_split():
    rng = np.random.default_rng(8)
    crowd = np.full(3_000, 12345, np.uint64)
    for _ in range(4):
        crowd ^= np.uint64(1) << rng.integers(0, 64, len(crowd), dtype=np.uint64)
    assert sv.leaf_trees(np.unique(crowd), 3_000, 0, 4) == []
    assert len(sv.leaf_trees(rng.integers(0, 1 << 63, 3_000, dtype=np.uint64), 3_000, 0, 4)) == 5


def _work(n, seed=1):
    """Comparisons and rows per fingerprint among ``n`` random ones, from leaves drawn of each tree."""
    rng = np.random.default_rng(seed)
    fps = rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | rng.integers(0, 2, n, dtype=np.uint64)
    drawn = fps[: sv.SAMPLE]
    compared = rows = 0.0
    for i, (mask, reach) in enumerate(sv.bit_blocks(sv.MAX_BITS, sv.BLOCKS)):
        nodes = sv.build_tree(drawn, mask, max(4, int(sv.LEAF_ROWS * len(drawn) / n)), sv.SEED + i)
        some = rng.integers(0, n, 20_000)
        _, leaf, resident = sv.route(fps[some], nodes, mask, reach)
        rows += len(leaf) / len(some)
        index, of, lives = sv.route(fps, nodes, mask, reach)
        for x in rng.choice(np.unique(leaf), 6, replace=False):
            at = of == x
            own, here = fps[index[at]], lives[at]
            weight = len(np.unique(leaf)) / 6 / n
            if len(own) <= sv.CROWDED_ROWS:
                compared += weight * here.sum() * len(own)
                continue
            for sub, m, r in sv.leaf_trees(own[rng.permutation(len(own))[: sv.LEAF_SAMPLE]], len(own), mask, sv.MAX_BITS):
                k, to, res = sv.route(own, sub, m, r, here)
                compared += weight * float(np.bincount(to, res) @ np.bincount(to))
                rows += weight * len(k)
    return compared, rows


def test_work_stays_flat():
    few, many = _work(250_000), _work(1_000_000)
    assert many[0] < 2 * few[0], (few, many)
    assert many[1] < 90, (few, many)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, 1000 + i) for i in range(300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + star + [(5, 5)], "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{1000 + i: 7 for i in range(300)}, 7: 7}


def test_near_dedup_of_empty_and_null_rows(spark):
    assert sv.near_duplicates(_docs(spark, [])).count() == 0
    rows = sv.near_duplicates(_docs(spark, [(None, "a b c d e"), (None, None), (4, "a b c d e")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == [(-1, -1), (-1, 4), (4, 4)]


def test_one_of_each_keeps_columns(spark):
    docs = _docs(spark, [(1, "a b c d e"), (2, "a b c d e"), (3, "quite another text of words")])
    out = sv.one_of_each(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def _brute_dedup(rows):
    import hashlib
    import re

    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out, seen = [], set()
    for (i, _), t in zip(rows, norm):
        same = [j for (j, _), u in zip(rows, norm) if u == t]
        keep = min((j for j in same if j is not None), default=None)
        kept = i == keep and (i, t) not in seen
        seen.add((i, t))
        out.append((i, keep, len(same), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(3, "a  b"), (2, "a b"), (2, "a\tb"), (9, None), (8, ""), (7, " "), (None, "a b"), (None, "only"), (None, "only"), (5, "x" * 300_000), (6, "é")]


def test_exact_dedup_equals_brute_force(spark):
    out = di.dedup_batch(_docs(spark, ROWS), di.new_index(spark, 4)).collect()
    assert sorted((tuple(r) for r in out), key=repr) == _brute_dedup(ROWS)
    assert di.dedup_batch(_docs(spark, []), di.new_index(spark, 4)).count() == 0


def test_groups_below_the_hot_share(spark):
    rows = [(i, f"t{i % 700}") for i in range(4000)] + [(5000 + i, "hot") for i in range(2000)]
    out = di.dedup_batch(_docs(spark, rows), di.new_index(spark, 8))
    assert out.count() == 6000 and out.filter("kept").count() == 701
    assert [tuple(r) for r in out.filter("text_sha256 = sha2('hot', 256)").select("keep_id", "group_size").distinct().collect()] == [(5000, 2000)]


def test_index_lasts_and_repeats(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    first = di.dedup_batch(_docs(spark, [(10, "a"), (11, "b")]), di.DigestIndex(spark, path, 4)).collect()
    again = di.DigestIndex(spark, path, 4)  # opened anew, as a later session would
    second = di.dedup_batch(_docs(spark, [(1, "a"), (2, "c"), (11, "b")]), again)
    assert {(r.doc_id, r.keep_id, r.kept) for r in second.collect()} == {(1, 10, False), (2, 2, True), (11, 11, True)}
    assert sorted(tuple(r) for r in again.read().select("keep_id").collect()) == [(2,), (10,), (11,)]
    assert {r.kept for r in first} == {True}
    plan = again.anti_join(spark.createDataFrame([("d",)], "digest string"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") <= 1


def test_kept_documents(spark):
    docs = _docs(spark, ROWS)
    out = di.kept_documents(docs, di.new_index(spark, 4))
    assert out.columns == docs.columns
    assert sorted((r.doc_id or -1, (r.text or "")[:3]) for r in out.collect()) == [(-1, "onl"), (2, "a b"), (5, "xxx"), (6, "é"), (7, " "), (8, "")] or sorted(
        (r.doc_id or -1, (r.text or "")[:3]) for r in out.collect()
    ) == [(-1, "onl"), (2, "a\tb"), (5, "xxx"), (6, "é"), (7, " "), (8, "")]
    assert out.select(F.count_distinct("doc_id")).first()[0] == 5


def test_many_leaves_are_compared_by_one_task(spark):
    fps = np.random.default_rng(12).integers(0, 1 << 62, 3_000)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    links = sv.near_links(df, len(fps), sample=1_000, leaf_rows=20)
    groups = links._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas [batch" in groups and "FlatMapGroupsInPandas [path" not in groups
    assert links.count() == 0
