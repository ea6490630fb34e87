"""Squeezed rows of pairs, and what stays on disk."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiprop import session as se
from lexiprop.operators import packed as pk
from lexiprop.operators import vocab as vo


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


@pytest.mark.parametrize("x", [[5, 0, 2**40, 7], [1 / 3, 0.0, 2.5, 1.0], [0.1 + 0.2, 1e-300, 2.0, 1.0]])
def test_packed_pairs_come_back_exactly(x):
    words = pa.array(["ä", "", "a\nb", "z"])[1:]
    a, b = np.array([0, 0, 1, 2]), np.array([1, 2, 0, 2])
    for n in (4, 0):
        w, i, j, y = pk.unpack(pk.pack(words, a[:n], b[:n], np.array(x[:n])))
        assert w.equals(words) and i.tolist() == a[:n].tolist() and j.tolist() == b[:n].tolist() and y.tolist() == x[:n]
    assert pk.text_of(*pk.text_arrays(words.slice(0, 0))).to_pylist() == []


def test_no_row_for_each_token_is_shuffled(spark):
    tokens = spark.createDataFrame([(1, i, w) for i, w in enumerate("a b a c".split())], "doc_id long, pos int, token string")
    plan = vo.cooccurrence(tokens, vo.vocabulary(tokens, 1), 2)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(token" not in plan and "array<int>" not in plan
    runs = vo._runs(tokens.coalesce(1), 3, 10).collect()
    assert [(r.doc_id, r.piece, r.pos) for r in runs] == [(1, 0, 0)]
    assert pk.text_of(*pk.unsqueezed(bytes(runs[0].data))).to_pylist() == ["a", "b", "a", "c"]


def test_documents_of_one_id_and_gaps_are_read_by_position(spark, monkeypatch):
    monkeypatch.setattr(vo, "_PART_TOKENS", 7)
    rng = random.Random(8)
    rows = [(d, p, rng.choice("abcdef")) for d in (1, 1, None, 2) for p in range(0, 40, rng.choice((1, 2, 3)))]
    rng.shuffle(rows)
    tokens = spark.createDataFrame(rows, "doc_id long, pos int, token string")
    exp = Counter()
    for d in (1, None, 2):
        line = [t for _, t in sorted((p, t) for e, p, t in rows if e == d)]
        for i in range(len(line)):
            for k in range(1, min(2, len(line) - 1 - i) + 1):
                exp[line[i], line[i + k]] += 1 / k
                exp[line[i + k], line[i]] += 1 / k
    for block in (6, 100):
        got = {(r.w1, r.w2): r.weight for r in vo.cooccurrence(tokens, vo.vocabulary(tokens, 1), 2, block_tokens=block).collect()}
        assert set(got) == set(exp) and all(abs(got[k] - exp[k]) < 1e-9 for k in exp)


def test_written_tables_leave_no_shuffle_files(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").agg(F.count("*").alias("n"))
    before = _shuffle_files(spark)
    first = se.cut_lineage(df)
    kept, _ = se.stored(df, "kept")
    assert _shuffle_files(spark) <= before
    assert first.count() == kept.count() == df.count() == 7
    file = first._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
    at = spark._jvm.org.apache.hadoop.fs.Path(file)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.exists(at)
    se.forget(first)
    assert not fs.exists(at)


@pytest.mark.parametrize("method", ["label_propagation", "label_spreading"])
def test_diffusion_leaves_its_last_state_only(spark, monkeypatch, method):
    from lexiprop.operators import propagate as pr

    written, gone = [], []
    monkeypatch.setattr(pr, "cut_lineage", lambda df: written.append(se.cut_lineage(df)) or written[-1])
    monkeypatch.setattr(pr, "forget", lambda *spent: gone.extend(spent) or se.forget(*spent))
    edges = spark.createDataFrame([(a, b, 1.0) for a in range(6) for b in range(6) if abs(a - b) == 1], "src long, dst long, weight double")
    labels = spark.createDataFrame([(1, w, w if w in (0, 5) else -1) for w in range(6)], "split_id int, word long, y_train int")
    found = []
    for least in (0, 1 << 20):
        monkeypatch.setattr(pr, "STEP_EDGES", least)
        written.clear(), gone.clear()
        rows = pr.propagate(edges, labels, method, iterations=4, checkpoint_every=3).collect()
        found.append(sorted((r.word, r.y_pred, round(r.y_conf, 9)) for r in rows))
        # labels, graph and hubs are written, then every step or the third and the last
        assert len(written) == 3 + (4 if least == 0 else 2) and len(gone) == len(written) - 3
    assert found[0] == found[1] and written[-1].count() > 0


@pytest.mark.parametrize("metric", ["euclidean", "dot"])
def test_block_pairs_in_rounds_find_the_same(spark, monkeypatch, metric):
    from lexiprop.operators import similarity as si

    rng = np.random.default_rng(6)
    rows = [(f"w{i}", rng.integers(0, 4, 3).astype(float).tolist()) for i in range(40)]  # many ties
    left = spark.createDataFrame(rows, "word string, vector array<double>")
    right = spark.createDataFrame(rows[::2], "word string, vector array<double>")
    for other in (left, right):
        found, tables = [], []
        monkeypatch.setattr(si, "stored", lambda df, name: tables.append(name) or se.stored(df, name))
        for cells in (1, 1 << 29):
            monkeypatch.setattr(si, "ROUND_CELLS", cells)
            near = si.similarity_join(left, other, left_id="word", right_id="word", k=3, metric=metric, exclude_same_id=True, block_rows=9)
            found.append(sorted(map(tuple, near.collect())))
        assert len(tables) == 3 and found[0] == found[1] and len(found[0]) == 120


def test_subword_means_by_slices_are_the_same(spark, monkeypatch):
    from lexiprop.operators import embed as em

    rng = np.random.default_rng(2)
    rows = [(a + b, rng.normal(size=7).tolist()) for a in ("haus", "baum") for b in ("tür", "", "werk")]
    vectors = spark.createDataFrame(rows, "word string, vector array<double>")
    counts = spark.createDataFrame([(w, k + 1) for k, (w, _) in enumerate(rows)], "word string, count long")
    found, tables = [], []
    monkeypatch.setattr(em, "stored", lambda df, name: tables.append(name) or se.stored(df, name))
    for cells in (1, 250, 1 << 28):
        monkeypatch.setattr(em, "SLICE_CELLS", cells)
        found.append({r.word: r.vector for r in em.projection_subword(vectors, counts).collect()})
    assert tables.count("means") > 7 and found[0].keys() == {w for w, _ in rows}
    assert all(np.allclose(found[i][w], found[2][w], atol=1e-12) for i in (0, 1) for w, _ in rows)


def test_class_numbers_beyond_32_bits(spark):
    from lexiprop.operators import evaluate as ev
    from lexiprop.plans.expansion import expand_thesaurus

    vectors = spark.createDataFrame([(f"{g}{i}", [float(g == "a"), float(g == "b"), i / 100]) for g in "ab" for i in range(6)], "word string, vector array<double>")
    most = []
    for kind, base in (("long", 3_000_000_000), ("long", 7), ("int", 7)):
        rows = [(f"{g}{i}", base + (g == "b")) for g in "ab" for i in range(6)]
        evaluation, _ = expand_thesaurus(vectors, spark.createDataFrame(rows, f"word string, synset {kind}"))
        assert {r.y_pred for r in evaluation.collect()} == {base, base + 1}
        stats = ev.evaluate(evaluation)
        assert dict(stats.dtypes)["max_group_id"] == ("bigint" if kind == "long" else "int")
        row = stats.first()
        assert row.accuracy == 1.0 and row.mean_within_top3 == 1.0
        most.append(row.max_group_id - base)
    assert most == [0, 0, 0]
