"""Method comparison and run selection on tables where methods and splits differ."""

import pytest

from lexiprop.operators import compare as cp
from lexiprop.operators import evaluate as ev
from lexiprop.sources import io as sio

EVAL = "split_id int, word string, y_train int, y_pred int, y_conf double, y_top3_classes array<int>, y_test int"


def _eval(spark, rows):
    return spark.createDataFrame([(s, w, -1, p, c, [-1, -1, -1], t) for s, w, p, c, t in rows], EVAL)


def test_combined_accuracy_counts_all_words_of_the_first_method(spark):
    a = _eval(spark, [(1, "x", 1, 0.9, 1), (1, "y", 2, 0.8, 1), (1, "z", 3, 0.7, 3)])
    b = _eval(spark, [(1, "x", 1, 0.9, 1), (1, "q", 1, 0.9, 1)])
    r = cp.pair_combined_accuracy(cp.stack([a, b], ["a", "b"]), [0, 1]).collect()
    assert [(x.split_id, x.method_a, x.method_b) for x in r] == [(1, 0, 1)]
    assert r[0].equal_predictions == pytest.approx(1 / 3) and r[0].combined_accuracy == pytest.approx(2 / 3)


def test_splits_are_compared_one_by_one(spark):
    rows = [(s, f"w{s}{i}", i % 2, 0.5 + i / 100, 0) for s in (1, 2) for i in range(8)]
    a = _eval(spark, rows)
    stacked = cp.stack([a, a], ["a", "b"])
    # the synsets of an overlap are those of y_train, here -1 alone; give the rows train labels
    stacked = stacked.withColumn("y_train", stacked["y_pred"])
    out = cp.pair_overlap(stacked, [0, 1]).collect()
    assert sorted((r.split_id, r.mean_overlap, r.shared_words) for r in out) == [(1, 1.0, 8), (2, 1.0, 8)]


def test_run_selection_wants_one_match_for_each_string(spark):
    runs = spark.createDataFrame([("r1", "a k=1;", 0.5), ("r2", "a k=2;", 0.6), ("r3", "a k=2;", 0.7)], "run_id string, params string, mean_accuracy double")
    pick = lambda dyn, two=False: [tuple(r) for r in cp.select_runs(runs, ["a"], [], dyn, two).collect()]
    assert pick(["k=1;"]) == [("k=1;", "r1", 0.5)]
    assert sorted(pick(["k=1;", "k=2;"], True)) == [("k=1;", "r1", 0.5), ("k=2;", "r2", 0.6)]
    for dyn in (["k=1;", "k=3;"], ["k=2;"]):
        with pytest.raises(ValueError):
            pick(dyn)


def test_projector_rows_keep_all_components(spark):
    labels = spark.createDataFrame([("a", "both")], "word string, label string")
    vectors = spark.createDataFrame([("a", [float(i) for i in range(450)])], "word string, vector array<double>")
    assert len(cp.projector_rows(labels, vectors).first().vector) == 450


def test_sorted_outputs(spark):
    e = _eval(spark, [(1, "b", 1, 0.5, 1), (1, "a", 1, 0.5, 1), (1, "c", 1, 0.9, 1)])
    assert [r.word for r in ev.sort_evaluation(e).collect()] == ["a", "b", "c"]
    assert [r.word for r in ev.sort_evaluation(e, "confidence").collect()] == ["c", "a", "b"]
    labels = spark.createDataFrame([("x", "training"), ("b", "both"), ("a", "both")], "word string, label string")
    assert [r.word for r in cp.ordered_labels(labels).collect()] == ["a", "b", "x"]


def test_sheets_with_odd_title_rows(spark, tmp_path):
    for i, title in enumerate(["one", "a,b,c,d,e,f"]):
        lines = [title] + ["x"] * 5 + [",,,,word,,score", ",,,,w%d,,2.0" % i, ",,,,,,1", ",,,,v%d,,1,more,fields" % i]
        (tmp_path / f"s{i}.csv").write_text("\n".join(lines))
    out = sio.read_scored_sheet(spark, [str(tmp_path / f"s{i}.csv") for i in range(2)]).collect()
    assert sorted((r.word, r.score) for r in out) == [("v0", 1), ("v1", 1), ("w0", 2), ("w1", 2)]


def test_broken_json_is_an_error(spark, tmp_path):
    (tmp_path / "RW40_1.json").write_text('{"Volltext": "a"}')
    (tmp_path / "RW40_2.json").write_text('{"Volltext": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        sio.read_corpus_json(spark, str(tmp_path)).collect()


def test_braces_inside_a_key_are_no_boundary(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"Class": "synonym", "Concept": 1, "Keys": ["a} {b", "q\\"}"]}\n{"Class": "synonym", "Concept": 2, "Keys": []}')
    out = sio.read_thesaurus_sequence(spark, str(tmp_path)).collect()
    assert sorted((r.concept, r["keys"]) for r in out) == [(1, ["a} {b", 'q"}']), (2, [])]
