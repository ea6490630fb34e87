"""Readers and writers: round trips on files written by the test (S1-S14), and the corpus stream."""

import json
import os

from pyspark.sql import functions as F

from lexiprop.functions import text as tx
from lexiprop.operators import corpus as co
from lexiprop.sources import io as sio
from lexiprop.streaming.corpus_stream import start_cleaning


def _write_corpus(folder):
    os.makedirs(folder, exist_ok=True)
    docs = {"RW40_1.json": "Ein Text. 1 tail", "RW40_22.json": "Zweiter, muß Text 22 x"}
    for name, text in docs.items():
        with open(os.path.join(folder, name), "w") as fh:
            json.dump({"Volltext": text, "Other": 1}, fh)
    with open(os.path.join(folder, ".DS_Store"), "w") as fh:
        fh.write("junk")


def test_corpus_json_is_written_and_read_by_few_tasks(spark, tmp_path):
    texts = ['"quoted" \\ and\nlines', "", None, "muß", "muß"] + [f"text {i}" for i in range(995)]
    docs = spark.createDataFrame([(t, None) for t in texts], "Volltext string, Other string").repartition(3)
    folders = sio.write_corpus_json(docs, str(tmp_path / "out"))
    files = [f for folder in folders for f in os.listdir(folder)]
    assert len(files) == len(texts) and len(folders) <= 3
    back = sio.read_corpus_json(spark, folders)
    assert sorted(str(r.text) for r in back.collect()) == sorted(map(str, texts))
    assert back.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism  # a few files each before
    none = sio.write_corpus_json(docs.filter("Volltext = 'no such text'"), str(tmp_path / "none"))
    assert sio.read_corpus_json(spark, none).count() == 0


def test_corpus_json_scan(spark, tmp_path):
    folder = str(tmp_path / "corpus")
    _write_corpus(folder)
    df = sio.read_corpus_json(spark, folder)
    got = {r.doc_id: r.text for r in df.collect()}
    assert got == {"1": "Ein Text. 1 tail", "22": "Zweiter, muß Text 22 x"}
    clean = {r.doc_id: r.clean for r in co.clean_corpus(df).collect()}
    assert clean == {"1": "ein text", "22": "zweiter muss text"}


def test_clean_corpus_sinks(spark, tmp_path):
    clean = spark.createDataFrame([("b", "zwei drei"), ("a", "eins")], "doc_id string, clean string")
    single = str(tmp_path / "single")
    sio.write_clean_corpus(clean, single, single_line=True)
    text = "".join(open(os.path.join(single, f)).read() for f in sorted(os.listdir(single)) if f.startswith("part-"))
    assert text == "eins zwei drei "
    multi = str(tmp_path / "multi")
    sio.write_clean_corpus(clean, multi, single_line=False)
    lines = sorted(r.value for r in spark.read.text(multi).collect())
    assert lines == ["eins ", "zwei drei "]


def test_word2vec_text_roundtrip(spark, tmp_path):
    vec = spark.createDataFrame([("a", [0.5, -0.25]), ("b", [1.0, 0.0])], "word string, vector array<double>")
    path = str(tmp_path / "w2v")
    sio.write_word2vec_text(vec, path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert "2 2" in lines
    back = {r.word: list(r.vector) for r in sio.read_word2vec_text(spark, path).collect()}
    assert back == {"a": [0.5, -0.25], "b": [1.0, 0.0]}


def test_thesaurus_json_array_and_sequence(spark, tmp_path):
    concepts = [
        {"Class": "synonym", "Concept": 5, "Keys": ["Auto", "Wagen"], "ExpansionKeys": []},
        {"Class": "antonym", "Concept": 3, "Keys": ["heiß", "kalt"], "ExpansionKeys": []},
    ]
    arr = tmp_path / "thes.json"
    arr.write_text(json.dumps(concepts, indent=2))
    got = [(r.concept, r["class"], list(r["keys"])) for r in sio.read_thesaurus_json(spark, str(arr)).orderBy("pos").collect()]
    assert got == [(5, "synonym", ["Auto", "Wagen"]), (3, "antonym", ["heiß", "kalt"])]
    seq = tmp_path / "seq.json"
    seq.write_text("\n".join(json.dumps(c, indent=2) for c in concepts))
    got2 = [(r.concept, list(r["keys"])) for r in sio.read_thesaurus_sequence(spark, str(seq)).orderBy("pos").collect()]
    assert got2 == [(5, ["Auto", "Wagen"]), (3, ["heiß", "kalt"])]


def test_space_table_roundtrip(spark, tmp_path):
    df = spark.createDataFrame(
        [("wort", 3, 4, 0.25, [4, 3, -1], None), ("haus", -1, -1, 0.0, [-1, -1, -1], 7)],
        "word string, y_train int, y_pred int, y_conf double, y_top3_classes array<int>, y_test int",
    )
    path = str(tmp_path / "table")
    sio.write_space_table(df, path)
    schema = "word string, y_train int, y_pred int, y_conf double, y_top3_classes string, y_test int"
    back = sio.read_space_table(spark, path, schema, ("y_top3_classes",))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_stats_and_run_scan(spark, tmp_path):
    for run in ("r1", "r2"):
        stats = spark.createDataFrame([(0.5 if run == "r1" else 0.25,)], "accuracy double")
        sio.write_stats_json(stats, str(tmp_path / "runs" / run))
    runs = sio.read_run_stats(spark, str(tmp_path / "runs" / "*" / "*.json"))
    got = sorted((r.accuracy, os.path.basename(os.path.dirname(r.run_path))) for r in runs.collect())
    assert got == [(0.25, "r2"), (0.5, "r1")]


def test_scored_sheet(spark, tmp_path):
    rows = ["h" * (i + 1) + ",,,,,," for i in range(7)] + ["1,2,3,4,wort,x,2", ",,,,,,", "1,2,3,4,haus,x,0"]
    p = tmp_path / "sheet.csv"
    p.write_text("\n".join(rows) + "\n")
    got = sorted((r.word, r.score) for r in sio.read_scored_sheet(spark, str(p)).collect())
    assert got == [("haus", 0), ("wort", 2)]


def test_projector_export(spark, tmp_path):
    rows = spark.createDataFrame([("muede", "training", [0.5, 0.25])], "word string, label string, vector array<double>")
    sio.write_projector(rows, str(tmp_path / "vec"), str(tmp_path / "lab"))
    assert [r.value for r in spark.read.text(str(tmp_path / "vec")).collect()] == ["0.5\t0.25"]
    lab = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "lab")).collect()
    assert [(r.word, r.label) for r in lab] == [("muede", "training")]


def test_streaming_cleaning(spark, tmp_path):
    folder = str(tmp_path / "incoming")
    _write_corpus(folder)
    out = str(tmp_path / "clean")
    q = start_cleaning(spark, folder, out, str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    got = {r.doc_id: r.clean for r in spark.read.parquet(out).collect()}
    assert got == {"1": "ein text", "22": "zweiter muss text"}


def test_projector_files_have_the_same_parts(spark, tmp_path):
    confs = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    was = {c: spark.conf.get(c, None) for c in confs}
    try:
        for c, v in confs.items():
            spark.conf.set(c, v)
        vector = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: (F.col("id") * i).cast("double"))
        rows = spark.range(600).select(F.col("id").cast("string").alias("word"), F.lit("both").alias("label"), vector.alias("vector"))
        rows = rows.repartition("word").sortWithinPartitions("word")
        sio.write_projector(rows, str(tmp_path / "vec"), str(tmp_path / "lab"))
    finally:
        for c, v in was.items():
            spark.conf.set(c, v) if v is not None else spark.conf.unset(c)
    parts = lambda name: {p.name[:10]: p.read_text().splitlines() for p in (tmp_path / name).glob("part-*")}
    vectors, labels = parts("vec"), parts("lab")
    assert len(vectors) > 1 and vectors.keys() == labels.keys()
    for part, lines in vectors.items():
        assert [str(int(float(x.split("\t")[0]))) for x in lines] == [x.split("\t")[0] for x in labels[part][1:]]
