"""Registered queries for the file formats: each writes given tables in a format, reads them
back through the library's reader, and its oracle is SQL over the input.

Files go to the checkpoint folder, which driver and executors share on a cluster.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiprop import fixtures as fx
from lexiprop.functions import text as tx
from lexiprop.operators import baseline as bl
from lexiprop.operators import compare as cp
from lexiprop.operators import corpus as co
from lexiprop.operators import evaluate as ev
from lexiprop.operators import graph as gr
from lexiprop.plans import oracle as o
from lexiprop.plans.baseline_queries import _BASE_PREDS, _BEST, _base_ctes, _inputs
from lexiprop.plans.expansion import rounded
from lexiprop.plans.graph_queries import STATS_COLS
from lexiprop.plans.io_queries import MULTI_LINE_ACTIONS, _scratch
from lexiprop.plans.review_queries import LABELS, LP, _labels, eval_lp
from lexiprop.plans.text_queries import clean_sql
from lexiprop.sources import io as sio

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, sql):
    def deco(fn):
        QUERIES[name] = fn
        ORACLE[name] = sql
        return fn

    return deco


def _write_one_a_file(lines, path: str) -> None:
    """Each row's ``value`` as a file of its own."""
    lines.select("value").write.option("maxRecordsPerFile", 1).text(path)


@register("doc_id_from_file_name", "select doc_id, cast(doc_id as varchar) as id from documents")
def q_doc_id_from_file_name(spark, sf_dir):
    """T1."""
    name = F.concat(F.lit("RW40_"), F.col("doc_id").cast("string"), F.lit(".json"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", tx.doc_id_from_file_name(name).alias("id"))


@register("corpus_json_roundtrip", "select text from documents")
def q_corpus_json_roundtrip(spark, sf_dir):
    """One JSON file for each document."""
    path = _scratch(spark, "corpus")
    docs = fx.table(spark, sf_dir, "documents").select(F.col("text").alias("Volltext"), F.col("lang").alias("Other"))
    return sio.read_corpus_json(spark, sio.write_corpus_json(docs, path)).select("text")


@register(
    "corpus_lines_roundtrip",
    o.with_ctes([("corpus_fx", o.CORPUS_FX), ("clean", clean_sql(MULTI_LINE_ACTIONS))], "select clean || ' ' as value from clean"),
)
def q_corpus_lines_roundtrip(spark, sf_dir):
    """S3: the cleaned corpus, a line for each document."""
    path = _scratch(spark, "lines")
    sio.write_clean_corpus(co.clean_corpus(fx.corpus_fx(spark, sf_dir), MULTI_LINE_ACTIONS), path, single_line=False)
    return spark.read.text(path)


_CONCEPT_SQL = o.with_ctes([("concepts_fx", o.CONCEPTS_FX)], 'select concept, class, keys from concepts_fx')


def _concept_files(spark, sf_dir, path: str, start: str, between: str, end: str) -> None:
    """The concepts of every 50 documents as one file."""
    one = F.to_json(F.struct(F.col("class").alias("Class"), F.col("concept").alias("Concept"), F.col("keys").alias("Keys")))
    concepts = fx.concepts_fx(spark, sf_dir).select(F.floor(F.col("concept") / 5_000_000).alias("file"), one.alias("json"))
    files = concepts.groupBy("file").agg(F.concat(F.lit(start), F.array_join(F.collect_list("json"), between), F.lit(end)).alias("value"))
    _write_one_a_file(files, path)


@register("thes_json_roundtrip", _CONCEPT_SQL)
def q_thes_json_roundtrip(spark, sf_dir):
    """Files with an array of concepts."""
    path = _scratch(spark, "thesaurus")
    _concept_files(spark, sf_dir, path, "[", ",\n", "]")
    return sio.read_thesaurus_json(spark, path).select("concept", "class", "keys")


@register("thes_sequence_roundtrip", _CONCEPT_SQL)
def q_thes_sequence_roundtrip(spark, sf_dir):
    """Files with one concept after another."""
    path = _scratch(spark, "sequence")
    _concept_files(spark, sf_dir, path, "", "\n", "\n")
    return sio.read_thesaurus_sequence(spark, path).select("concept", "class", "keys")


@register(
    "run_stats_roundtrip",
    o.with_ctes(_base_ctes(fx.SEEDS, 10) + [_BEST, _BASE_PREDS] + o.evaluation_ctes() + o.stats_ctes(), o.STATS_SELECT),
)
def q_run_stats_roundtrip(spark, sf_dir):
    """The statistics of each run in its own file, in the nested layout, scanned together."""
    _, unit, split = _inputs(spark, sf_dir, fx.SEEDS)
    nested = ev.evaluate_nested(bl.baseline_evaluation(unit, split, 10))
    path = _scratch(spark, "runs")
    sio.write_stats_json(nested.repartition(nested.count()), path)
    back = sio.read_run_stats(spark, path, nested.schema)
    names = {"25%": "p25", "50%": "p50", "75%": "p75"}
    flat = back.select("split_id", "accuracy", "conf_stats.*", "mean_within_top3", "pred_synsets_stats.*", "test_stats.*").withColumnsRenamed(names)
    return rounded(flat.select(*STATS_COLS))


@register("scored_sheets_roundtrip", o.with_ctes([("scores_fx", o.SCORES_FX)], "select cast(word as varchar) as word, score from scores_fx"))
def q_scored_sheets_roundtrip(spark, sf_dir):
    """Reviewed sheets with title rows of differing width, read together as two folders."""
    row = F.concat(F.lit(",,,,"), F.col("word").cast("string"), F.lit(",,"), F.col("score").cast("string"), F.lit(".0,a remark"))
    sheets = fx.scores_fx(spark, sf_dir).select(F.floor(F.col("word") / 1000).alias("file"), row.alias("line"))
    sheets = sheets.groupBy("file").agg(F.array_join(F.collect_list("line"), "\n").alias("body"))
    title = "title\na,b\n,,,,,,,,,\n4\n5,x,x,x,x,x\n6\nsynset,,,,word,,score"
    paths = [_scratch(spark, "sheets") for _ in range(2)]
    for i, path in enumerate(paths):
        part = sheets.filter(F.pmod("file", F.lit(2)) == i)
        _write_one_a_file(part.select(F.concat(F.lit(title + "\n"), "body").alias("value")), path)
    return sio.read_scored_sheet(spark, paths)


@register(
    "projector_files",
    o.with_ctes(
        LABELS + [("nv", o.normalized("(" + o.VEC_FX + ")"))],
        "select cast(l.word as varchar) as word, l.label, len(n.vector) as n_columns, round(round(list_sum(n.vector), 9), 6) as total "
        "from labels l join nv n on n.word = l.word",
    ),
)
def q_projector_files(spark, sf_dir):
    """The two files of the embedding projector, line by line side by side."""
    unit = gr.normalize_vectors(fx.vec_fx(spark, sf_dir).select("word", "vector"))
    rows = cp.projector_rows(_labels(spark, sf_dir), unit).repartition("word").sortWithinPartitions("word")
    vectors, labels = _scratch(spark, "projector-vectors"), _scratch(spark, "projector-labels")
    sio.write_projector(rows, vectors, labels)
    # a line's partner has the same place in the part file of the same number
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1)
    v = spark.read.text(vectors, wholetext=True).select(part.alias("part"), F.posexplode(F.split(F.rtrim("value"), "\n")).alias("at", "line"))
    whole = spark.read.text(labels, wholetext=True).select(part.alias("part"), F.split(F.rtrim("value"), "\n").alias("lines"))
    lab = whole.select("part", F.posexplode(F.slice("lines", 2, F.size("lines"))).alias("at", "named"))
    numbers = F.transform(F.split("line", "\t"), lambda x: x.cast("double"))
    pairs = lab.filter("named != ''").join(v, ["part", "at"]).select(F.split("named", "\t").alias("named"), numbers.alias("vector"))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return pairs.select(
        F.col("named")[0].alias("word"), F.col("named")[1].alias("label"), F.size("vector").cast("long").alias("n_columns"),
        F.round(F.round(total, 9), 6).alias("total"),
    )


@register(
    "glove_text_roundtrip",
    o.with_ctes([("vec_fx", o.VEC_FX), ("nv", o.normalized())], "select cast(word as varchar) as word, list_transform(vector, lambda x: round(x, 6)) as vector from nv"),
)
def q_glove_text_roundtrip(spark, sf_dir):
    """Vectors as text without a header line."""
    unit = gr.normalize_vectors(fx.vec_fx(spark, sf_dir).select("word", "vector"))
    path = _scratch(spark, "glove")
    numbers = F.array_join(F.transform("vector", lambda x: x.cast("string")), " ")
    unit.select(F.concat_ws(" ", F.col("word").cast("string"), numbers).alias("value")).write.text(path)
    back = sio.read_word2vec_text(spark, path, header=False)
    return back.select("word", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@register(
    "baseline_reached",
    o.with_ctes(
        _base_ctes((1,), 10) + [_BEST, _BASE_PREDS] + o.evaluation_ctes(),
        "select split_id, word, y_pred, round(round(y_conf, 12), 6) as y_conf from evaluation where y_conf <> -100",
    ),
)
def q_baseline_reached(spark, sf_dir):
    """F9."""
    _, unit, split = _inputs(spark, sf_dir, (1,))
    return rounded(bl.reached(bl.baseline_evaluation(unit, split, 10)).select("split_id", "word", "y_pred", "y_conf"))


@register(
    "evaluation_sorted",
    o.with_ctes(LP, "select split_id, word, round(round(y_conf, 12), 6) as y_conf from ev order by round(y_conf, 9) desc, word"),
)
def q_evaluation_sorted(spark, sf_dir):
    """R3."""
    return rounded(ev.sort_evaluation(eval_lp(spark, sf_dir), "confidence").select("split_id", "word", "y_conf"))


@register("labels_sorted", o.with_ctes(LABELS, "select word, label from labels order by label, word"))
def q_labels_sorted(spark, sf_dir):
    """V2."""
    return cp.ordered_labels(_labels(spark, sf_dir))
