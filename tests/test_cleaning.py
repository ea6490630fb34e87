"""Corpus cleaning rules on small strings (T1-T15, precedence of the action list)."""

import pytest

from lexiprop.functions import text as tx
from lexiprop.operators import corpus as co


def _clean(spark, text, actions, doc_id="X9"):
    df = spark.createDataFrame([(doc_id, text)], "doc_id string, text string")
    return co.clean_corpus(df, actions).first()["clean"]


def test_default_actions(spark):
    out = _clean(spark, "Das muß § 5 gut\nsein. Neue-Zeile X9 rest", tx.DEFAULT_CORPUS_ACTIONS)
    # cut at own id, newline fuses words, muß->muss, § -> word, non-German chars -> space, short tokens dropped, lowercase
    assert out == "das muss paragraphsign gutsein neue zeile"


def test_all_sz_only_without_muss(spark):
    acts = (tx.ACTION_SZ_IN_MUSS, tx.ACTION_ALL_SZ, tx.ACTION_SINGLE_LINE)
    assert _clean(spark, "muß Maß", acts) == "muss Maß"
    acts = (tx.ACTION_ALL_SZ, tx.ACTION_SINGLE_LINE)
    assert _clean(spark, "muß Maß", acts) == "muss Mass"


def test_punctuation_keeps_unicode_letters(spark):
    acts = (tx.ACTION_PUNCTUATION, tx.ACTION_SINGLE_LINE)
    assert _clean(spark, "café,naïve_x 42½", acts) == "café naïve x   ½"


def test_hyphen_rules(spark):
    acts = (tx.ACTION_PUNCTUATION_KEEP_HYPHEN, tx.ACTION_SINGLE_LINE)
    assert _clean(spark, "x --abc y - z", acts) == "x -abc y  z"


def test_empty_tokens_survive_without_length_filter(spark):
    acts = (tx.ACTION_NON_GERMAN, tx.ACTION_SINGLE_LINE)
    assert _clean(spark, "a,b", acts) == "a b"
    assert _clean(spark, "a, b", acts) == "a  b"


def test_line_mode_required(spark):
    df = spark.createDataFrame([("1", "x")], "doc_id string, text string")
    with pytest.raises(ValueError):
        co.clean_corpus(df, (tx.ACTION_LOWERCASE,))


def test_doc_id_from_file_name(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("RW40_123.json",)], "f string")
    assert df.select(tx.doc_id_from_file_name(F.col("f"))).first()[0] == "123"


def test_stream_chunks_offsets(spark):
    df = spark.createDataFrame([("a", "x y z"), ("b", "u v")], "doc_id string, clean string")
    rows = co.stream_chunks(df, chunk_tokens=2).orderBy("gpos").collect()
    assert [(r.doc_id, r.pos, r.gpos, r.chunk) for r in rows] == [
        ("a", 0, 0, 0), ("a", 1, 1, 0), ("a", 2, 2, 1), ("b", 0, 3, 1), ("b", 1, 4, 2)
    ]
