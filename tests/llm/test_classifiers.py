import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

from lexiprop.llm import char_model as cm
from lexiprop.llm import rule_ensemble as re_
from lexiprop.llm import toxicity_channel as tc
from lexiprop.llm.common import documents, labels
from lexiprop.llm.lasso import fit_lasso

SF = SF_SMALL.replace("0.001", "0.01")
DOCS = "doc_id long, text string, score string, label string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)


def test_counts_equal_brute_force():
    texts = ["ab c", None, "", "É x", "abab" * 10]
    want = np.zeros(28**4, int)
    for t in texts:
        s = [0] * 3 + [27 if b > 127 else (b | 32) - 96 if chr(b).isalpha() else 0 for b in (t or "").encode()] + [0] * 3
        for a, b, c, d in zip(s, s[1:], s[2:], s[3:]):
            want[((a * 28 + b) * 28 + c) * 28 + d] += 1
    assert (cm.count_ngrams(texts) == want).all()


def test_long_texts_are_counted_whole(monkeypatch):
    text = "".join(random.Random(1).choice("abc d") for _ in range(1000))
    whole = cm.count_ngrams([text])
    monkeypatch.setattr(cm, "_BYTES_AT_ONCE", 64)
    assert (cm.count_ngrams([text]) == whole).all()


def test_viterbi_equals_trying_everything():
    model = cm.log_model(cm.count_ngrams(["the idiot told a tale to the loser at last"] * 20))
    for word in ("1d10t", "l05er", "t4l3", "a77", "!d!ot"):
        runs = [(c, len(list(g))) for c, g in itertools.groupby(word)]
        best = None
        for picks in itertools.product(*[cm.options(c, n) for c, n in runs]):
            text, cost = "".join(p[0] for p in picks), sum(p[1] for p in picks)
            at = 0
            for c in text:
                cost += model[at, cm._symbol(c)]
                at = at % 784 * 28 + cm._symbol(c)
            cost += model[at, 0]
            best = min(best, (cost, text)) if best else (cost, text)
        assert cm.decode(word, model) == best[1]


def test_reader_restores_and_leaves_clean_words():
    words = "pathetic moron idiot loser scum worthless the of and in thing nation".split()
    model = cm.log_model(cm.count_ngrams([" ".join(words)] * 50))
    r = tc.Reader(model)
    assert {"idiot", "loser", "moron", "scum", "worthless", "wort~", "worth~", "worthl~"} <= r.words("1d10t l.o.s.e.r m o r o n, $cum w0rthle55!")
    assert r.words("The nation,\nof thing*** and 12 é") == {"the", "nation", "nati~", "natio~", "of", "thing", "thin~", "and", "é"}
    assert r.words(None) == r.words("") == set()
    assert "idiot" in r.words("x " * 3000 + "the i d i o t " + "y" * 10**6)


def test_reader_restores_closing_signs_long_repeats_and_letters_of_other_alphabets():
    words = "pathetic moron idiot loser scum worthless skull the of and in thing nation great".split()
    r = tc.Reader(cm.log_model(cm.count_ngrams([" ".join(words)] * 50)))
    for written in ("idio+", "IDIO+,", "1di0+", "(1di0t)", "i" * 30 + "d" * 30 + "iot", "1d10" + "t" * 50, "id\u0456\u043et", "ídiöt", "iddiot", "¡d1ot!", "idiot!", "idio+!"):
        assert "idiot" in r.words(written), written
    assert "skull" in r.words("skul|") and "loser" in r.words("£oser") and "scum" in r.words("the $cum!")
    assert "idio~" in r.words("1d10t" + "/ab1" * 30)
    assert "idiot" in r.words("i d i o t!") and "idiot" in r.words("i d i o +")
    assert r.words("great! 2024 (12) $100 +49") == {"great", "grea~"}  # plain punctuation and numbers


def test_reader_restores_words_joined_by_signs():
    words = "hello there my friend and all of the others you so word idiot loser scum well known".split()
    r = tc.Reader(cm.log_model(cm.count_ngrams([" ".join(words)] * 50)))
    joined = ("so-1d10t", "word,1d10t", "hello/1d10t", "word,1d!ot", "1d10t,word", "hello_there_my_friend_and_all_of_the_others_you_1d10t")
    for written in joined + ("1d10t_" + "hello_there_my_friend_" * 20, "hello_there_my_friend_" * 20 + "1d10t", "well/" * 30 + "(1d10t)"):
        assert "idiot" in r.words(written), written
    for written in ("well-known", "hello_there", "so,word", "and/all"):
        assert r.words(written) <= {*tc.marks_of(["well", "known", "wellknown", "hello", "there", "hellothere", "so", "word", "soword", "and", "all", "andall"])}, written


def test_windows_cover_every_word():
    core = "_".join(f"{chr(97 + i % 26)}{i}xyz" for i in range(200))
    parts = list(tc.windows(core))
    assert all(any(w in p.split("_") for p in parts) for w in core.split("_"))
    assert all(len(tc._RUN.findall(p)) <= tc.LONGEST_WORD for p in parts) and list(tc.windows("short-one")) == ["short-one"]


def test_words_left_undecoded_hold_no_mark():
    rng = random.Random(3)
    model = cm.log_model(cm.count_ngrams(["idiot loser scum ass of the and"] * 50))
    marks = {m: i for i, m in enumerate(["idiot", "idio~", "lose~", "loser", "scum", "ass"])}
    whole, sparing = tc.Reader(model), tc.Reader(model, marks)
    for _ in range(3000):
        word = "".join(rng.choice("1iídо0ot+lsécu$m5@ea!,*") for _ in range(rng.randrange(1, 7))) + rng.choice(["", "iot", "ser", "cum"])
        assert {marks[m] for m in whole.words(word) if m in marks} == sparing.words(word), word


def test_lasso_drops_what_does_not_matter():
    rng = np.random.default_rng(0)
    x = (rng.random((3000, 12)) < 0.3).astype(float)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(3 * x[:, 0] - 3 * x[:, 1])))).astype(float)
    w, b = fit_lasso(x, y, 0.02)
    assert w[0] > 1 and w[1] < -1 and (np.abs(w[2:]) < 0.2).all() and (w[2:] == 0).sum() >= 6
    p = 1 / (1 + np.exp(-(x @ w + b)))
    grad = x.T @ (p - y) / 3000
    assert (np.abs(grad) <= 0.02 + 1e-4).all()  # optimality of the L1 problem


@pytest.fixture(scope="module")
def model(spark):
    return tc.fit(documents(spark, SF), labels(spark, SF))


def _accuracy(scored, known, target):
    rows = scored.join(known.select("doc_id", F.col(target).alias("label")), "doc_id").filter("held_out")
    n, right = rows.agg(F.count(F.lit(1)), F.sum((F.col("predicted") == F.col("label")).cast("int"))).first()
    return n, right / n


def test_toxicity_on_the_held_out_fold(spark, model):
    scored = tc.score_documents(documents(spark, SF), model)
    n, accuracy = _accuracy(scored, labels(spark, SF), "toxic")
    assert n > 60 and accuracy >= 0.93  # some labels of this small table are noise
    for r in scored.select("doc_id", "held_out", "score").collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1


def test_toxicity_of_obfuscated_and_odd_rows(spark, model):
    rows = [(1, "of the thing 1d10t and the nation"), (2, "such a l o s e r, that"), (3, "and cl0wwwn in the"), (4, "of the nation and thing")]
    rows += [(5, None), (6, ""), (None, "idiot"), (7, "idiot"), (7, "idiot"), (8, "z" * 2_000_000 + " idiot")]
    out = tc.score_documents(_docs(spark, rows), model).collect()
    got = sorted((r.doc_id or 0, r.predicted) for r in out)
    assert got == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 0), (5, 0), (6, 0), (7, 1), (7, 1), (8, 1)]
    assert tc.score_documents(_docs(spark, []), model).count() == 0
    docs = _docs(spark, rows)
    kept = tc.accepted(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 6]


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    m = tc.fit(_docs(spark, [(1, "a")]), none)
    assert [r.score for r in tc.score_documents(_docs(spark, [(1, "a")]), m).collect()] == [0.5]


def test_held_out_labels_are_not_learned(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text "), F.when(F.col("id") % 2 == 0, "vile").otherwise("fine")).alias("text"))
    known = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic"))
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    flipped = known.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = tc.fit(docs, known), tc.fit(docs, flipped)
    assert a.marks == b.marks and "vile" in a.marks and np.allclose(a.weights, b.weights) and a.bias == b.bias


def test_quality_on_the_held_out_fold(spark):
    scored = re_.score_documents(documents(spark, SF), labels(spark, SF))
    n, accuracy = _accuracy(scored, labels(spark, SF), "quality")
    assert n > 90 and accuracy >= 0.9
    assert scored.filter("score < 0 or score > 1 or score is null").count() == 0
    for r in scored.select("doc_id", "held_out").collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_tree_paths_become_rules():
    text = """DecisionTreeRegressionModel: uid=x, depth=2, numNodes=5, numFeatures=14
  If (feature 8 <= 0.25)
   If (feature 0 <= 3.5)
    Predict: 0.1
   Else (feature 0 > 3.5)
    Predict: 0.2
  Else (feature 8 > 0.25)
   Predict: -1.0
"""
    got = {r.bounds for r in re_.tree_rules(text)}
    assert got == {
        (("signs", False, 0.25),),
        (("signs", False, 0.25), ("words", False, 3.5)),
        (("signs", False, 0.25), ("words", True, 3.5)),
        (("signs", True, 0.25),),
    }


def test_compiled_rules_equal_brute_force(spark):
    rules = (re_.Rule((("signs", True, 0.1),)), re_.Rule((("words", False, 3.0), ("upper", True, 0.2))))
    model = re_.RuleEnsemble(rules, (1.5, -2.0), 0.25)
    texts = [None, "", "AB cd", "## $$ %%", "a b c d e", "A"]
    stats = re_.with_statistics(_docs(spark, list(enumerate(texts))))
    got = {r.doc_id: r.s for r in stats.select("doc_id", model.score().alias("s")).collect()}
    for i, t in enumerate(texts):
        v = dict(zip(re_.STATISTICS, re_.statistics(t, re_._kind_of_byte())))
        z = 0.25 + 1.5 * (v["signs"] > 0.1) - 2.0 * (v["words"] <= 3 and v["upper"] > 0.2)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)))


def test_quality_of_odd_rows(spark):
    known = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    rows = [(i, "plain words in a line" if i % 2 else "## $$ %% && ##") for i in range(60)]
    rows += [(None, "plain words"), (100, None), (101, ""), (3, "plain words in a line"), (102, "q" * 3_000_000)]
    out = re_.score_documents(_docs(spark, rows), known).collect()
    assert len(out) == len(rows) and all(r.predicted == r.doc_id % 2 for r in out if r.doc_id is not None and r.doc_id < 60)
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in re_.score_documents(_docs(spark, rows[:5]), empty).collect()} == {0.5}
    assert re_.score_documents(_docs(spark, []), known).count() == 0
