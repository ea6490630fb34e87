"""Registered queries for embeddings (trained ones: row checks only) and file round trips.

Round trips write into the session's checkpoint folder (the shared folder on a
cluster) and read the files back; their oracle is the input itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexiprop import fixtures as fx
from lexiprop.functions import text as tx
from lexiprop.operators import corpus as co
from lexiprop.operators import embed as em
from lexiprop.operators import graph as gr
from lexiprop.operators import vocab as vo
from lexiprop.operators.similarity import similarity_join
from lexiprop.plans import oracle as o
from lexiprop.plans.expansion import rounded
from lexiprop.plans.graph_queries import _DEFAULT_GRAPH
from lexiprop.plans.review_queries import EVAL_LP_SQL, eval_lp
from lexiprop.plans.text_queries import COOCCURRENCE_CTES
from lexiprop.session import checkpoint_dir, cut_lineage
from lexiprop.sources import io as sio

QUERIES: dict = {}
ORACLE: dict = {}

MULTI_LINE_ACTIONS = tuple(a for a in tx.DEFAULT_CORPUS_ACTIONS if a != tx.ACTION_SINGLE_LINE) + (tx.ACTION_MULTIPLE_LINES,)


def register(name, sql):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/roundtrip-{name}-{uuid.uuid4().hex}"


def _sentences(spark, sf_dir):
    """Each document's lowercased tokens of two characters or more as a sentence."""
    docs = fx.table(spark, sf_dir, "documents")
    tokens = tx.lowercase_tokens(tx.drop_short_tokens(tx.split_on_space(F.col("text"))))
    return docs.select(F.col("doc_id").alias("sentence_id"), tokens.alias("tokens"))


EMBED_SIZE = 100


def _sign_sql(word: str, i: int) -> str:
    half = f"cast('0x' || substr(md5('1:{i // 120}:' || {word}), {1 + 15 * (i % 120 // 60)}, 15) as bigint)"
    return f"(1 - 2 * (({half} >> {i % 60}) & 1))"


# the projection component by component: pmi-weighted sums of seeded signs, then unit length
PROJECTION_CTES = [
    *COOCCURRENCE_CTES,
    ("cooc", "select w1, w2, sum(weight) as weight from sym group by w1, w2"),
    ("tot", "select w2 as word, sum(weight) as total from cooc group by w2"),
    ("ctx", "select word, total, [" + ", ".join(_sign_sql("word", i) for i in range(EMBED_SIZE)) + "] as signs from tot"),
    ("pmi", "select c.w1, x.signs, ln(c.weight * (select sum(total) from tot) / (a.total * x.total)) as p "
            "from cooc c join tot a on a.word = c.w1 join ctx x on x.word = c.w2"),
    ("sums", "select w1 as word, [" + ", ".join(f"sum(p * signs[{i + 1}])" for i in range(EMBED_SIZE)) + "] as v from pmi where p > 0 group by w1"),
    ("projected", "select word, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as vector from sums"),
]


# rounded; a negative zero is zero in both engines
ROUNDED_SQL = "list_transform(vector, lambda x: case when round(round(x, 12), 6) = 0 then 0.0::double else round(round(x, 12), 6) end) as vector"


def _rounded_vectors(df):
    r = lambda x: F.round(F.round(x, 12), 6)
    return df.select("word", F.transform("vector", lambda x: F.when(r(x) == 0, F.lit(0.0)).otherwise(r(x))).alias("vector"))


@register("embed_projection", o.with_ctes(PROJECTION_CTES, f"select word, {ROUNDED_SQL} from projected"))
def q_embed_projection(spark, sf_dir):
    return _rounded_vectors(em.projection(_sentences(spark, sf_dir), size=EMBED_SIZE, window=5))


@register("embed_word2vec", None)
def q_embed_word2vec(spark, sf_dir):
    """E1 at the reference's size, window and iterations."""
    return em.word2vec(_sentences(spark, sf_dir))


@register("embed_fasttext", None)
def q_embed_fasttext(spark, sf_dir):
    """E2 at the reference's size, window and iterations."""
    return em.fasttext(_sentences(spark, sf_dir))


SUBWORD_CTES = [
    *PROJECTION_CTES,
    ("marked", "select e.word, '<' || e.word || '>' as t, v.count as n from projected e join vocab v using (word)"),
    ("grams", "select distinct m.word, m.n, substr(m.t, i.i, k.k) as gram from marked m, (select unnest([3, 4, 5, 6]) as k) k, "
              "lateral (select unnest(range(1, cast(length(m.t) - k.k + 2 as bigint))) as i) i"),
    ("comps", "select word, unnest(vector) as x, unnest(range(1, len(vector) + 1)) as d from projected"),
    ("gv", "select g.gram, c.d, sum(g.n * c.x) / sum(g.n) as x from grams g join comps c using (word) group by g.gram, c.d"),
    ("via", "select word, d, x from comps union all select g.word, gv.d, gv.x from grams g join gv using (gram)"),
    ("means", "select word, d, avg(x) as x from via group by word, d"),
    ("raw2", "select word, list(x order by d) as v from means group by word"),
    ("subword", "select word, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as vector from raw2"),
]


@register("embed_subword", o.with_ctes(SUBWORD_CTES, f"select word, {ROUNDED_SQL} from subword"))
def q_embed_subword(spark, sf_dir):
    sentences = _sentences(spark, sf_dir)
    counts = vo.vocabulary(sentences.select(F.explode("tokens").alias("token")))
    vectors = cut_lineage(em.projection(sentences, size=EMBED_SIZE, window=5))  # words' and n-grams' means read it
    return _rounded_vectors(em.projection_subword(vectors, counts))


@register("knn_words", None)
def q_knn_words(spark, sf_dir):
    """G1 over all words of the corpus (thousands): the 3 nearest by pivot cells. SQL would compare all pairs; see the tests."""
    vectors = cut_lineage(em.projection(_sentences(spark, sf_dir), size=EMBED_SIZE, window=5))
    near = similarity_join(vectors, vectors, left_id="word", right_id="word", k=3, exclude_same_id=True)
    return near.select("src", "dst", F.round("score", 6).alias("distance"), "rank")


@register("embed_glove", None)
def q_embed_glove(spark, sf_dir):
    """E3 at the reference's size, window and iterations."""
    return em.train_embeddings("glove", _sentences(spark, sf_dir))


@register(
    "embed_text_roundtrip",
    o.with_ctes(
        [("vec_fx", o.VEC_FX), ("nv", o.normalized())],
        f"select word, {ROUNDED_SQL} from nv",
    ),
)
def q_embed_text_roundtrip(spark, sf_dir):
    unit = gr.normalize_vectors(fx.vec_fx(spark, sf_dir).select("word", "vector"))
    path = _scratch(spark, "w2v")
    sio.write_word2vec_text(unit, path)
    back = sio.read_word2vec_text(spark, path)
    return _rounded_vectors(back.select(F.col("word").cast("long").alias("word"), "vector"))


@register(
    "graph_roundtrip",
    o.with_ctes(o.graph_ctes(**_DEFAULT_GRAPH), "select src, dst, round(weight, 6) as weight from edges"),
)
def q_graph_roundtrip(spark, sf_dir):
    vec = fx.vec_fx(spark, sf_dir)
    edges = gr.knn_graph(gr.normalize_vectors(vec.select("word", "vector")), n_neighbors=3)
    path = _scratch(spark, "graph")
    sio.write_graph(edges, vec.select("word"), path)
    back, _nodes = sio.read_graph(spark, path)
    return rounded(back)


@register(
    "space_table_roundtrip",
    o.with_ctes([("ev", EVAL_LP_SQL)], "select word, y_train, y_pred, round(round(y_conf, 12), 6) as y_conf, y_top3_classes, y_test from ev"),
)
def q_space_table_roundtrip(spark, sf_dir):
    e = eval_lp(spark, sf_dir).select("word", "y_train", "y_pred", "y_conf", "y_top3_classes", "y_test")
    path = _scratch(spark, "table")
    sio.write_space_table(e, path)
    schema = "word bigint, y_train int, y_pred int, y_conf double, y_top3_classes string, y_test int"
    back = sio.read_space_table(spark, path, schema, list_columns=("y_top3_classes",))
    return rounded(back)


@register("expansion_end_to_end", None)
def q_expansion_end_to_end(spark, sf_dir):
    """All stages from the raw documents (multiple-lines corpus, word2vec) to the statistics of 3 seeds."""
    from lexiprop.operators import evaluate as ev
    from lexiprop.plans.expansion import CorpusOptions, EmbeddingOptions, SplitOptions, expand_from_corpus

    evaluation, _ = expand_from_corpus(
        fx.corpus_fx(spark, sf_dir),
        fx.concepts_fx(spark, sf_dir),
        CorpusOptions(actions=MULTI_LINE_ACTIONS),
        EmbeddingOptions(method="word2vec"),
        split=SplitOptions(seeds=fx.SEEDS),
    )
    return ev.evaluate(evaluation)
