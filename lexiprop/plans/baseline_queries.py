"""Registered queries for the synset-vector baseline, its sweep and the bipartite graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiprop import fixtures as fx
from lexiprop.operators import baseline as bl
from lexiprop.operators import evaluate as ev
from lexiprop.operators import graph as gr
from lexiprop.operators import splits as sp
from lexiprop.plans import oracle as o
from lexiprop.plans.expansion import rounded
from lexiprop.session import cut_lineage
from lexiprop.plans.graph_queries import STATS_COLS

QUERIES: dict = {}
ORACLE: dict = {}

_THES_SQL = "(select word, synset from vec_fx)"


def register(name, sql):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def _inputs(spark, sf_dir, seeds):
    vec = fx.vec_fx(spark, sf_dir)
    unit = gr.normalize_vectors(vec.select("word", "vector"))
    # the split is read by several branches (synset vectors, exclusions, tests): written once
    split = cut_lineage(sp.split_thesaurus(vec.select("word", "synset"), seeds=seeds))
    return vec, unit, split


def _base_ctes(seeds, k):
    return (
        [("vec_fx", o.VEC_FX), ("nv", o.normalized("vec_fx"))]
        + o.split_ctes(_THES_SQL, seeds=seeds)
        + o.synset_vector_ctes(k)
    )


@register(
    "synset_vectors",
    o.with_ctes(_base_ctes((1,), 10), "select split_id, synset, list_transform(vector, lambda x: round(x, 6)) as vector from sv"),
)
def q_synset_vectors(spark, sf_dir):
    _, unit, split = _inputs(spark, sf_dir, (1,))
    sv = bl.synset_vectors(unit, split)
    return sv.select("split_id", "synset", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@register(
    "synset_topk",
    o.with_ctes(_base_ctes((1,), 10), "select split_id, synset, word, round(similarity, 6) as similarity, rank from topk"),
)
def q_synset_topk(spark, sf_dir):
    _, unit, split = _inputs(spark, sf_dir, (1,))
    return rounded(bl.synset_topk(unit, split, 10).withColumn("rank", F.col("rank").cast("long")))


_BEST = (
    "best",
    "select split_id, word, cast(first(synset order by round(similarity, 9) desc, synset) as int) as y_pred, "
    "first(similarity order by round(similarity, 9) desc, synset) as y_conf from topk group by split_id, word",
)
_BASE_PREDS = (
    "preds",
    "select s.split_id, n.word, cast(coalesce(b.y_pred, -1) as int) as y_pred, coalesce(b.y_conf, -100.0) as y_conf, "
    "[-1, -1, -1]::int[] as y_top3_classes from vec_fx n cross join seed_ids s "
    "left join best b on b.split_id = s.split_id and b.word = n.word",
)


@register(
    "baseline_predictions",
    o.with_ctes(
        _base_ctes((1,), 10) + [_BEST, _BASE_PREDS] + o.evaluation_ctes(),
        "select split_id, word, y_train, y_pred, round(round(y_conf, 12), 6) as y_conf, y_top3_classes, y_test from evaluation",
    ),
)
def q_baseline_predictions(spark, sf_dir):
    _, unit, split = _inputs(spark, sf_dir, (1,))
    e = bl.baseline_evaluation(unit, split, 10)
    return rounded(e.select("split_id", "word", "y_train", "y_pred", "y_conf", "y_top3_classes", "y_test"))


@register(
    "baseline_stats",
    o.with_ctes(
        _base_ctes(fx.SEEDS, 10) + [_BEST, _BASE_PREDS] + o.evaluation_ctes() + o.stats_ctes(),
        o.STATS_SELECT,
    ),
)
def q_baseline_stats(spark, sf_dir):
    _, unit, split = _inputs(spark, sf_dir, fx.SEEDS)
    return rounded(ev.evaluate(bl.baseline_evaluation(unit, split, 10)).select(*STATS_COLS))


_KS = "select unnest([" + ", ".join(str(k) for k in bl.SWEEP_KS) + "]) as k"


@register(
    "baseline_k_sweep",
    o.with_ctes(
        _base_ctes(fx.SEEDS, max(bl.SWEEP_KS))
        + [
            ("ks", _KS),
            ("perk", "select t.*, ks.k from topk t join ks on t.rank <= ks.k"),
            ("bestk", "select split_id, k, word, first(synset order by round(similarity, 9) desc, synset) as y_pred "
                      "from perk group by split_id, k, word"),
            ("acc", "select t.split_id, ks.k, avg(case when b.y_pred = t.synset then 1.0 else 0.0 end) as accuracy "
                    "from test t join ks on true left join bestk b on b.split_id = t.split_id and b.k = ks.k and b.word = t.word "
                    "where t.word in (select word from vec_fx) group by t.split_id, ks.k"),
        ],
        "select k, round(avg(accuracy), 6) as mean_accuracy, list(round(accuracy, 6) order by split_id) as accuracies from acc group by k",
    ),
)
def q_baseline_k_sweep(spark, sf_dir):
    _, unit, split = _inputs(spark, sf_dir, fx.SEEDS)
    sw = bl.k_sweep(unit, split)
    return sw.select(
        "k", F.round("mean_accuracy", 6).alias("mean_accuracy"), F.transform("accuracies", lambda x: F.round(x, 6)).alias("accuracies")
    )


@register(
    "baseline_top3_stats",
    o.with_ctes(
        _base_ctes(fx.SEEDS, 200)
        + [
            ("rk", "select *, row_number() over (partition by split_id, word order by round(similarity, 9) desc, synset) as r from topk"),
            ("lists", "select split_id, word, list(synset order by r) as top3 from rk where r <= 3 group by split_id, word"),
            ("j", "select t.split_id, t.synset as y_test, l.top3 from test t left join lists l on l.split_id = t.split_id and l.word = t.word"),
        ],
        "select split_id, round(avg(case when top3 is not null and list_contains(top3, y_test) then 1.0 else 0.0 end), 6) as within_top3_mean, "
        "round(avg(case when top3 is not null and top3[1] = y_test then 1.0 else 0.0 end), 6) as top1_mean, "
        "count(case when top3 is null then 1 end) as no_predictions from j group by split_id",
    ),
)
def q_baseline_top3_stats(spark, sf_dir):
    _, unit, split = _inputs(spark, sf_dir, fx.SEEDS)
    return rounded(bl.top3_report(unit, split, 200))


_BIP_EDGES = (
    "edges",
    "select split_id, 'synset_' || cast(synset as varchar) as src, cast(word as varchar) as dst, similarity as weight from topk "
    "union all select split_id, cast(word as varchar) as src, 'synset_' || cast(synset as varchar) as dst, similarity as weight from topk",
)


@register(
    "bipartite_edges",
    o.with_ctes(_base_ctes((1,), 200) + [_BIP_EDGES], "select split_id, src, dst, round(weight, 6) as weight from edges"),
)
def q_bipartite_edges(spark, sf_dir):
    _, unit, split = _inputs(spark, sf_dir, (1,))
    return rounded(bl.bipartite_edges(bl.synset_topk(unit, split, 200)))


def _bipartite_sql(final: str) -> str:
    ctes = _base_ctes(fx.SEEDS, 200) + [
        _BIP_EDGES,
        ("labels", "select t.split_id, 'synset_' || cast(t.synset as varchar) as word, cast(t.synset as int) as y_train "
                   "from (select distinct split_id, synset from train) t "
                   "union all select s.split_id, cast(n.word as varchar) as word, -1 as y_train from vec_fx n cross join seed_ids s"),
        ("seeds", "select split_id, word, y_train as synset, 1.0::double as score from labels where y_train <> -1"),
    ]
    ctes += o.ls_split_ctes(15, 0.2)
    ctes += o.finalize_ctes("st15")
    ctes = [(n, s) if n != "preds" else ("preds_all", s) for n, s in ctes]
    ctes.append(
        ("preds", "select split_id, cast(word as bigint) as word, y_pred, y_conf, y_top3_classes from preds_all "
                  "where word not like 'synset_%'")
    )
    ctes += o.evaluation_ctes() + o.stats_ctes()
    return o.with_ctes(ctes, final)


@register("bipartite_ls_stats", _bipartite_sql(o.STATS_SELECT))
def q_bipartite_ls_stats(spark, sf_dir):
    _, unit, split = _inputs(spark, sf_dir, fx.SEEDS)
    return rounded(ev.evaluate(bl.bipartite_spreading(unit, split)).select(*STATS_COLS))
