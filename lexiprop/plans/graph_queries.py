"""Registered queries for vectors, graphs, splits, diffusion and evaluation.

Every query has a Spark function ``(spark, sf_dir) -> DataFrame`` and a DuckDB
oracle string with the same column names; doubles are rounded to 6 decimals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiprop import fixtures as fx
from lexiprop.operators import evaluate as ev
from lexiprop.operators import graph as gr
from lexiprop.operators import propagate as pr
from lexiprop.operators import splits as sp
from lexiprop.plans import oracle as o
from lexiprop.plans.expansion import DiffusionOptions, GraphOptions, SplitOptions, expand_thesaurus, rounded

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def _vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.vec_fx(spark, sf_dir)


def _thes(vec: DataFrame) -> DataFrame:
    return vec.select("word", "synset")


# --- vectors and graphs ----------------------------------------------------

@register(
    "vec_normalize",
    o.with_ctes(
        [("vec_fx", o.VEC_FX), ("nv", o.normalized())],
        "select word, list_transform(vector, lambda x: round(x, 6)) as vector from nv",
    ),
)
def q_vec_normalize(spark, sf_dir):
    nv = gr.normalize_vectors(_vec(spark, sf_dir).select("word", "vector"))
    return nv.select("word", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


def _graph_sql(**kw) -> str:
    return o.with_ctes(o.graph_ctes(**kw), "select src, dst, round(weight, 6) as weight from edges")


def _graph_query(**kw):
    def q(spark, sf_dir):
        edges = gr.build_graph(gr.normalize_vectors(_vec(spark, sf_dir).select("word", "vector")), **kw)
        return rounded(edges.select("src", "dst", "weight"))

    return q


_GRAPHS = {
    "knn_connectivity": dict(variant="knn", k=3, mode="connectivity", force_symmetric=False),
    "knn_distance": dict(variant="knn", k=10, mode="distance", force_symmetric=False),
    "knn_include_self": dict(variant="knn", k=3, mode="distance", include_self=True, force_symmetric=False),
    "radius_connectivity": dict(variant="radius", radius=1.15, mode="connectivity", force_symmetric=False),
    "radius_distance": dict(variant="radius", radius=1.15, mode="distance", force_symmetric=True),
    "knn_symmetric": dict(variant="knn", k=12, mode="distance", force_symmetric=True),
}
for _name, _kw in _GRAPHS.items():
    _spark_kw = dict(_kw)
    _spark_kw["n_neighbors"] = _spark_kw.pop("k", 3)
    register(_name, _graph_sql(**_kw))(_graph_query(**_spark_kw))


# --- graph normalisation and seeds ----------------------------------------

_DEFAULT_GRAPH = dict(variant="knn", k=3, mode="connectivity", force_symmetric=True)


def _default_edges(spark, sf_dir):
    return gr.knn_graph(gr.normalize_vectors(_vec(spark, sf_dir).select("word", "vector")), n_neighbors=3)


@register("graph_degree", o.with_ctes(o.graph_ctes(**_DEFAULT_GRAPH), "select src, round(sum(weight), 6) as degree from edges group by src"))
def q_graph_degree(spark, sf_dir):
    return rounded(gr.degrees(_default_edges(spark, sf_dir)))


@register(
    "graph_transition",
    o.with_ctes(
        o.graph_ctes(**_DEFAULT_GRAPH) + [("deg", "select src, sum(weight) as d from edges group by src")],
        "select e.src, e.dst, round(e.weight / deg.d, 6) as p from edges e join deg using (src)",
    ),
)
def q_graph_transition(spark, sf_dir):
    return rounded(gr.transition(_default_edges(spark, sf_dir)))


_SYM_GRAPH = dict(variant="knn", k=12, mode="distance", force_symmetric=True)


@register(
    "graph_sym_norm",
    o.with_ctes(
        o.graph_ctes(**_SYM_GRAPH) + o.ls_ctes(0, 0.2)[:2],
        "select src, dst, round(s, 6) as s from smat",
    ),
)
def q_graph_sym_norm(spark, sf_dir):
    vec = gr.normalize_vectors(_vec(spark, sf_dir).select("word", "vector"))
    return rounded(gr.symmetric_normalized(gr.knn_graph(vec, n_neighbors=12, mode="distance")))


_THES_SQL = "(select word, synset from vec_fx)"


@register(
    "graph_seeds",
    o.with_ctes(
        [("vec_fx", o.VEC_FX)] + o.split_ctes(_THES_SQL, seeds=(1,)) + o.labels_ctes(),
        "select split_id, word, y_train from labels",
    ),
)
def q_graph_seeds(spark, sf_dir):
    vec = _vec(spark, sf_dir)
    parts = sp.split_thesaurus(_thes(vec), seeds=(1,))
    return pr.seed_labels(vec.select("word"), sp.train_part(parts), (1,))


# --- splits ----------------------------------------------------------------

def _split_sql(**kw) -> str:
    return o.with_ctes([("vec_fx", o.VEC_FX)] + o.split_ctes(_THES_SQL, **kw), "select split_id, word, synset, part from split")


def _split_query(**kw):
    def q(spark, sf_dir):
        return sp.split_thesaurus(_thes(_vec(spark, sf_dir)), **kw)

    return q


for _name, _kw in {
    "split_frac": dict(variant="sample_each_concept_frac", frac=0.5, seeds=(1,)),
    "split_n_test": dict(variant="sample_each_concept_n", n_test=3, seeds=(2,)),
    "split_all": dict(variant="all_as_training", seeds=(1,)),
    "split_multi_seed": dict(variant="sample_each_concept_frac", frac=0.3, seeds=fx.SEEDS),
}.items():
    register(_name, _split_sql(**_kw))(_split_query(**_kw))


# --- diffusion -------------------------------------------------------------

def _diffusion_sql(method, iterations, alpha, graph, seeds, final):
    ctes = o.graph_ctes(**graph) + o.split_ctes(_THES_SQL, seeds=seeds) + o.labels_ctes()
    if method == "label_propagation":
        ctes += o.lp_ctes(iterations)
    else:
        ctes += o.ls_ctes(iterations, alpha)
    ctes += o.finalize_ctes(f"st{iterations}") + o.evaluation_ctes() + o.stats_ctes()
    return o.with_ctes(ctes, final)


def _evaluation(spark, sf_dir, method, iterations, alpha, graph, seeds):
    gopts = GraphOptions(
        variant=graph.get("variant", "knn"),
        n_neighbors=graph.get("k", 3),
        radius=graph.get("radius", 0.1),
        mode=graph.get("mode", "connectivity"),
        include_self=graph.get("include_self", False),
        force_symmetric=graph.get("force_symmetric", True),
    )
    vec = _vec(spark, sf_dir)
    evaluation, _ = expand_thesaurus(
        vec.select("word", "vector"),
        _thes(vec),
        gopts,
        SplitOptions(seeds=seeds),
        DiffusionOptions(method=method, iterations=iterations, alpha=alpha),
    )
    return evaluation


PRED_COLS = "split_id, word, y_pred, round(round(y_conf, 12), 6) as y_conf"
TOP3_COLS = "split_id, word, y_top3_classes"

_LP = dict(method="label_propagation", iterations=3, alpha=0.2, graph=_DEFAULT_GRAPH, seeds=(1,))
_LS = dict(method="label_spreading", iterations=15, alpha=0.2, graph=_SYM_GRAPH, seeds=(1,))


def _register_diffusion(name, params, final_sql, spark_select):
    def q(spark, sf_dir):
        return spark_select(_evaluation(spark, sf_dir, **params))

    register(name, _diffusion_sql(final=final_sql, **params))(q)


def _pred_select(e):
    return rounded(e.select("split_id", "word", "y_pred", "y_conf"))


def _top3_select(e):
    return e.select("split_id", "word", "y_top3_classes")


_register_diffusion("lp_predictions", _LP, f"select {PRED_COLS} from evaluation", _pred_select)
_register_diffusion("lp_top3", _LP, f"select {TOP3_COLS} from evaluation", _top3_select)
_register_diffusion("ls_predictions", _LS, f"select {PRED_COLS} from evaluation", _pred_select)
_register_diffusion("ls_top3", _LS, f"select {TOP3_COLS} from evaluation", _top3_select)

EVAL_COLS_SQL = "split_id, word, y_train, y_pred, round(round(y_conf, 12), 6) as y_conf, y_top3_classes, y_test"


def _eval_select(e):
    return rounded(e.select("split_id", "word", "y_train", "y_pred", "y_conf", "y_top3_classes", "y_test"))


STATS_COLS = [
    "split_id", "accuracy", "mean_conf_true", "mean_conf_false", "mean_within_top3", "count_all_words",
    "count_train_set", "count_test_set", "count_correctly_predicted", "count", "mean", "std", "min", "p25",
    "p50", "p75", "max", "sum_preds", "max_group_id",
]


def _stats_select(e):
    return rounded(ev.evaluate(e).select(*STATS_COLS))


_LP3 = dict(_LP, seeds=fx.SEEDS)
_register_diffusion("eval_table", _LP, f"select {EVAL_COLS_SQL} from evaluation", _eval_select)
_register_diffusion("eval_stats", _LP, o.STATS_SELECT, _stats_select)
_register_diffusion(
    "eval_group_sizes",
    _LP,
    "select split_id, y_pred, n_words from gsizes",
    lambda e: ev.group_sizes(e),
)
_register_diffusion(
    "eval_multi_seed_mean",
    dict(_LS, seeds=fx.SEEDS),
    "select round(avg(accuracy), 6) as mean_accuracy, list(round(accuracy, 6) order by split_id) as accuracies from stats",
    lambda e: ev.mean_over_splits(ev.test_stats(e).select("split_id", "accuracy")).select(
        F.round("mean_accuracy", 6).alias("mean_accuracy"),
        F.transform("accuracies", lambda x: F.round(x, 6)).alias("accuracies"),
    ),
)
_register_diffusion("ls_eval_stats_multi_seed", dict(_LS, seeds=fx.SEEDS), o.STATS_SELECT, _stats_select)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum slice: normalise -> kNN(3) -> symmetric -> split(seed 1) -> LP(3) -> evaluation stats."""
    return _stats_select(_evaluation(spark, sf_dir, **_LP))
