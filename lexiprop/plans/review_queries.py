"""Registered queries for review selection, scoring, method comparison and run results."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiprop import fixtures as fx
from lexiprop.functions import text as tx
from lexiprop.operators import baseline as bl
from lexiprop.operators import compare as cp
from lexiprop.operators import graph as gr
from lexiprop.operators import review as rv
from lexiprop.operators import splits as sp
from lexiprop.operators import vocab as vo
from lexiprop.plans import oracle as o
from lexiprop.plans.expansion import rounded
from lexiprop.plans.graph_queries import _LP, _LS, _diffusion_sql, _evaluation
from lexiprop.plans.text_queries import SIMPLE_TOKENS_SQL, VOCAB_SQL
from lexiprop.session import cut_lineage

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


# --- evaluations used as inputs -------------------------------------------------

EVAL_LP_SQL = _diffusion_sql(final="select * from evaluation", **_LP)
EVAL_LS_SQL = _diffusion_sql(final="select * from evaluation", **_LS)
EVAL_BL_SQL = o.with_ctes(
    [("vec_fx", o.VEC_FX), ("nv", o.normalized("vec_fx"))]
    + o.split_ctes(_THES_SQL, seeds=(1,))
    + o.synset_vector_ctes(10)
    + [
        ("best", "select split_id, word, cast(first(synset order by round(similarity, 9) desc, synset) as int) as y_pred, "
                 "first(similarity order by round(similarity, 9) desc, synset) as y_conf from topk group by split_id, word"),
        ("preds", "select s.split_id, n.word, cast(coalesce(b.y_pred, -1) as int) as y_pred, coalesce(b.y_conf, -100.0) as y_conf, "
                  "[-1, -1, -1]::int[] as y_top3_classes from vec_fx n cross join seed_ids s "
                  "left join best b on b.split_id = s.split_id and b.word = n.word"),
    ]
    + o.evaluation_ctes(),
    "select * from evaluation",
)


# The review and comparison queries read an evaluation table several times
# (counts, bands, samples, suggestions): each is written to the checkpoint folder once.

def eval_lp(spark, sf_dir):
    return cut_lineage(_evaluation(spark, sf_dir, **_LP))


def eval_ls(spark, sf_dir):
    return cut_lineage(_evaluation(spark, sf_dir, **_LS))


def eval_bl(spark, sf_dir):
    vec = fx.vec_fx(spark, sf_dir)
    unit = gr.normalize_vectors(vec.select("word", "vector"))
    split = cut_lineage(sp.split_thesaurus(vec.select("word", "synset"), seeds=(1,)))
    return cut_lineage(bl.baseline_evaluation(unit, split, 10))


LP = [("ev", EVAL_LP_SQL)]


# --- review selection ---------------------------------------------------------------

@register(
    "sanity_unpredicted",
    o.with_ctes(
        LP,
        "select split_id, count(case when y_train = -1 and y_test is null and y_pred = -1 then 1 end) as n_without_anything, "
        "count(case when y_train = -1 and y_test is not null and y_pred = -1 then 1 end) as n_test_without_prediction "
        "from ev group by split_id",
    ),
)
def q_sanity_unpredicted(spark, sf_dir):
    return rv.sanity_counts(eval_lp(spark, sf_dir))


COUNTS = LP + [
    ("tc", "select split_id, y_train as synset, count(*) as n_train from ev where y_train <> -1 group by split_id, y_train"),
    ("pc", "select split_id, y_pred as synset, count(*) as n_pred from ev group by split_id, y_pred"),
    ("counts", "select tc.split_id, tc.synset, tc.n_train, pc.n_pred from tc left join pc using (split_id, synset)"),
]


@register("synset_counts", o.with_ctes(COUNTS, "select split_id, synset, n_train, n_pred from counts"))
def q_synset_counts(spark, sf_dir):
    return rv.synset_counts(eval_lp(spark, sf_dir))


def _bands_sql(cuts) -> list:
    q = ", ".join(str(float(c)) for c in cuts)
    return [
        ("qs", f"select split_id, quantile_cont(n_train, [{q}]) as qt, quantile_cont(n_pred, [{q}]) as qp from counts group by split_id"),
        (
            "bands",
            "select c.split_id, c.synset, c.n_train, c.n_pred, "
            "c.n_train <= qt[1] as n_train_low, (c.n_train >= qt[2] and c.n_train <= qt[3]) as n_train_mid, c.n_train >= qt[4] as n_train_high, "
            "c.n_pred <= qp[1] as n_pred_low, (c.n_pred >= qp[2] and c.n_pred <= qp[3]) as n_pred_mid, c.n_pred >= qp[4] as n_pred_high "
            "from counts c join qs using (split_id)",
        ),
    ]


@register("quantile_bands", o.with_ctes(COUNTS + _bands_sql(rv.MAIN_STUDY_CUTS), "select * from bands"))
def q_quantile_bands(spark, sf_dir):
    return rv.quantile_bands(rv.synset_counts(eval_lp(spark, sf_dir)))


def _groups_sql():
    parts = []
    for ti, tb in enumerate(rv.BANDS):
        for pi, pb in enumerate(rv.BANDS):
            g = ti * 3 + pi + 1
            parts.append(f"select split_id, {g} as \"group\", synset, n_train, n_pred from bands where n_pred is not null and n_train_{tb} and n_pred_{pb}")
    parts.append("select split_id, 10 as \"group\", synset, n_train, n_pred from bands where n_pred is not null and n_train_high and n_pred >= 10")
    return [("groups", " union all ".join(parts))]


GROUPS = COUNTS + _bands_sql(rv.MAIN_STUDY_CUTS) + _groups_sql()


def _groups(spark, sf_dir):
    return rv.review_groups(rv.quantile_bands(rv.synset_counts(eval_lp(spark, sf_dir))), extra_group=True)


@register("review_groups", o.with_ctes(GROUPS, "select split_id, \"group\", synset, n_train, n_pred from groups"))
def q_review_groups(spark, sf_dir):
    return _groups(spark, sf_dir).withColumn("group", F.col("group").cast("int"))


def _sample_sql(per_group: int, seed: int):
    ctes = [("gh", f"select *, md5('{seed}' || ':' || cast(synset as varchar)) as h from groups")]
    taken = None
    for g in range(1, 11):
        cond = "" if taken is None else f" and not exists (select 1 from {taken} t where t.split_id = c.split_id and t.synset = c.synset)"
        ctes.append((f"pick{g}", "select * from (select c.*, row_number() over (partition by split_id order by h) as pick "
                                 f"from gh c where \"group\" = {g}{cond}) where pick <= {per_group}"))
        body = f"select split_id, synset from pick{g}" if taken is None else f"select * from {taken} union all select split_id, synset from pick{g}"
        ctes.append((f"taken{g}", body))
        taken = f"taken{g}"
    ctes.append(("sample", " union all ".join(f"select * from pick{g}" for g in range(1, 11))))
    return ctes


SAMPLE = GROUPS + _sample_sql(3, 1)


def _sample(spark, sf_dir, evaluation=None):
    groups = _groups(spark, sf_dir) if evaluation is None else rv.review_groups(
        rv.quantile_bands(rv.synset_counts(evaluation)), extra_group=True
    )
    return rv.sample_groups(groups, 3, 1)


@register("review_sample", o.with_ctes(SAMPLE, "select split_id, \"group\", synset, n_train, n_pred, pick from sample"))
def q_review_sample(spark, sf_dir):
    s = _sample(spark, sf_dir)
    return s.select("split_id", F.col("group").cast("int").alias("group"), "synset", "n_train", "n_pred", F.col("pick").cast("long").alias("pick"))


def _sugg_sql(order: str, seed: int = 1):
    keys = {
        "high_first": "round(y_conf, 9) desc, word",
        "low_first": "round(y_conf, 9), word",
        "random": f"md5('{seed}' || ':' || cast(word as varchar))",
    }[order]
    return (
        f"select '{order}' as conf_order, split_id, synset, rank, word, round(round(conf, 12), 6) as conf from ("
        f"select split_id, y_pred as synset, row_number() over (partition by split_id, y_pred order by {keys}) as rank, word, y_conf as conf "
        "from ev where y_train <> y_pred and y_pred <> -1) where rank <= 10"
    )


@register("suggestions_top10", o.with_ctes(LP, " union all ".join(_sugg_sql(x) for x in rv.CONF_ORDERS)))
def q_suggestions_top10(spark, sf_dir):
    e = eval_lp(spark, sf_dir)
    out = None
    for order in rv.CONF_ORDERS:
        t = rounded(rv.suggestions(e, order, seed=1)).select(
            F.lit(order).alias("conf_order"), "split_id", "synset", F.col("rank").cast("long").alias("rank"), "word", "conf"
        )
        out = t if out is None else out.unionByName(t)
    return out


@register(
    "review_sheet",
    o.with_ctes(
        SAMPLE
        + [
            ("sugg", "select split_id, synset, rank, word, conf from (" + _sugg_sql("high_first") + ")"),
            ("rows_", "select split_id, y_train as synset, 'training' as section, cast(null as int) as rank, word, cast(null as double) as conf "
                      "from ev where y_train <> -1 union all select split_id, synset, 'suggestion' as section, cast(rank as int), word, conf from sugg"),
        ],
        "select s.split_id, s.\"group\", s.synset, r.section, r.rank, r.word, r.conf, "
        "'conf_order: high_first, y_train: ' || cast(s.n_train as varchar) || ', y_pred: ' || cast(s.n_pred as varchar) as remark, "
        "cast(null as int) as score from sample s join rows_ r using (split_id, synset)",
    ),
)
def q_review_sheet(spark, sf_dir):
    e = eval_lp(spark, sf_dir)
    sheet = rv.review_sheet(e, _sample(spark, sf_dir, e), "high_first", 1)
    return rounded(sheet.withColumn("group", F.col("group").cast("int")))


# --- scoring ---------------------------------------------------------------------------

SCORES = [("scores_fx", o.SCORES_FX)]


@register(
    "score_distribution",
    o.with_ctes(
        SCORES + [("c", "select score, count(*) as n from scores_fx group by score")],
        "select score, n, floor((2000 * n + t) / (2 * t)) / 10.0 as percent from c, (select sum(n) as t from c)",
    ),
)
def q_score_distribution(spark, sf_dir):
    return rv.score_distribution(fx.scores_fx(spark, sf_dir))


def _avg_rank_sql(col: str) -> str:
    return f"(rank() over (order by {col}) + (count(*) over (partition by {col}) - 1) / 2.0)"


@register(
    "score_spearman",
    o.with_ctes(
        SCORES
        + [
            ("rk", "select " + ", ".join(f"{_avg_rank_sql(c)} as r_{c}" for c in ("y_conf", "n_train", "n_pred", "score")) + " from scores_fx"),
        ],
        "select round(corr(r_y_conf, r_score), 6) as spearman_y_conf, round(corr(r_n_train, r_score), 6) as spearman_n_train, "
        "round(corr(r_n_pred, r_score), 6) as spearman_n_pred from rk",
    ),
)
def q_score_spearman(spark, sf_dir):
    s = fx.scores_fx(spark, sf_dir)
    parts = [rv.spearman(s, c) for c in ("y_conf", "n_train", "n_pred")]
    merged = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return rounded(merged.agg(*[F.max(f"spearman_{c}").alias(f"spearman_{c}") for c in ("y_conf", "n_train", "n_pred")]))


# --- method comparison -------------------------------------------------------------------

STACKED = [("ev_lp", EVAL_LP_SQL), ("ev_ls", EVAL_LS_SQL), ("ev_bl", EVAL_BL_SQL)] + [
    ("stacked", "select 0 as method, * from ev_lp union all select 1 as method, * from ev_ls union all select 2 as method, * from ev_bl"),
    ("tests", "select * from stacked where y_test is not null"),
]


def _stacked(spark, sf_dir):
    return cp.stack([eval_lp(spark, sf_dir), eval_ls(spark, sf_dir), eval_bl(spark, sf_dir)], ["lp", "ls", "baseline"])


@register(
    "pair_overlap",
    o.with_ctes(
        STACKED
        + [
            ("top", "select split_id, method, y_pred, word from (select *, row_number() over (partition by split_id, method, y_pred "
                    "order by round(y_conf, 9) desc, word) as r from tests) where r <= 10"),
            ("sizes", "select split_id, method, y_pred as synset, count(*) as size from top group by split_id, method, y_pred"),
            ("shared", "select a.split_id, a.method as method_a, b.method as method_b, a.y_pred as synset, count(*) as shared from top a join top b "
                       "on a.split_id = b.split_id and a.y_pred = b.y_pred and a.word = b.word and a.method < b.method group by all"),
            ("syn", "select distinct split_id, y_train as synset from stacked where method = 0"),
            ("pairs", "select * from (values (0, 1), (0, 2), (1, 2)) p(method_a, method_b)"),
            ("j", "select s.split_id, p.method_a, p.method_b, s.synset, sa.size as size_a, sb.size as size_b, coalesce(sh.shared, 0) as shared "
                  "from syn s cross join pairs p left join sizes sa on sa.split_id = s.split_id and sa.method = p.method_a and sa.synset = s.synset "
                  "left join sizes sb on sb.split_id = s.split_id and sb.method = p.method_b and sb.synset = s.synset "
                  "left join shared sh on sh.split_id = s.split_id and sh.method_a = p.method_a and sh.method_b = p.method_b and sh.synset = s.synset"),
        ],
        "select split_id, method_a, method_b, round(avg(case when size_a is not null and size_b is not null then shared / greatest(size_a, size_b) else 0.0 end), 6) "
        "as mean_overlap, cast(sum(case when size_a is not null and size_b is not null then shared else 0 end) as bigint) as shared_words "
        "from j group by split_id, method_a, method_b",
    ),
)
def q_pair_overlap(spark, sf_dir):
    return rounded(cp.pair_overlap(_stacked(spark, sf_dir), range(3)))


@register(
    "pair_combined_accuracy",
    o.with_ctes(
        STACKED,
        "select a.split_id, p.method_a, p.method_b, "
        "round(avg(case when a.y_pred <> -1 and b.y_pred <> -1 and a.y_pred = b.y_pred then 1.0 else 0.0 end), 6) as equal_predictions, "
        "round(avg(case when a.y_pred = a.y_test or b.y_pred = a.y_test then 1.0 else 0.0 end), 6) as combined_accuracy "
        "from tests a join (values (0, 1), (0, 2), (1, 2)) p(method_a, method_b) on a.method = p.method_a "
        "left join tests b on b.split_id = a.split_id and b.word = a.word and b.method = p.method_b group by a.split_id, p.method_a, p.method_b",
    ),
)
def q_pair_combined_accuracy(spark, sf_dir):
    return rounded(cp.pair_combined_accuracy(_stacked(spark, sf_dir), range(3)))


def _chosen_sql(ev: str) -> str:
    return (
        f"select word from {ev} where y_train in (select synset from chosen) union "
        f"select word from (select word, row_number() over (partition by y_pred order by round(y_conf, 9) desc, word) as r "
        f"from {ev} where y_train <> y_pred and y_pred in (select synset from chosen)) where r <= 50"
    )


LABELS = [("ev_lp", EVAL_LP_SQL), ("ev_bl", EVAL_BL_SQL)] + [
    ("chosen", "select distinct y_train as synset from ev_lp where y_train <> -1"),
    ("lw", _chosen_sql("ev_lp")),
    ("rw", _chosen_sql("ev_bl")),
    ("tw", "select distinct word from ev_lp where y_train in (select synset from chosen)"),
    ("labels", "select coalesce(l.word, r.word) as word, case when coalesce(l.word, r.word) in (select word from tw) then 'training' "
               "when l.word is not null and r.word is not null then 'both' when l.word is not null then 'left_only' else 'right_only' end as label "
               "from lw l full outer join rw r on l.word = r.word"),
]


def _labels(spark, sf_dir):
    lp, base = eval_lp(spark, sf_dir), eval_bl(spark, sf_dir)
    chosen = lp.filter(F.col("y_train") != -1).select(F.col("y_train").alias("synset")).distinct()
    return cp.word_labels(lp, base, chosen, 50)


@register("method_word_labels", o.with_ctes(LABELS, "select word, label from labels"))
def q_method_word_labels(spark, sf_dir):
    return _labels(spark, sf_dir)


@register(
    "projector_rows",
    o.with_ctes(
        LABELS + [("nv", o.normalized("(" + o.VEC_FX + ")"))],
        "select cast(l.word as varchar) as word, l.label, list_transform(n.vector, lambda x: round(x, 6)) as vector "
        "from labels l left join nv n on n.word = l.word",
    ),
)
def q_projector_rows(spark, sf_dir):
    unit = gr.normalize_vectors(fx.vec_fx(spark, sf_dir).select("word", "vector"))
    rows = cp.projector_rows(_labels(spark, sf_dir), unit)
    return rows.select("word", "label", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@register(
    "transliterate_vocab",
    o.with_ctes(
        [("simple_tokens", SIMPLE_TOKENS_SQL), ("vocab", VOCAB_SQL)],
        "select word, replace(replace(replace(replace(word, 'ü', 'ue'), 'ö', 'oe'), 'ä', 'ae'), 'ß', 'ss') as transliterated from vocab",
    ),
)
def q_transliterate_vocab(spark, sf_dir):
    v = vo.vocabulary(vo.simple_tokens(fx.table(spark, sf_dir, "documents")))
    return v.select("word", tx.transliterate(F.col("word")).alias("transliterated"))


# --- run results -------------------------------------------------------------------------

RUNS = [("runs_fx", o.RUNS_FX)]


@register(
    "runs_pivot",
    o.with_ctes(
        RUNS,
        "select iter, " + ", ".join(
            f"first(mean_accuracy) filter (where series = '{s}') as {s}" for s in ("click", "error", "purchase", "signup", "view")
        ) + " from runs_fx group by iter",
    ),
)
def q_runs_pivot(spark, sf_dir):
    return cp.runs_table(fx.runs_fx(spark, sf_dir))


def _runs_with_params(spark, sf_dir):
    r = fx.runs_fx(spark, sf_dir)
    return r.select(
        F.concat(F.col("series"), F.lit("-"), F.col("iter").cast("string")).alias("run_id"),
        F.concat(F.lit("series="), F.col("series"), F.lit(";iter="), F.col("iter").cast("string"), F.lit(";")).alias("params"),
        "mean_accuracy",
    )


_DYN = [f"iter={i};" for i in range(1, 6)]


@register(
    "runs_select",
    o.with_ctes(
        RUNS
        + [
            ("rp", "select series || '-' || cast(iter as varchar) as run_id, 'series=' || series || ';iter=' || cast(iter as varchar) || ';' as params, "
                   "mean_accuracy from runs_fx"),
            ("dyn", "select unnest([" + ", ".join(f"'{d}'" for d in _DYN) + "]) as dynamic"),
        ],
        "select d.dynamic, r.run_id, r.mean_accuracy from rp r join dyn d on contains(r.params, d.dynamic) "
        "where contains(r.params, 'series=') and not contains(r.params, 'series=error') and contains(r.params, 'series=click')",
    ),
)
def q_runs_select(spark, sf_dir):
    return cp.select_runs(_runs_with_params(spark, sf_dir), ["series=", "series=click"], ["series=error"], _DYN)


# --- column conventions and list parsing ---------------------------------------------------

@register(
    "columns_and_sentinels",
    o.with_ctes(
        [("vec_fx", o.VEC_FX)] + o.split_ctes(_THES_SQL, seeds=(1,)),
        "select v.word, cast(coalesce(t.synset, -1) as int) as y_train, [-1, -1, -1]::int[] as y_top3_classes "
        "from vec_fx v left join train t on t.word = v.word",
    ),
)
def q_columns_and_sentinels(spark, sf_dir):
    vec = fx.vec_fx(spark, sf_dir)
    split = sp.split_thesaurus(vec.select("word", "synset"), seeds=(1,))
    return cp.seeded_view(vo.vocabulary_of_vectors(vec), sp.train_part(split))


@register(
    "list_parse",
    o.with_ctes(LP, "select word, y_top3_classes, '[' || array_to_string(y_top3_classes, ', ') || ']' as top3_text, y_top3_classes as parsed from ev"),
)
def q_list_parse(spark, sf_dir):
    e = eval_lp(spark, sf_dir)
    text = F.concat(F.lit("["), F.array_join(F.col("y_top3_classes"), ", "), F.lit("]"))
    return e.select("word", "y_top3_classes", text.alias("top3_text")).withColumn("parsed", tx.parse_int_list(F.col("top3_text")))
