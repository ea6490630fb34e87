"""DuckDB SQL that computes the same results as the registered Spark queries.

The SQL is the brute-force definition (all pairs, unrolled iterations, plain
windows); it is only run on the small correctness scale.  Fragments are CTE
bodies composed by small builders so that every query spells out the same
fixture and stage definitions as the Spark side.
"""

from __future__ import annotations

# Fixture CTEs (FIXTURES.md, without id subsets).
VEC_FX = "select vec_id as word, cast(embedding as double[]) as vector, label as synset from embeddings"
CORPUS_FX = (
    "select 'D' || cast(doc_id as varchar) || 'X' as doc_id, "
    "'muß § 5 -vor- Maß_x ' || text || ' D' || cast(doc_id as varchar) || 'X tail' as text from documents"
)
CONCEPTS_FX = """
select cast(doc_id * 100000 + sno as bigint) as concept, cast(doc_id * 100000 + sno as bigint) as pos,
       case when (doc_id + sno) % 4 = 0 then 'antonym' else 'synonym' end as class,
       string_split(trim(sentence), ' ') as keys
from (
  select doc_id, unnest(range(len(parts))) as sno, unnest(parts) as sentence
  from (select doc_id, regexp_split_to_array(text, '[.!?\\n]') as parts from documents)
) where trim(sentence) <> ''
"""
SCORES_FX = (
    "select event_id as word, value as y_conf, user_id % 7 as n_train, event_id % 11 as n_pred, "
    "cast(event_id % 3 as int) as score from events"
)
RUNS_FX = (
    "select event_type as series, cast(event_id % 5 + 1 as int) as iter, round(avg(value) / 1000, 6) as mean_accuracy "
    "from events group by event_type, event_id % 5"
)

# Whitespace class of Python's str.isspace for RE2.
RE2_WS = r"\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}"


def with_ctes(ctes: list[tuple[str, str]], final: str) -> str:
    body = ",\n".join(f"{name} AS (\n{sql}\n)" for name, sql in ctes)
    return f"WITH {body}\n{final}"


def seeds_values(seeds) -> str:
    return "select unnest([" + ", ".join(str(int(s)) for s in seeds) + "]) as split_id"


def normalized(src: str = "vec_fx") -> str:
    return (
        "select word, list_transform(vector, lambda x: case when nrm > 0 then x / nrm else x end) as vector from "
        f"(select word, vector, sqrt(list_sum(list_transform(vector, lambda y: y * y))) as nrm from {src})"
    )


def knn_pairs(src: str, k: int, include_self: bool) -> str:
    cond = "" if include_self else "where a.word <> b.word"
    return (
        "select src, dst, score from (select a.word as src, b.word as dst, list_distance(a.vector, b.vector) as score, "
        "row_number() over (partition by a.word order by list_distance(a.vector, b.vector), b.word) as rn "
        f"from {src} a, {src} b {cond}) where rn <= {k}"
    )


def radius_pairs(src: str, radius: float, include_self: bool) -> str:
    cond = "" if include_self else "and a.word <> b.word"
    return (
        "select a.word as src, b.word as dst, list_distance(a.vector, b.vector) as score "
        f"from {src} a, {src} b where list_distance(a.vector, b.vector) <= {radius} {cond}"
    )


def weighted(pairs: str, mode: str, include_self: bool) -> str:
    if mode == "connectivity":
        return f"select src, dst, 1.0::double as weight from {pairs}"
    sql = f"select src, dst, 1.0 - score * score / 2.0 as weight from {pairs}"
    if not include_self:
        sql += " where src <> dst"
    return sql


def symmetric(edges: str) -> str:
    return (
        "select src, dst, weight from (select src, dst, case when count(*) >= 2 then max(weight) "
        "else greatest(max(weight), 0.0) end as weight from (select src, dst, weight from "
        f"{edges} union all select dst as src, src as dst, weight from {edges}) group by src, dst) where weight <> 0"
    )


def graph_ctes(variant="knn", k=3, radius=0.1, mode="connectivity", include_self=False, force_symmetric=True):
    ctes = [("vec_fx", VEC_FX), ("nv", normalized("vec_fx"))]
    if variant == "knn":
        ctes.append(("pairs", knn_pairs("nv", k, include_self)))
    else:
        ctes.append(("pairs", radius_pairs("nv", radius, include_self)))
    ctes.append(("wedges", weighted("pairs", mode, include_self)))
    if force_symmetric:
        ctes.append(("edges", symmetric("wedges")))
    else:
        ctes.append(("edges", "select * from wedges"))
    return ctes


def split_ctes(thesaurus: str, variant="sample_each_concept_frac", frac=0.5, n_test=1, seeds=(1,)):
    ctes = [
        ("seed_ids", seeds_values(seeds)),
        (
            "sp_h",
            "select s.split_id, t.word, t.synset, md5(cast(s.split_id as varchar) || ':' || cast(t.word as varchar)) as h "
            f"from {thesaurus} t, seed_ids s",
        ),
        (
            "sp_rk",
            "select *, row_number() over (partition by split_id, synset order by h) as rn, "
            "count(*) over (partition by split_id, synset) as cnt from sp_h",
        ),
    ]
    if variant == "sample_each_concept_frac":
        part = f"case when rn <= round_even({float(frac)} * cnt, 0) then 'train' else 'test' end"
    elif variant == "sample_each_concept_n":
        part = f"case when rn <= {int(n_test)} then 'test' else 'train' end"
    else:
        part = "'train'"
    ctes.append(("split", f"select split_id, word, synset, {part} as part from sp_rk"))
    ctes.append(("train", "select split_id, word, synset from split where part = 'train'"))
    ctes.append(("test", "select split_id, word, synset from split where part = 'test'"))
    return ctes


def labels_ctes(nodes: str = "select word from vec_fx"):
    return [
        ("nodes", nodes),
        (
            "labels",
            "select s.split_id, n.word, cast(coalesce(t.synset, -1) as int) as y_train "
            "from nodes n cross join seed_ids s left join train t on t.split_id = s.split_id and t.word = n.word",
        ),
        ("seeds", "select split_id, word, y_train as synset, 1.0::double as score from labels where y_train <> -1"),
    ]


def lp_ctes(iterations: int):
    ctes = [
        ("deg", "select src, sum(weight) as d from edges group by src"),
        ("pmat", "select e.src, e.dst, e.weight / deg.d as p from edges e join deg using (src)"),
        (
            "punl",
            "select s.split_id, m.src, m.dst, m.p from pmat m cross join seed_ids s where not exists "
            "(select 1 from seeds x where x.split_id = s.split_id and x.word = m.src)",
        ),
        ("st0", "select split_id, word, synset, score from seeds"),
    ]
    for i in range(1, iterations + 1):
        ctes.append(
            (
                f"st{i}",
                "select p.split_id, p.src as word, st.synset, sum(p.p * st.score) as score "
                f"from punl p join st{i - 1} st on p.split_id = st.split_id and p.dst = st.word "
                "group by p.split_id, p.src, st.synset union all select split_id, word, synset, score from seeds",
            )
        )
    return ctes


def ls_ctes(iterations: int, alpha: float):
    ctes = [
        ("deg", "select src, sum(weight) as d from edges group by src"),
        (
            "smat",
            "select e.src, e.dst, e.weight / sqrt(a.d * b.d) as s from edges e join deg a on a.src = e.src "
            "join deg b on b.src = e.dst",
        ),
        ("st0", "select split_id, word, synset, score from seeds"),
    ]
    for i in range(1, iterations + 1):
        ctes.append(
            (
                f"st{i}",
                "select split_id, word, synset, sum(score) as score from ("
                f"select st.split_id, m.src as word, st.synset, {alpha} * m.s * st.score as score "
                f"from smat m join st{i - 1} st on m.dst = st.word "
                f"union all select split_id, word, synset, score * (1.0 - {alpha}) from seeds) "
                "group by split_id, word, synset",
            )
        )
    return ctes


def finalize_ctes(state: str):
    return [
        (
            "conf",
            "select split_id, word, synset, coalesce(score / nullif(sum(score) over (partition by split_id, word), 0), 0) "
            f"as conf from {state}",
        ),
        (
            "conf_rk",
            "select *, row_number() over (partition by split_id, word order by round(conf, 9) desc, synset) as r from conf",
        ),
        (
            "top",
            "select split_id, word, "
            "cast(max(case when r = 1 then (case when conf <> 0 then synset else -1 end) end) as int) as y_pred, "
            "max(case when r = 1 then conf end) as y_conf, "
            "cast(list_slice(list_concat(list(case when conf <> 0 then synset else -1 end order by r), [-1, -1, -1]), 1, 3) as int[]) "
            "as y_top3_classes from conf_rk where r <= 3 group by split_id, word",
        ),
        (
            "preds",
            "select l.split_id, l.word, l.y_train, cast(coalesce(t.y_pred, -1) as int) as y_pred, "
            "coalesce(t.y_conf, 0.0) as y_conf, coalesce(t.y_top3_classes, [-1, -1, -1]::int[]) as y_top3_classes "
            "from labels l left join top t on t.split_id = l.split_id and t.word = l.word",
        ),
    ]


def evaluation_ctes(preds: str = "preds"):
    return [
        (
            "evaluation",
            "select p.split_id, p.word, cast(coalesce(tr.synset, -1) as int) as y_train, p.y_pred, p.y_conf, "
            "p.y_top3_classes, cast(te.synset as int) as y_test "
            f"from {preds} p left join train tr on tr.split_id = p.split_id and tr.word = p.word "
            "left join test te on te.split_id = p.split_id and te.word = p.word",
        ),
    ]


def stats_ctes(evaluation: str = "evaluation"):
    return [
        (
            "tstats",
            "select split_id, "
            "avg(case when y_test is not null then (case when y_pred = y_test then 1.0 else 0.0 end) end) as accuracy, "
            "avg(case when y_test is not null and y_pred = y_test then y_conf end) as mean_conf_true, "
            "avg(case when y_test is not null and y_pred <> y_test then y_conf end) as mean_conf_false, "
            "avg(case when y_test is not null then (case when list_contains(y_top3_classes, y_test) then 1.0 else 0.0 end) end) "
            "as mean_within_top3, count(*) as count_all_words, count(case when y_train <> -1 then 1 end) as count_train_set, "
            "count(case when y_test is not null then 1 end) as count_test_set, "
            "count(case when y_test is not null and y_pred = y_test then 1 end) as count_correctly_predicted "
            f"from {evaluation} group by split_id",
        ),
        (
            "gsizes",
            f"select split_id, y_pred, count(*) as n_words from {evaluation} where y_pred <> -1 group by split_id, y_pred",
        ),
        (
            "gstats",
            "select split_id, count(*) as count, avg(n_words) as mean, stddev_samp(n_words) as std, "
            "cast(min(n_words) as double) as min, quantile_cont(n_words, 0.25) as p25, quantile_cont(n_words, 0.5) as p50, "
            "quantile_cont(n_words, 0.75) as p75, cast(max(n_words) as double) as max, cast(sum(n_words) as bigint) as sum_preds, "
            "cast(first(y_pred order by n_words desc, y_pred) as int) as max_group_id from gsizes group by split_id",
        ),
        ("stats", "select * from tstats left join gstats using (split_id)"),
    ]


ROUND = 6


def r6(expr: str, alias: str | None = None) -> str:
    return f"round(round({expr}, 12), {ROUND}) as {alias or expr}"


STATS_SELECT = (
    "select split_id, "
    + ", ".join(
        r6(c)
        for c in ("accuracy", "mean_conf_true", "mean_conf_false", "mean_within_top3")
    )
    + ", count_all_words, count_train_set, count_test_set, count_correctly_predicted, count, "
    + ", ".join(r6(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max"))
    + ", sum_preds, max_group_id from stats"
)


def synset_vector_ctes(k: int):
    """E5/E6 over ``nv`` (normalised vectors) and ``train``."""
    return [
        ("tv", "select t.split_id, t.synset, nv.vector from train t join nv using (word)"),
        ("svcomp", "select split_id, synset, unnest(range(len(vector))) as i, unnest(vector) as x from tv"),
        ("svmean", "select split_id, synset, i, avg(x) as x from svcomp group by split_id, synset, i"),
        ("svraw", "select split_id, synset, list(x order by i) as vector from svmean group by split_id, synset"),
        ("sv", "select split_id, synset, list_transform(vector, lambda x: case when nrm > 0 then x / nrm else x end) as vector "
               "from (select *, sqrt(list_sum(list_transform(vector, lambda y: y * y))) as nrm from svraw)"),
        ("sims", "select s.split_id, s.synset, w.word, list_dot_product(s.vector, w.vector) as similarity from sv s, nv w "
                 "where not exists (select 1 from train t where t.split_id = s.split_id and t.word = w.word and t.synset = s.synset)"),
        ("topk", "select * from (select *, row_number() over (partition by split_id, synset order by similarity desc, word) as rank "
                 f"from sims) where rank <= {int(k)}"),
    ]


def ls_split_ctes(iterations: int, alpha: float):
    """Label spreading over a per-split graph ``edges(split_id, src, dst, weight)``."""
    ctes = [
        ("deg", "select split_id, src, sum(weight) as d from edges group by split_id, src"),
        (
            "smat",
            "select e.split_id, e.src, e.dst, e.weight / sqrt(a.d * b.d) as s from edges e "
            "join deg a on a.split_id = e.split_id and a.src = e.src join deg b on b.split_id = e.split_id and b.src = e.dst",
        ),
        ("st0", "select split_id, word, synset, score from seeds"),
    ]
    for i in range(1, iterations + 1):
        ctes.append(
            (
                f"st{i}",
                "select split_id, word, synset, sum(score) as score from ("
                f"select st.split_id, m.src as word, st.synset, {alpha} * m.s * st.score as score "
                f"from smat m join st{i - 1} st on m.split_id = st.split_id and m.dst = st.word "
                f"union all select split_id, word, synset, score * (1.0 - {alpha}) from seeds) "
                "group by split_id, word, synset",
            )
        )
    return ctes
