"""Plan shape of every registered query: no cartesian products or nested-loop joins,
and column pruning / filter pushdown at the parquet scans."""

import pytest

from lexiprop.plans.registry import all_queries

from conftest import SF_SMALL

QUERIES = all_queries()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_or_nested_loop(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_scan_prunes_columns(spark):
    plan = _plan(QUERIES["vocab_min5"](spark, SF_SMALL))
    # only the text column of documents is read
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan or "ReadSchema: struct<text:string>" in plan


def test_class_filter_pushed_down(spark, tmp_path):
    from lexiprop import fixtures as fx
    from lexiprop.operators import thesaurus as th

    path = str(tmp_path / "concepts")
    fx.concepts_fx(spark, SF_SMALL).write.parquet(path)
    plan = _plan(th.class_counts(th.synonym_concepts(spark.read.parquet(path))))
    assert "PushedFilters: [IsNotNull(class), EqualTo(class,synonym)]" in plan


def test_top_n_windows_are_limited_before_the_shuffle(spark):
    from lexiprop.plans.review_queries import eval_lp
    from lexiprop.operators.review import suggestions

    plan = suggestions(eval_lp(spark, SF_SMALL), "high_first")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
