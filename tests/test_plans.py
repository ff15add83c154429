"""What the plans must look like to hold on a large corpus."""

import pytest

from checks.queries import QUERIES
from corpuslens.plans.session import materialize, spread
from corpuslens.plans.storage import shared_dir

SF = "/root/testdata/sf0.001"
SLOW = {"stream_scores", "stream_summary", "stream_foreach_batch", "topic_discovery", "similarity_lsh"}


def plan_of(df, capsys):
    df.explain()
    return capsys.readouterr().out


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_no_python_workers_and_no_products(spark, capsys, name):
    plan = plan_of(QUERIES[name](spark, SF), capsys)
    for operator in ("ArrowEvalPython", "BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan


@pytest.mark.parametrize("name", ["common_words", "pattern_hits", "pii_selected", "toxicity_lexicon"])
def test_arrays_are_exploded_without_a_second_evaluation(spark, capsys, name):
    assert "Filter ((size(" not in plan_of(QUERIES[name](spark, SF), capsys)


@pytest.mark.parametrize("name", ["sentiment_compound", "toxicity_score", "topic_closest", "similarity_shingle"])
def test_tokens_meet_small_tables_by_broadcast(spark, capsys, name):
    plan = plan_of(QUERIES[name](spark, SF), capsys)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_texts_are_not_carried_through_the_explode(spark, capsys):
    for name in ("sentiment_compound", "toxicity_score", "topic_closest", "similarity_shingle"):
        plan = plan_of(QUERIES[name](spark, SF), capsys)
        generated = [line for line in plan.splitlines() if "Generate explode" in line]
        assert generated
        for line in generated:
            kept = line.split("), [", 1)[1]
            assert "text#" not in kept.replace("has_text#", "") and "terms#" not in kept


@pytest.mark.parametrize("name", ["similarity_tfidf", "topic_closest", "topic_counts"])
def test_term_counts_are_not_evaluated_per_term(spark, capsys, name):
    lines = plan_of(QUERIES[name](spark, SF), capsys).splitlines()
    for line in lines:
        if "sort_array" in line:
            assert "lambdafunction" not in line and line.count("sort_array") == 1


def test_patterns_and_statistics_stay_in_the_row(spark, capsys):
    plan = plan_of(QUERIES["pii_selected"](spark, SF), capsys)
    assert "HashAggregate" not in plan


def test_filters_and_columns_reach_the_scan(spark, capsys):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = plan_of(QUERIES["table_filter"](spark, SF), capsys)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(n_chars,1000)" in plan and "StringContains(text,on the)" in plan
    plan = plan_of(QUERIES["toxicity_lexicon"](spark, SF), capsys)
    assert "quality" not in plan and "n_chars" not in plan


def test_spread_leaves_wide_inputs_alone(spark):
    assert spread(spark.range(0, 100, 1, 2), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 100, 1, 50)
    assert spread(wide, "id") is wide


def test_materialized_tables_have_no_lineage(spark, capsys):
    df = materialize(spark.range(10).selectExpr("id * 2 AS x"))
    assert "stored-" in plan_of(df, capsys)
    assert shared_dir(spark)
