"""What the plans have to look like for large tables."""

import os

import pytest

from tests.test_queries import FOLDER
from workload.queries import all_queries

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plan(spark, name):
    return all_queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_no_cross_join_and_no_row_udf(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    assert ("ArrowEvalPython" in text) == (name in ("clean_pages", "clean_reviews"))


def test_only_needed_columns_are_read(spark):
    text = plan(spark, "monthly_volume")
    assert "ReadSchema: struct<l_linenumber:int,l_shipdate:timestamp_ntz>" in text
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in plan(spark, "rating_bands")


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(n_name)" in plan(spark, "city_map") or "IsNotNull(p_brand)" in plan(spark, "city_map")
    assert "PushedFilters: [IsNotNull(p_name), Or(EqualTo(p_name" in plan(spark, "business_comparison") or (
        "In(p_name, [hot bolt,large ring])" in plan(spark, "business_comparison")
    )


def test_reviews_are_summed_before_they_are_joined(spark):
    text = plan(spark, "top_businesses")
    scan = text.index("lineitem.parquet")
    assert text.rindex("partial_sum", 0, scan) > text.rindex("Join", 0, scan)


def test_top_words_are_limited_before_the_shuffle(spark):
    assert "partial_count" in plan(spark, "word_frequency_by_label")
    assert "TakeOrderedAndProject" in plan(spark, "word_frequency")


def test_plans_are_made_without_running_a_job(spark):
    for name in ("city_quartile_asc", "city_quartile_desc", "business_rank", "rank_in_city", "tfidf_keywords", "sentiment_with_lexicon"):
        spark.sparkContext.setJobGroup("planning", name)
        all_queries()[name](spark, FOLDER)
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("planning")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_scoring_does_not_shuffle(spark):
    assert "Exchange" not in plan(spark, "sentiment_scores")
    assert "Exchange" not in plan(spark, "build_reviews").replace("BroadcastExchange", "")


@pytest.mark.parametrize("name", ["insights", "insights_by_month"])
def test_insights_read_the_facts_once(spark, name):
    """Businesses' and months' sums come from one exchange; the mentions of the scoped findings are rows of their own."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan shows reused exchanges before it runs
    try:
        text = plan(spark, name)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    scans = [line for line in text.split("\n") if "FileScan parquet [l_" in line and "l_partkey" in line]
    assert len(scans) == 1 and "ReusedExchange" in text


def test_every_rule_fires(spark):
    """In a registered query each rule; of the first, the two forms that the tables can give."""
    rows = [r for name in ("insights", "insights_by_month") for r in all_queries()[name](spark, FOLDER.replace("sf0.001", "sf0.01")).collect()]
    assert {r.rule_order for r in rows} == {1, 2, 3, 4, 5, 6, 7}
    assert {r.type for r in rows if r.rule_order == 1} == {"critical", "warning"}
