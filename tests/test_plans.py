"""Plan checks: pushdown, pruning, no row-at-a-time Python, no global window over raw rows."""

import re

import pytest

from discloscope.plans.catalog import QUERIES


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", ["all_nlp", "claim_extract", "sentiment_frame", "percentile_rank", "risk_history", "panel_aggregate"])
def test_no_row_python_and_no_cartesian(spark, sf, name):
    text = plan(QUERIES[name].run(spark, sf))
    assert "BatchEvalPython" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filter_and_columns_reach_the_scan(spark, sf):
    text = plan(QUERIES["entity_filter"].run(spark, sf))
    assert "EqualTo(p_type,ECONOMY)" in text
    assert "p_retailprice" not in text


def test_global_rank_has_no_single_task_window_over_rows(spark, sf):
    text = plan(QUERIES["percentile_rank"].run(spark, sf))
    specs = [line for line in text.splitlines() if "windowspecdefinition(" in line]
    assert specs
    for line in specs:
        # a window without a slice key may only run over the per-slice totals
        assert all(w.startswith("_slice#") for w in re.findall(r"windowspecdefinition\(([^)]*)", line)) or "_tot_cnt" in line


def jobs_of(spark, run):
    tracker, group = spark.sparkContext.statusTracker(), "count-" + str(id(run))
    spark.sparkContext.setJobGroup(group, "jobs of one query")
    run().collect()
    return len(tracker.getJobIdsForGroup(group))


@pytest.mark.parametrize("name,most", [("final_score_tier", 18), ("risk_leaderboard", 22)])
def test_scores_take_few_jobs(spark, sf, name, most):
    assert jobs_of(spark, lambda: QUERIES[name].run(spark, sf)) <= most
