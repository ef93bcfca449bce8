"""Registered queries against their SQL on the smallest data; DISCLOSCOPE_FULL=1 runs them all."""

import os

import pytest
from check import compare, duck

from discloscope.plans.catalog import QUERIES

CORE = """csv_scan article_feed_parse model_reply_parse dedup_keep_first median_impute scrub_nonfinite_counts key_lookup_fill
duplicate_columns expanded_impute_from_base union_profiles anti_join_new_entities year_gap_join latest_per_entity group_quartiles
histogram claim_metrics claim_report rule_report_analysis sentiment_frame remove_stopwords pillar_keywords all_numeric
all_categorical all_nlp scaling scaling_power proxy_labels final_score_tier risk_leaderboard ranked_output peer_rank
cumulative_share comparison_table reason_engine profile_vs_population event_before_after history_forecast_union stratified_split
classification_metrics roc_pr_curves blend_weight_search top_contributors knn_vote live_sentiment_delta alert_status""".split()
WITH_SQL = [n for n, q in QUERIES.items() if q.sql is not None]


@pytest.fixture(scope="session")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", WITH_SQL if os.environ.get("DISCLOSCOPE_FULL") else CORE)
def test_matches_sql(spark, sf, con, name):
    note = compare(QUERIES[name].run(spark, sf), con, QUERIES[name].sql)
    assert note.startswith("ok"), note


def test_entry_points(spark):
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 197
    assert entry.entry(spark).count() == 20
