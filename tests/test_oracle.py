"""Every registered query equals its SQL; the large-input plans give the same rows."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from sparselens.workload.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"

# Queries whose plan changes with the size of the input.
SIZE_DEPENDENT = [
    "F5_at_least_percentile", "A4_activation_distribution", "A5_activation_stats", "A7_co_occurring_features",
    "A7_co_occurrence_all_probes", "A8_quantile", "A12_correlation_pairs", "A17_loss_statistics",
    "A18_nearest_summary", "A20_histogram_per_feature", "J1_token_text", "J2_context_text_joined",
    "J3_strong_token_rows", "M11_error_weighted_draw", "P3_token_ids", "P4_vector_per_token", "P5_progress",
    "P11_context_windows", "P11_context_by_document", "P13_extract_chunks", "S11_document_chunks",
    "W3_smoothed_losses", "W5_batch_index", "D9_classify_tokens", "S17_report_top_activations",
    "A24_batch_summary", "P12_records", "P13_corpus_to_activations", "W6_document_rank", "M9_fire_counts",
    "M10_dead_per_window", "M12_reinitialise", "P7_decode", "X6_all_features_at_once",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    problem, *_ = compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert problem is None


@pytest.mark.parametrize("name", SIZE_DEPENDENT)
def test_large_input_plan_equals_sql(spark, con, large, name):
    problem, *_ = compare(spark, con, name, QUERIES[name], SQL[name], SF)
    assert problem is None


def test_every_query_has_sql_and_rows():
    assert set(QUERIES) == set(SQL) and set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 20 and all("**" in r["context_string"] for r in rows)
