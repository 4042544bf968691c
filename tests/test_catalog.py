"""A cross-section of registered queries against their SQL twins on the smallest tables."""
import duckdb
import pytest

import __spark_entry__ as entry
from glyphmill import catalog
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "flagship_burden_and_types", "p1_normalise_cell", "p1c_split_grammar", "p2f_classify_canonical14", "p8_token_levels", "a8_topology",
    "a12_architecture_tokens", "f1_stratified_folds", "f7_cross_fitted_scores", "f6_duplicate_groups", "l1_log_odds_weights",
    "l4_residual_weights", "l7_position_density", "l15_pair_contrast_features", "l25_evidence_shape", "n5_nearest_profiles",
    "b6_hard_pair_specialist", "f9_fold_local_blend", "b12_symmetric_pairs", "m4_top_k", "m6_w4_coverage_curve", "m15_segment_metrics",
    "q4_q5_cell_audit", "io1_io5_csv_roundtrip", "c3_enrichment_block",
]
WITHOUT_TWIN = {
    "l9_low_rank_weights", "l24_pruned_columns", "n3_confusion_groups", "b13_validated_pairs", "ml1_multinomial_logistic", "ml2_one_vs_rest_logistic",
    "ml3_naive_bayes_bernoulli", "ml3_naive_bayes_complement", "ml3_naive_bayes_multinomial", "ml4_ratio_scaled_one_vs_rest", "ml5_truncated_svd",
    "ml7_c1_out_of_fold_baseline", "c1_baseline_metrics", "ml8_important_columns", "c4_three_way_vote", "c5_selective_evidence_bag",
    "c6_saved_evidence_bundle", "c6b_saved_model", "c7_hierarchical_case", "c8_candidate_ranker",
    "f5_balanced_grouped_folds", "b4_blends_in_all_orders",  # greedy picks, against brute force in test_similarity and test_blends
}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_query_has_a_twin_or_a_reason():
    assert set(catalog.all_queries()) - set(catalog.all_oracles()) == WITHOUT_TWIN


def test_every_twin_is_text():
    assert all(isinstance(sql, str) for sql in entry.oracle_sql().values())


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(entry.oracle_sql()[name])
    assert got == rows_of(rel.columns, rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
