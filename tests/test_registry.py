"""Registered queries and their SQL."""

from checks.catalogue import ORACLE, QUERIES


def test_sql_belongs_to_queries_and_most_queries_have_it():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) <= {"hull_solidity_h2", "field_extent_h8", "caller_segmentation_u3", "signed_rank_p_r8", "rank_sum_p_r9", "material_tests_a9"}
