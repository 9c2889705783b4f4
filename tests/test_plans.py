"""Shape of the physical plans."""

import pytest

from sparkvec.catalog import QUERIES

NAMES = ("R1_build_index_postings", "R2_sparse_search_dot", "R2_sparse_search_blocks", "R5_all_documents_search",
         "R6_dense_search", "R6_dense_search_blocks", "C1_topk_encode", "C11_sharded_encode", "C8_raw_topk",
         "M4_ndcg", "M10_sparsity_trade_off", "J1_relevance", "J4_negatives", "J8_retrieval_split_val", "S3_qrels_lenient")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_product_joins_and_no_row_python(spark, sf_dir, name):
    plan = _plan(QUERIES[name](spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan


@pytest.mark.parametrize("name", ("C1_topk_encode", "C8_raw_topk", "C8_raw_topk_bulk", "R1_build_index_postings", "P10_l2_normalize_add"))
def test_map_only(spark, sf_dir, name):
    assert "Exchange" not in _plan(QUERIES[name](spark, sf_dir))


def test_scans_are_pruned(spark, sf_dir):
    plan = _plan(QUERIES["J1_relevance"](spark, sf_dir))
    assert plan.count("Filter") >= 1 and "l_linenumber" in plan  # rows judged irrelevant go before the joins
    assert "l_extendedprice" not in plan and "embedding#" not in plan


def test_hits_are_cut_before_the_merge(spark, sf_dir):
    assert "WindowGroupLimit" in _plan(QUERIES["R6_dense_search"](spark, sf_dir))
