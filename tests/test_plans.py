"""What the plans must look like: pruned scans, pushed filters, group limits, and no product of two tables."""

import os

import pytest

import __spark_entry__ as entry
from quarry.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables aren't here")


def plan(spark, name):
    return entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark):
    text = plan(spark, "stats_by_format")
    assert "text:string" not in text and "EqualTo(status,ok)" in text
    assert "PushedFilters: [IsNotNull(status), EqualTo(status,failed)]" in plan(spark, "failures_list")
    assert "text:string" not in plan(spark, "hybrid_search")
    assert "text:string" not in plan(spark, "all_chunks_join")


def test_ranking_is_cut_before_the_shuffle(spark):
    for name in ("dense_topk", "hybrid_search", "rerank_topk"):
        assert "WindowGroupLimit" in plan(spark, name), name


def test_filters_stay_above_the_candidates(spark):
    """The fused ranks are made before the filter on the stage."""
    text = plan(spark, "postfilter_stage")
    assert text.index("rank#") < text.index("fused_rank#")


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_no_cartesian_product(spark, name):
    assert "CartesianProduct" not in plan(spark, name)
