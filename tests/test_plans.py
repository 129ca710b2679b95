"""Plan-shape regression tests: the properties that matter at scale."""

import re

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

QUERIES = E.queries()


def formatted(spark, df):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("name", [
    "bm25_topk", "dense_topk", "hybrid_search", "satisfy_all", "trigram_similarity", "knn_graph",
    "assign_nearest", "fresh_at", "asof_state", "pick_verifiers", "route_provider", "graph_vote",
    "preference_pairs", "cooccurrence_edges", "settle_jobs", "ledger_balances", "error_class"])
def test_no_nested_loop_join(spark, name):
    plan = formatted(spark, QUERIES[name](spark, SF_SMALL))
    assert not re.search(r"BroadcastNestedLoopJoin|CartesianProduct", plan)


@pytest.mark.parametrize("name", ["bm25_topk", "dense_topk", "keep_last", "representatives"])
def test_topk_is_cut_before_the_shuffle(spark, name):
    plan = formatted(spark, QUERIES[name](spark, SF_SMALL))
    assert re.search(r"(?m)^Arguments: .*row_number\(\), \d+, Partial", plan)


def test_scan_pushdown_and_pruning(spark):
    plan = formatted(spark, QUERIES["read_table"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(l_shipdate), IsNotNull(l_returnflag), " \
           "GreaterThanOrEqual(l_shipdate,1995-01-01T00:00), EqualTo(l_returnflag,R)]" in plan
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert schema.count(":") == 5  # 3 projected + 2 filtered columns, not all 11


def test_bm25_has_no_term_join_blowup(spark):
    """Scoring is a scan of the block index: no join on the term, and no
    shuffle but that of the final ranking; with a budget it runs in bounded
    block groups."""
    plan = formatted(spark, QUERIES["bm25_topk"](spark, SF_SMALL))
    assert "MapInArrow" in plan and "Join" not in plan
    assert len(re.findall(r"(?m)^\(\d+\) Exchange", plan)) == 1
    assert "FlatMapGroupsInPandas" in formatted(spark, QUERIES["pack_context"](spark, SF_SMALL))
