"""Plan-shape checks: top-k is limited before the shuffle, keyword search has no
product join, and the text / conversation operators stay in the JVM."""
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
Q = E.queries()


def plan(spark, name):
    df = Q[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["d7_lexical_search", "d1_semantic_search", "d13_hybrid_search"])
def test_topk_is_group_limited(spark, name):
    p = plan(spark, name)
    assert "WindowGroupLimit" in p


@pytest.mark.parametrize("name", ["d7_lexical_search", "d8_bm25_search", "d13_hybrid_search", "i4_run_profile",
                                  "h1_exchanges", "h3_memory_window", "h4_history_slice"])
def test_no_product_joins(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", [n for n in Q if n[0] in "efghj" and not n.endswith("_by_table")])
def test_no_python_in_text_operators(spark, name):
    p = plan(spark, name)
    for node in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas", "FlatMapGroupsInPandas"):
        assert node not in p, node


def test_scan_prunes_columns(spark):
    p = plan(spark, "a5_load_collection")
    assert "ReadSchema: struct<doc_id:bigint,source:string,n_chars:bigint>" in p
