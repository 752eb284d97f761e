"""Every registered query against its SQL, and what its plan must not contain."""

import re

import pytest
from compare import compare, duck

from actlake.registry import all_queries

SF_DIR = "/root/testdata/sf0.001"
QUERIES = all_queries()
ROWS_ONLY = {"format_paragraphs", "diff_similarity"}


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_few_queries_lack_sql():
    assert {name for name, q in QUERIES.items() if q.sql is None} == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    assert compare(spark, connection, name, QUERIES[name], SF_DIR) is None


@pytest.mark.parametrize("name", ["diff_classify", "export_package", "category_stats", "quality_rules_table", "sync_categories", "global_stats", "page_confidence", "number_gaps"])
def test_plan(spark, name):
    plan = QUERIES[name].run(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython"):
        assert word not in plan
    # no window without a partition key
    assert not re.search(r"Window .*\n.*Sort.*\n.*Exchange SinglePartition", plan)
