"""Every registered query against its SQL on the smallest tables, and the shape of key plans."""

import os
import re

import pytest

import __spark_entry__ as entry
from sluicework.operators import anomaly as A, profile as P
from sluicework.workloads.common import DOCUMENTS, ORDERS, QUERIES, shipping_history, table
from tools.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql_without_cross_joins_or_python(spark, con, name):
    df = entry.queries()[name](spark, SF)
    text = plan(df)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
        assert node not in text
    problem = compare(spark, con, lambda *_: df, entry.oracle_sql()[name], SF)
    assert problem == "", problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_scan_reads_contract_columns_only(spark):
    df = P.summarise(table(spark, SF, "documents").drop("x"), DOCUMENTS, "lang", metrics=False, distinct="none")
    from pyspark.sql import functions as F

    narrow = P.profile(df, DOCUMENTS).select("batch", "total_rows", F.col("columns")[4]["above_max"])
    schema = re.findall(r"ReadSchema: struct<([^>]*)>", plan(narrow))
    assert schema == ["lang:string,n_chars:bigint"]


def test_rule_scan_shuffles_one_row_per_batch(spark):
    from pyspark.sql import functions as F

    df = P.summarise(table(spark, SF, "orders"), ORDERS, F.year("o_orderdate"), distinct="none")
    text = plan(P.profile(df, ORDERS))
    assert text.count("Exchange ") == 1 and "partial_count" in text


def test_last_runs_are_cut_before_the_shuffle(spark):
    text = plan(A.global_baselines(shipping_history(spark, SF)))
    assert "WindowGroupLimit" in text
