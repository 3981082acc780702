"""Plans are looked at, not only results: what reaches the scan, what stays in the JVM, what is never done."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import search
from loomgraph.plans import catalogue_tables
from loomgraph.session import load
from loomgraph.streaming.incremental import after_cursor

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cursor_reaches_the_scan(spark):
    p = plan(after_cursor(load(spark, SF, "events"), "ts", "event_id", (datetime(2024, 1, 5), 3)).select("event_id"))
    assert "PushedFilters" in p and "GreaterThan" in p and "props" not in p.split("ReadSchema")[1]


def test_topk_needs_no_sort_of_all(spark):
    p = plan(search.vector_topk(load(spark, SF, "embeddings"), "vec_id", "embedding", [0.1] * len(load(spark, SF, "embeddings").first().embedding), 5))
    assert "TakeOrderedAndProject" in p and "Exchange" not in p


@pytest.mark.parametrize("name", sorted(catalogue_tables.queries()))
def test_tables_stay_in_the_jvm(spark, name):
    p = plan(catalogue_tables.queries()[name](spark, SF))
    assert "EvalPython" not in p and "MapInPandas" not in p and "CartesianProduct" not in p


def test_aggregates_are_partial(spark):
    p = plan(load(spark, SF, "relations").groupBy("type").agg(F.count("*")))
    assert "partial_count" in p
