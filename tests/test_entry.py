from __future__ import annotations

import __spark_entry__ as e


def test_contract(spark):
    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 80
    assert {"p3_found", "p5_found"} <= set(q)
    assert e.entry(spark).columns == ["node_id", "root_id", "depth"]
