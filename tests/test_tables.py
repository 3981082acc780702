from __future__ import annotations

import uuid

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import columns as C
from loomgraph.operators import governance, links, nested, profile, rules, search
from loomgraph.plans.pipeline import Dag, compiled, merged
from loomgraph.streaming import incremental as inc

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(df):
    return [tuple(r) for r in df.collect()]


def test_value_types(spark):
    vals = ["", "NULL", "2024-01-15", "15/01/2024", "20240115", "yes", "1", "12", "1,234", "1.5", "-2e3", "abc", None]
    df = spark.createDataFrame([(v,) for v in vals], "v string").select("v", profile.value_type(F.col("v")).alias("t"))
    got = {r.v: r.t for r in df.collect()}
    assert got == {"": "null", "NULL": "null", "2024-01-15": "timestamp", "15/01/2024": "timestamp", "20240115": "timestamp", "yes": "boolean", "1": "boolean", "12": "integer", "1,234": "integer", "1.5": "float", "-2e3": "float", "abc": "string", None: "null"}


def test_dates(spark):
    df = spark.createDataFrame([("2024/1/5",), ("15/01/2024",), ("20240105",), ("soon",)], "v string")
    assert [r[0] for r in df.select(C.iso_date("v")).collect()] == ["2024-01-05", "2024-01-15", "2024-01-05", "soon"]
    assert [r[0] for r in df.select(C.iso_date("v", True)).collect()] == ["2024-01-05", "2024-15-01", "2024-1-5", "soon"]


def test_quality(spark):
    df = spark.createDataFrame([("1", "a", "3"), ("1", "a", "3"), ("2", None, "x"), ("3", " ", "4")], "id string, name string, age string")
    r = profile.quality_report(df).first()
    assert (r.row_count, r.duplicate_count, r.validity) == (4, 1, round(1 - 1 / 3, 6)) and r.completeness == round(1 - (0 + 0.5 + 0) / 3, 6)
    assert profile.quality_report(df.where("false")).first().overall == 1.0


def test_blank_handling(spark):
    df = spark.createDataFrame([(" a ", None), ("", "b")], "x string, y string")
    assert one(profile.fill_blank(df)) == [("a", ""), ("", "b")]
    assert one(profile.mark_blank(df)) == [("a", "", None, "1"), ("", "b", "1", None)]
    assert profile.drop_blank_rows(df).count() == 0


def test_edits(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, s string, n int")
    e = spark.createDataFrame([("1", "s", "x", 1), ("1", "s", "y", 2), ("2", "n", None, 1), ("9", "s", "z", 1)], "row_pk string, field_name string, new_value string, k int")
    assert sorted(one(profile.apply_edits(df, e, "id", "k"))) == [(1, "y", 5), (2, "b", None)]


def test_flatten_and_explode(spark):
    df = spark.read.json(spark.sparkContext.parallelize(['{"id":1,"c":{"n":"x","a":{"z":1}},"items":[{"k":1},{"k":2}],"tags":["t"]}', '{"id":2,"c":{"n":"y","a":{"z":2}},"items":[],"tags":[]}']))
    f = nested.explode_first_array(nested.flatten(df))
    assert {"c.n", "c.a.z", "items.k", "tags"} <= set(f.columns) and f.count() == 3


def test_links(spark):
    sup = spark.createDataFrame([("SUP-001", "Acme Metals"), ("SUP-002", "Beta Cables"), ("SUP-003", "Gamma Paper")], "supplier_id string, name string")
    od = spark.createDataFrame([(1, "sup001"), (2, "SUP-002"), (3, "SUP_002"), (4, "none")], "order_id int, vendor string")
    ls = one(links.infer_links({"supplier": sup, "orders": od}, {"supplier": "supplier_id", "orders": "order_id"}).select("src", "col", "tgt", "match_count", "cardinality"))
    assert ls == [("orders", "vendor", "supplier", 3, "many_to_one")]
    assert sorted(one(links.key_join(od, "vendor", sup, "supplier_id").select("order_id", "__key"))) == [(1, "SUP-001"), (2, "SUP-002"), (3, "SUP-002")]
    p = {(r.dataset, r.col): r for r in links.key_profile({"s": sup}).collect()}
    assert p[("s", "name")].alt_key and p[("s", "supplier_id")].is_unique
    assert links.primary_key(["name", "supplier_id"], {"name", "supplier_id"}) == "supplier_id" and links.primary_key(["a"], set()) == "__row_hash__"
    assert links.named_foreign_key("customer_id", "Customer", "customers") == "HAS_CUSTOMER" and links.named_foreign_key("colour", "Customer", "customers") is None
    assert links.named_foreign_key("supplier.id", "Supplier", "supplier_database") == "HAS_SUPPLIER" and links.named_foreign_key("supplier.id", "Warehouse", "warehouse_db") is None
    assert links.named_foreign_key("supplierId", "Supplier", "x") == "HAS_SUPPLIER" and links.named_foreign_key("", "A", None) is None
    src = spark.createDataFrame([("SUP-001", "华东", 1), ("SUP-002", "华南", 2), (None, None, 3)], "`供应商` string, `目的区域` string, supplier_id int")
    tgt = spark.createDataFrame([("SUP-001",), ("SUP-002",), ("SUP-004",), (None,)], "id string")
    assert links.detected_foreign_keys(src, src.columns, tgt, "id", "Supplier", "supplier_database") == {"supplier_id": "HAS_SUPPLIER", "供应商": "HAS_SUPPLIER"}
    assert links.class_name("sales_orders") == "SalesOrders" and links.class_name("订单").startswith("Entity") and links.guessed_type("created") == "datetime"


def test_cardinality(spark):
    df = spark.createDataFrame([("a", "1", "x"), ("b", "2", "x"), ("a", "1", "y"), ("b", "1", "y"), ("a", "1", "z"), ("a", "2", "z")], "s string, t string, g string")
    assert {r.g: r.cardinality for r in links.cardinality(df, "s", "t", ["g"]).collect()} == {"x": "one_to_one", "y": "many_to_one", "z": "one_to_many"}


@SLOW
@given(st.lists(st.text(max_size=12), min_size=1, max_size=6))
def test_uuid5(spark, names):
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(C.uuid5(F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


@SLOW
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 5), st.integers(0, 3)), min_size=1, max_size=20), st.randoms())
def test_input_hash_ignores_order(spark, rows, rng):
    other = rows[:]
    rng.shuffle(other)
    h = lambda x: sorted(one(governance.input_hash(spark.createDataFrame(x, "k string, a int, b int"), "k", ["a", "b"])))
    assert h(rows) == h(other)


def test_rules(spark):
    df = spark.createDataFrame([("F", "5"), (None, "x"), ("O", None)], "s string, n string")
    got = {(r.rule, r.status): r.n for r in rules.evaluate_rules(df, [("a", "required", "s", None), ("b", "gt", "n", 3), ("c", "in", "s", ["F"]), ("d", "?", "s", 1)]).collect()}
    assert got == {("a", "passed"): 2, ("a", "failed"): 1, ("b", "passed"): 1, ("b", "error"): 2, ("c", "passed"): 1, ("c", "failed"): 2, ("d", "error"): 3}


def test_events(spark):
    log = spark.createDataFrame([(1, 1, "upsert", "a"), (1, 2, "upsert", "b"), (2, 1, "upsert", "c"), (2, 3, "delete", "c")], "k int, seq int, op string, v string")
    assert one(inc.current_state(log, "k", ["seq"], "op").select("k", "v")) == [(1, "b")]
    assert one(inc.next_cursor(log.where("false"), "seq", "k")) == [(None, None, 0)]
    assert inc.after_cursor(log, "seq", "k", (1, 1)).count() == 3
    bad = spark.createDataFrame([("{}",), ('{"event_id":"1","source_id":"s","resource":"r","primary_key":"p","operation":"upsert","watermark":"2024-01-01"}',)], "value string")
    assert [r.reason for r in inc.envelopes(bad).collect()] == ["missing event_id", None]


def test_chain(spark):
    e = spark.createDataFrame([("p", i, f"b{i}") for i in range(4)], "p string, i int, b string")
    c = governance.chained(e, ["p"], ["i"], F.col("b"))
    assert one(governance.verify_chain(c, ["p"], ["i"], F.col("b"))) == [("p", 4, 0, 0)]
    assert one(governance.verify_chain(c.where("i != 1"), ["p"], ["i"], F.col("b"))) == [("p", 3, 0, 1)]


def test_search(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id long, v array<float>")
    assert [r.id for r in search.vector_topk(v, "id", "v", [1.0, 0.1], 2).collect()] == [1, 3]
    near = {(r.query_id, r.rank): r.id for r in search.nearest_in_bulk(v, "id", "v", v, 1).collect()}
    assert near[(1, 1)] == 3 and near[(3, 1)] in (1, 2)
    t = spark.createDataFrame([(1, "abcdefgh", "b"), (2, "abcdefgx", "b"), (3, "zzzz", "b"), (4, "abcdefgh", "b")], "k int, t string, blk string")
    assert {(r.a, r.b) for r in search.similar_pairs(t, "k", "t", "blk", 0.85).collect()} == {(1, 2), (2, 4)}


def test_pipeline(spark):
    df = spark.createDataFrame([(" a ", "2024/1/2"), (" a ", "2024/1/2")], "x string, d string")
    run = compiled([{"op": "trim"}, {"op": "deduplicate"}, {"op": "normalize_dates", "columns": ["d"]}, {"op": "rename_columns", "names": {"x": "y"}}])
    assert one(run(df)) == [("a", "2024-01-02")]
    dag = Dag({"in": {"kind": "connector"}, "t": {"kind": "transform", "steps": [{"op": "limit", "n": 1}]}, "out": {"kind": "output"}}, [("in", "t"), ("t", "out")])
    assert dag.run(lambda n: df)["out"].count() == 1
    assert merged({"a": {"b": 1}, "c": 1}, {"a": {"d": 2}, "c": 3}) == {"a": {"b": 1, "d": 2}, "c": 3}
    try:
        Dag({"a": {"kind": "transform"}, "b": {"kind": "transform"}}, [("a", "b"), ("b", "a")]).order()
        raise AssertionError
    except ValueError:
        pass


def test_resolution_without_prefix(spark):
    from loomgraph.operators.search import resolution_plan

    o = spark.createDataFrame([("xabcdefghij",), ("bcdefghij",), ("mnopqrstuw",), ("zzzzzzzz",)], "n string")
    a = spark.createDataFrame([("abcdefghij",), ("mnopqrstuv",)], "n string")
    got = {r.name: (r.anchor, r.action) for r in resolution_plan(o, a, "n").collect()}
    assert got == {"xabcdefghij": ("abcdefghij", "review"), "bcdefghij": ("abcdefghij", "review"), "mnopqrstuw": ("mnopqrstuv", "review"), "zzzzzzzz": (None, "skip")}
