from __future__ import annotations

from datetime import date, datetime, timezone

import pytest

from loomgraph.functions import control
from loomgraph.operators import documents, ontology


def test_build(spark):
    sup = spark.createDataFrame([("S1", "Acme", "ok"), ("S2", "Beta", "ok"), ("S3", "Core", None)], "supplier_id string, name string, status string")
    od = spark.createDataFrame([("o1", "S1"), ("o2", "S1"), ("o3", "S2")], "order_id string, supplier_id string")
    b = ontology.build({"suppliers": sup, "orders": od}, "o")
    assert {r.dataset: r.key for r in b["keys"].collect()} == {"suppliers": "supplier_id", "orders": "order_id"}
    assert b["concepts"].count() == 2 and b["instances"].count() == 6
    assert {(r.src, r.tgt, r.match_count) for r in b["links"].collect()} == {("orders", "suppliers", 3)}
    assert {(r.dataset, r.rule, r.col) for r in b["rules"].collect()} >= {("suppliers", "completeness", "status"), ("suppliers", "state", "status")}
    assert ontology.row_links(od, "order_id", "supplier_id", sup, "supplier_id", "o", "HAS_SUPPLIERS").count() == 3
    assert {r.column: r.type for r in ontology.property_metadata(sup).collect()} == {"supplier_id": "string", "name": "string", "status": "string"}


def test_extraction(spark):
    e = spark.createDataFrame([("Acme（公司）", "T", "d", 0.9), ("acme", "T", "", 0.5), ("12", "T", "", 0.5), ("促销规则", "T", "", 0.5), ("A层", "T", "", 1.5), ("Beta", "X", "", None)], "name string, type string, description string, confidence double")
    r = spark.createDataFrame([("Acme", "Beta", "uses"), ("Acme", "Beta", "uses"), ("Acme", "Ghost", "uses"), ("Beta", "Beta", "is")], "source string, target string, type string")
    a, b = ontology.normalised_extraction(e, r)
    assert sorted(x.name for x in a.collect()) == ["Acme", "Beta"] and b.count() == 1
    got = {(x.check, x.key) for x in ontology.violations(e, r, ("T",)).collect()}
    assert {("unknown_type", "Beta"), ("confidence_range", "A层"), ("loop", "Beta|is|Beta"), ("repeated_triple", "Acme|uses|Beta"), ("dangling_target", "Acme|uses|Ghost")} <= got
    m = ontology.containing_name(spark.createDataFrame([("砚溪公司",)], "n string"), spark.createDataFrame([("砚溪公司集团",), ("别的",)], "n string"), "n")
    assert [tuple(x) for x in m.collect()] == [("砚溪公司", "砚溪公司集团")]
    assert [r.truncated for r in ontology.truncated(e, ["name"], 2).collect()] == [True, True]


def test_guard(spark):
    assert ontology.run_sql(spark, "select :x as x", x=3).first().x == 3
    with pytest.raises(ValueError):
        ontology.read_only("match (n) detach delete n")
    with pytest.raises(ValueError):
        ontology.read_only("match (n) return n", "ontology_id")


def test_cron_and_signatures():
    t = datetime(2024, 2, 28, 23, 59, tzinfo=timezone.utc)
    assert control.next_fire("0 0 29 2 *", t) == datetime(2024, 2, 29, tzinfo=timezone.utc)
    assert control.next_fire("*/15 9-10 * * 1", t) == datetime(2024, 3, 4, 9, tzinfo=timezone.utc)
    assert control.next_fire("0 0 * * *", t, excluded=frozenset({date(2024, 2, 29)})) == datetime(2024, 3, 1, tzinfo=timezone.utc)
    assert not control.cron_valid("61 * * * *") and not control.cron_valid("* *")
    s = control.signed(b"x", b"k", "100")
    assert control.verified(b"x", b"k", "100", s, 200) and not control.verified(b"x", b"k", "100", s, 900) and not control.verified(b"y", b"k", "100", s, 200)
    assert control.canonical({"b": 1.50, "a": {2, 1}}) == control.canonical({"a": {1, 2}, "b": 1.5})


def test_documents(spark):
    md = "# A\nIF x THEN y\nIF stock low, reorder\nAcme (vendor): makes things\n\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |\n## B\nbody"
    d = spark.createDataFrame([(1, md), (2, None)], "k int, t string")
    assert [(r.condition, r.action) for r in documents.rules(d, "k", "t").collect()] == [("x", "y"), ("stock low", "reorder")]
    assert [(r.name, r.qualifier) for r in documents.definitions(d, "k", "t").collect()] == [("Acme", "vendor")]
    assert [(r.table_index, r.row_index, r.col, r.cell) for r in documents.tables(d, "k", "t").collect()] == [(1, 1, "a", "1"), (1, 1, "b", "2")]
    assert [r.title for r in documents.sections(d, "k", "t").collect()] == ["A", "B"]
    assert [r.title for r in documents.headings(d, "k", "t").collect()] == ["A", "B"]
    cut = lambda t, most, overlap: [r.chunk for r in documents.chunks(spark.createDataFrame([(1, t), (2, None), (3, "")], "k int, t string"), "k", "t", most, overlap).orderBy("chunk_index").collect()]
    c = cut("# a\n" + "x" * 90 + "\n# b\n" + "y" * 90, 100, 10)
    assert len(c) == 2 and c[1].startswith("x" * 9) and cut("short", 100, 10) == ["short"]
    t = "\n\n".join(f"段落{i}" * 20 for i in range(5))
    assert "".join(cut(t, 70, 0)) == t and len(cut(t, 70, 0)) == 5 and all(sum(f"段落{i}" * 20 in x for x in cut(t, 70, 0)) == 1 for i in range(5))
    t = "# 一\n\n" + "甲" * 40 + "\n\n# 二\n\n" + "乙" * 40
    c = cut(t, 50, 10)
    assert len(c) == 2 and c[1].startswith(c[0][-10:]) and c[0] + c[1][10:] == t
    assert [(r.key, r.score) for r in documents.document_score(spark.createDataFrame([(1, "a", None, 9), (2, "a", "b", 9), (3, " ", "b", None)], "k int, x string, y string, n int"), "k", ["x", "y"], "n").collect()] == [(1, 0.7), (2, 1.0), (3, 0.5)]
    assert [(r.title, r.body) for r in documents.sections(spark.createDataFrame([(1, "前言\n1. 目的\n甲\n2) If x, y\n乙\n3、 范围\n\n4. 空\n"), (2, "无题"), (3, " ")], "k int, t string"), "k", "t").orderBy("key", "section_index").collect()] == [("目的", "甲\n2) If x, y\n乙"), ("", "无题")]
