from __future__ import annotations

from datetime import datetime as D

from loomgraph.operators.references import ReferenceCounts, existence_deltas, orphan_references, orphan_report, reference_deltas

R = "id string, source_entity string, target_entity string, ontology_id string, created_at timestamp_ntz, extra string"
E = "id string, created_at timestamp_ntz, deprecated_at timestamp_ntz, extra string"
P = "id string, created_at timestamp_ntz"


def run(spark, r, e, p):
    return orphan_references(spark.createDataFrame(r, R), spark.createDataFrame(e, E), spark.createDataFrame(p, P))


def test_kinds(spark):
    t = [D(2024, m, 1) for m in range(1, 7)]
    e = [("e1", t[0], None, ""), ("e1", t[0], None, ""), ("e2", t[3], None, ""), ("e3", t[0], t[2], "")]
    p = [("o1", t[0]), ("o2", t[4])]
    r = [("a", " E1 ", "e2", "o1", t[2], ""), ("b", "e3", "nope", "O2", t[2], ""), ("c", "e3", "e1", "o1", t[1], ""), ("b", "e3", "nope", "O2", t[2], ""), ("d", None, " ", None, t[2], ""), ("f", "e2", "e3", "gone", t[5], "")]
    got = {(x.relation_id, x.ref_field): x.kind for x in run(spark, r, e, p).collect()}
    assert got == {("a", "target_entity"): "late", ("b", "source_entity"): "deleted", ("b", "target_entity"): "missing", ("b", "ontology_id"): "late", ("f", "target_entity"): "deleted", ("f", "ontology_id"): "missing"}
    rep = {(x.ref_field, x.period, x.kind): x.n for x in orphan_report(run(spark, r, e, p)).collect()}
    assert rep[("target_entity", "2024-03", "missing")] == 1


def test_hot_target_and_empty(spark):
    t = D(2024, 1, 1)
    r = [(f"r{i}", "hub", "hub", "o", t, "") for i in range(500)]
    assert run(spark, r, [("hub", t, None, "")], [("o", t)]).count() == 0
    assert run(spark, r, [], [("o", t)]).count() == 1000
    assert run(spark, [], [], []).count() == 0


def test_counts_are_kept_through_batches(spark):
    t = [D(2024, m, 1) for m in range(1, 7)]
    rel, ent, pro = (lambda rows, schema=s: spark.createDataFrame(rows, schema) for s in (R, E, P))
    r1 = [("a", "e1", "e2", "o1", t[2], ""), ("b", "e3", "nope", "o1", t[2], ""), ("c", "e1", "e1", "o1", t[3], "")]
    c = ReferenceCounts().change(reference_deltas(rel(r1)), existence_deltas(ent([("e1", t[0], None, ""), ("e3", t[0], None, "")]), pro([("o1", t[0])])))
    assert {(x.relation_id, x.ref_field, x.kind) for x in c.orphans().collect()} == {("a", "target_entity", "missing"), ("b", "target_entity", "missing")}
    # b is withdrawn, a re-delivered with another target, e3 deleted before a further reference to it, e2 comes late
    r2 = [("a", "e1", "e3", "o1", t[2], ""), ("d", "e3", "e2", "o1", t[4], "")]
    c = c.change(reference_deltas(rel(r1[:2]), -1).unionByName(reference_deltas(rel(r2))), existence_deltas(ent([("e3", t[0], None, "")]), None, -1).unionByName(existence_deltas(ent([("e3", t[0], t[3], ""), ("e2", t[5], None, "")]), None)))
    assert {(x.relation_id, x.ref_field, x.kind) for x in c.orphans().collect()} == {("d", "source_entity", "deleted"), ("d", "target_entity", "late")}
    # b comes back
    c = c.change(reference_deltas(rel(r1[1:2])))
    now = {(x.relation_id, x.ref_field): x.kind for x in c.orphans().collect()}
    whole = run(spark, [*r2, r1[1], r1[2]], [("e1", t[0], None, ""), ("e3", t[0], t[3], ""), ("e2", t[5], None, "")], [("o1", t[0])])
    assert now == {(x.relation_id, x.ref_field): x.kind for x in whole.collect()} and now[("b", "target_entity")] == "missing"
    # a withdrawal that comes before its delivery
    early = ReferenceCounts().change(reference_deltas(rel(r1), -1), existence_deltas(ent([]), pro([])))
    assert early.orphans().count() == 0 and early.change(reference_deltas(rel(r1))).orphans().count() == 0
    twice = ReferenceCounts().change(reference_deltas(rel(r1 + r1)), existence_deltas(ent([]), pro([]))).change(reference_deltas(rel(r1)))
    assert twice.orphans().count() == 9 and twice.change(reference_deltas(rel(r1), -1)).orphans().count() == 0
