from __future__ import annotations

import random

from loomgraph.operators.hierarchy import descendants, hierarchy, hierarchy_edges, several_parents


def brute(pairs: list[tuple[str, str]]) -> dict[str, tuple[str, int]]:
    par: dict[str, str] = {}
    for c, p in sorted(pairs, reverse=True):
        par[c] = p
    out = {}
    for n in {x for e in pairs for x in e}:
        seen, u = [n], n
        while u in par and par[u] not in seen:
            u = par[u]
            seen.append(u)
        out[n] = (min(seen[seen.index(par[u]):]), -1) if u in par else (u, len(seen) - 1)
    return out


def result(df) -> dict[str, tuple[str, int]]:
    return {r.node_id: (r.root_id, r.depth) for r in df.collect()}


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "child string, parent string")


def test_random_forests_with_loops(spark):
    rng = random.Random(4)
    pairs = []
    for i in range(1, 220):
        pairs.append((f"n{i:03}", f"n{max(0, i - rng.choice([1, 1, 1, 2, 30])):03}"))
    pairs += [("a1", "a2"), ("a2", "a3"), ("a3", "a1"), ("b", "a2"), ("c", "b"), ("self", "self"), ("kid", "self")]
    got = hierarchy(edges(spark, pairs), with_paths=True).cache()
    assert result(got) == brute(pairs)
    for r in got.collect():
        if r.depth < 0:
            assert r.path is None
        else:
            assert len(r.path) == r.depth + 1 and r.path[0] == r.root_id and r.path[-1] == r.node_id
            assert all((c, p) in set(pairs) for p, c in zip(r.path, r.path[1:]))
    d = {(r.ancestor_id, r.node_id): r.distance for r in descendants(got).collect()}
    want = {(r.path[k], r.node_id): r.depth - k for r in got.collect() if r.depth > 0 for k in range(r.depth)}
    assert d == want


def test_long_chain_and_star(spark):
    chain = [(f"c{i:04}", f"c{i - 1:04}") for i in range(1, 300)]
    star = [(f"s{i:04}", "hub") for i in range(400)]
    got = result(hierarchy(edges(spark, chain + star)))
    assert got["c0299"] == ("c0000", 299) and got["s0007"] == ("hub", 1) and got["hub"] == ("hub", 0)


def test_edge_cases(spark):
    assert hierarchy(edges(spark, [])).count() == 0
    got = hierarchy(edges(spark, [("a", "b"), ("a", "b"), ("a", None), (None, "b"), ("a", "c")]))
    assert result(got) == {"a": ("b", 1), "b": ("b", 0)}
    assert [tuple(r) for r in several_parents(edges(spark, [("a", "b"), ("a", "c"), ("d", "b")])).collect()] == [("a", ["b", "c"])]


def test_relation_types_and_careless_ids(spark):
    rel = spark.createDataFrame(
        [("1", " E-A ", "e-b", "PartOf", None), ("2", "e-b", "E-C", "has_part", None), ("3", "e-a", "e-x", "属于", None), ("4", "e-d", "e-a", " is a ", None), ("5", "e-e", "e-a", "part_of", "2024-01-01"), ("6", "e-e", "e-a", "supplies", None)],
        "id string, source_entity string, target_entity string, type string, deprecated_at string")
    ent = spark.createDataFrame([(x, "extra") for x in ("e-a", "e-b", "e-c", "e-d", "e-e")] * 2, "id string, type string")
    assert {tuple(r) for r in hierarchy_edges(rel, ent).collect()} == {("e-a", "e-b"), ("e-c", "e-b"), ("e-d", "e-a")}
