from __future__ import annotations

import random

from loomgraph.operators import graph
from loomgraph.plans import catalogue_graph


def E(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_components_against_union_find(spark):
    rng = random.Random(2)
    ids = [f"n{i:02}" for i in range(60)]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(45)] + [("n00", "ghost")]
    up = {i: i for i in ids}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in pairs:
        if b in up:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame([(i,) for i in ids], "id string"), E(spark, pairs)).collect()}
    assert got == {i: min(j for j in ids if find(j) == find(i)) for i in ids}


def test_paths(spark):
    e = E(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")])
    assert graph.path_length(e, "a", "d").first()[0] == 3
    assert graph.path_length(e, "a", "x").first()[0] == -1
    n = {r.node: r.hops for r in graph.neighbourhood(e, spark.createDataFrame([("b",)], "id string"), 2).collect()}
    assert n == {"a": 1, "c": 1, "d": 2}


def test_degrees_and_quality(spark):
    e = E(spark, [("a", "b"), ("a", "b"), ("a", "c")])
    assert {r.node: (r.in_degree, r.out_degree) for r in graph.degrees(e).collect()} == {"a": (0, 2), "b": (1, 0), "c": (1, 0)}
    nodes = spark.createDataFrame([("a", "N"), ("b", "N"), ("z", "Z")], "id string, name string")
    q = graph.graph_quality(nodes, E(spark, [("a", "b")]), "name").first()
    assert (q.isolated, q.duplicates, q.orphans) == (1, 2, 0)
    d = graph.diagnostics(nodes, E(spark, [("a", "b"), ("a", "ghost")])).first()
    assert (d.entity_count, d.edge_count, d.connected_components, d.isolated_entity_count) == (3, 1, 2, 1)


def test_path_of_more_than_twelve_hops(spark, tmp_path):
    pairs = [(f"n{i:02}", f"n{i + 1:02}", "o", "t") for i in range(13)]
    spark.createDataFrame(pairs, "source_entity string, target_entity string, ontology_id string, type string").coalesce(1).write.parquet(str(tmp_path / "relations.parquet"))
    assert catalogue_graph.shortest_path(spark, str(tmp_path)).first()[0] == 13


def test_diverse_picks_as_by_choosing_singly(spark):
    import random

    from loomgraph.operators.search import diverse_picks

    rng = random.Random(2)
    rows = [(g, i, rng.randint(0, 20) / 20, None if rng.random() < 0.3 else rng.randint(0, 10) / 10, rng.randint(1, 60)) for g in "abc" for i in range(30)] + [("d", 1, 0.5, 0.5, 500), ("e", 1, 0.5, None, 5)]
    want = set()
    for g in "abcde":
        rest = sorted((r for r in rows if r[0] == g and r[4] <= 100), key=lambda r: (-r[2], r[1]))
        left, picked = 100, []
        while len(picked) < 5 and (fits := [r for r in rest if r[4] <= left and r not in picked]):
            near = lambda r: max((1 - abs(r[3] - p[3]) for p in picked if p[3] is not None), default=0.0)
            best = max(fits, key=lambda r: (r[2] if r[3] is None else 0.75 * r[2] - 0.25 * near(r), r[2], -rest.index(r)))
            left -= best[4]
            picked.append(best)
            want.add((g, best[1], len(picked)))
    got = {tuple(r) for r in diverse_picks(spark.createDataFrame(rows, "g string, id int, score double, cosine double, tokens int"), "g", 5, 100).collect()}
    assert got == want and not any(g == "d" for g, _, _ in got)
