"""Graph analytics over an edge table ``src, dst``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut


def both_ways(edges: DataFrame) -> DataFrame:
    """Distinct undirected neighbours, each edge in both directions; loops left out."""
    e = edges.select("src", "dst").where("src is not null and dst is not null and src != dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """``node, in_degree, out_degree, degree`` over distinct edges, in one shuffle."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    return ends.where("node is not null").groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), (F.sum("i") + F.sum("o")).alias("degree"))


def top_connected(edges: DataFrame, k: int = 10) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "node").limit(k)


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """``node, hops``: nodes within ``depth`` (1 to 5) undirected hops of the start nodes, these not included."""
    near = cut(both_ways(edges))
    seen = start.select(F.col(start.columns[0]).alias("node")).distinct().withColumn("hops", F.lit(0))
    front = seen
    for k in range(1, max(1, min(5, depth)) + 1):
        front = near.join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hops", F.lit(k))
        front = cut(front)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("hops > 0")


def distances(edges: DataFrame, source: str, most: int | None = None, target: str | None = None) -> DataFrame:
    """``node, hops`` of every node that undirected hops from one node reach, itself included; up to ``most`` hops or until ``target`` is reached, where given."""
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    near = cut(both_ways(edges))
    seen = spark.range(1).select(F.lit(source).cast(kind).alias("node"), F.lit(0).alias("hops"))
    front = seen
    k = 0
    while most is None or k < most:
        if target is not None and not front.where(F.col("node").cast("string") == str(target)).isEmpty():
            break
        k += 1
        front = cut(near.join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hops", F.lit(k)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def path_length(edges: DataFrame, source: str, target: str, most: int | None = None) -> DataFrame:
    """One row: the hops of the shortest undirected path, -1 if there is none (within ``most`` hops, where given)."""
    d = distances(edges, source, most, target).where(F.col("node").cast("string") == str(target))
    return d.agg(F.coalesce(F.min("hops"), F.lit(-1)).cast("long").alias("hops"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component``: weakly connected components, named by their smallest node.

    Alternates large-star and small-star steps, which need O(log n) rounds
    and never hold a component in one task. Edges to nodes that don't exist
    are ignored; nodes without edges are components of their own.
    """
    n = nodes.select(F.col(nodes.columns[0]).alias("node")).where("node is not null").distinct()
    e = both_ways(edges).join(n.select(F.col("node").alias("src")), "src", "left_semi").join(n.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
    e = cut(e.where("src > dst"))
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
    before = mark(e)
    while True:
        # every larger neighbour to the smallest neighbour, then every smaller one
        sym = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = sym.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("m"))
        large = sym.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src != dst").distinct()
        low2 = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(low2, "src").select("dst", "m", "src")
        step = small.select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(small.select("src", F.col("m").alias("dst"))).where("src != dst").distinct()
        e = cut(step)
        now = mark(e)
        if now == before:
            break
        before = now
    return n.join(e.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("c")), "node", "left").select("node", F.coalesce("c", "node").alias("component"))


def diagnostics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: entities, edges, edges per entity, components, largest component, isolated entities."""
    n = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    ok = edges.join(n.select(F.col("node").alias("src")), "src", "left_semi").join(n.select(F.col("node").alias("dst")), "dst", "left_semi")
    size = components(n, ok).groupBy("component").agg(F.count("*").alias("k"))
    c = size.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("entity_count"), F.count("*").alias("connected_components"), F.coalesce(F.max("k"), F.lit(0)).alias("largest_component_size"))
    touched = ok.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    iso = n.join(touched, "node", "left_anti").agg(F.count("*").alias("isolated_entity_count"))
    m = ok.agg(F.count("*").alias("edge_count"))
    return c.join(F.broadcast(iso)).join(F.broadcast(m)).withColumn("edge_node_ratio", F.round(F.col("edge_count") / F.col("entity_count"), 2))


def graph_quality(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """One row: counts and 1 less penalties for isolated nodes, repeated names and edges that lead nowhere."""
    ids = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    touched = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    iso = ids.join(touched, "node", "left_anti").agg(F.count("*").alias("isolated"))
    dup = nodes.where(F.col(name).isNotNull() & (F.col(name) != "")).groupBy(name).agg(F.count("*").alias("k")).where("k > 1").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("duplicates"))
    good = edges.join(ids.select(F.col("node").alias("src")), "src", "left_semi").join(ids.select(F.col("node").alias("dst")), "dst", "left_semi").agg(F.count("*").alias("good"))
    n, e = nodes.agg(F.count("*").alias("node_count")), edges.agg(F.count("*").alias("edge_count"))
    x = n.join(F.broadcast(e)).join(F.broadcast(iso)).join(F.broadcast(dup)).join(F.broadcast(good)).withColumn("orphans", F.col("edge_count") - F.col("good")).drop("good")
    part = lambda a, b, most: F.when(F.col(b) > 0, F.least(F.lit(most), F.col(a) / F.col(b) * most)).otherwise(0.0)
    return x.withColumn("quality", F.round(1 - part("isolated", "node_count", 0.4) - part("duplicates", "node_count", 0.25) - part("orphans", "edge_count", 0.25), 6))


def best_edges(edges: DataFrame) -> DataFrame:
    """One edge per source, target and type: the most confident one's id, the columns that gave evidence, sorted, and their number."""
    t = F.coalesce("type", F.lit("RELATED"))
    return edges.groupBy("source", "target", t.alias("type")).agg(
        F.max_by("id", F.struct(F.coalesce("confidence", F.lit(0.0)), "id")).alias("id"), F.array_join(F.sort_array(F.collect_set("fk_column")), ",").alias("fk_columns"), F.count("*").alias("evidence_count"))


def subgraph(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """The edges among the first ``most`` nodes by id."""
    keep = nodes.select(F.col(nodes.columns[0]).alias("n")).distinct().orderBy("n").limit(most)
    return edges.join(keep.select(F.col("n").alias("src")), "src", "left_semi").join(keep.select(F.col("n").alias("dst")), "dst", "left_semi").distinct()


def coverage(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """``type, total, covered, rate`` of nodes that any edge touches."""
    touched = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("hit", F.lit(1))
    n = nodes.select(F.col(nodes.columns[0]).alias("node"), F.col(kind).alias("type"))
    return n.join(touched, "node", "left").groupBy("type").agg(F.count("*").alias("total"), F.count("hit").alias("covered"), F.round(F.count("hit") / F.count("*"), 6).alias("rate"))


# Pairs of classes that are usually related, and how.
PATTERNS = (
    ("Supplier", "Organization", "IS-A"), ("Supplier", "RawMaterial", "supply"), ("RawMaterial", "Component", "PART-OF"), ("Component", "Product", "PART-OF"), ("Disease", "Symptom", "causes"),
    ("Drug", "Disease", "treats"), ("Drug", "Symptom", "treats"), ("Patient", "Disease", "INSTANCE-OF"), ("Doctor", "Patient", "treats"), ("Hospital", "Department", "PART-OF"),
    ("Organization", "Employee", "PART-OF"), ("Process", "Step", "PART-OF"), ("Rule", "Entity", "关联"), ("Action", "Rule", "关联"), ("Category", "Item", "PART-OF"),
)


def missing_relations(types: DataFrame, linked: DataFrame, patterns: tuple[tuple[str, str, str], ...] = PATTERNS) -> DataFrame:
    """Patterns whose two classes occur (by part of their name) but of which no two members are linked.

    ``types`` has one row per type, ``linked`` the distinct pairs of types that
    edges connect; both are as long as there are types.
    """
    spark = types.sparkSession
    p = spark.createDataFrame([*patterns], "a string, b string, rel string")
    t = types.select(F.col(types.columns[0]).alias("t")).distinct()
    x = p.join(t.select(F.col("t").alias("ta")), F.lower("ta").contains(F.lower("a"))).join(t.select(F.col("t").alias("tb")), F.lower("tb").contains(F.lower("b"))).where("ta != tb")
    return x.join(linked, (x["ta"] == linked["src_type"]) & (x["tb"] == linked["dst_type"]), "left_anti").select("ta", "tb", "rel").distinct()
