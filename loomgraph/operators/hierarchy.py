"""Parent-child rows of unknown depth: roots, depths, paths and descendants by tree contraction.

Every round rakes all leaves and splices out an independent set of the nodes
that have exactly one child, so a tree of n nodes and any depth is gone after
O(log n) rounds. What each round removed is kept with the node it hung from at
that time; undoing the rounds in reverse gives each node its root and depth in
one join a round. Loops contract to nodes that are their own parent and are
reported, never followed for ever.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, functions as F

from ..session import cut, scratch

SCHEMA = "node_id string, root_id string, depth long, path array<string>"


def hierarchy(edges: DataFrame, child: str = "child", parent: str = "parent", with_paths: bool = False) -> DataFrame:
    """One row per node at an end of ``edges``: ``node_id, root_id, depth`` (and ``path`` from the root, both ends included).

    A root has depth 0 and is its own root. Nodes on a loop, a node that is
    its own parent included, and nodes below a loop get depth -1, the smallest
    id on the loop as root and a null path. Rows with a null end are ignored;
    repeated rows count once; of several parents of one node the smallest id
    counts (see ``several_parents``). Other columns are ignored. No rows in
    give no rows out.
    """
    spark = edges.sparkSession
    kids = (
        edges.select(F.col(child).cast("string").alias("n"), F.col(parent).cast("string").alias("p"))
        .where("n is not null and p is not null")
        .groupBy("n").agg(F.min("p").alias("p"))
    )
    base = kids.withColumn("w", F.lit(1).cast("long")).withColumn("m", F.col("n"))
    if with_paths:
        base = base.withColumn("seg", F.array().cast("array<string>"))
    active = cut(base)
    roots = active.select(F.col("p").alias("n")).distinct().join(active.select("n"), "n", "left_anti")
    removed: list[DataFrame] = []
    k = 0
    while True:
        loops = active.where("n = p")
        if active.where("n != p").isEmpty():
            break
        k += 1
        marked = cut(_marked(active, k))
        gone = marked.where("fate != 0").drop("fate", "np", "nw", "nm", "nseg")
        removed.append(gone)
        seg = [F.when(F.col("np").isNull(), F.col("seg")).otherwise(F.concat("seg", F.array("p"), "nseg")).alias("seg")] if with_paths else []
        active = marked.where("fate = 0").select(
            "n", F.coalesce("np", "p").alias("p"), (F.col("w") + F.coalesce("nw", F.lit(0))).alias("w"),
            F.when(F.col("nm").isNull(), F.col("m")).otherwise(F.least("m", "nm")).alias("m"), *seg)
    path = scratch(spark)
    start = roots.select(F.col("n").alias("node_id"), F.col("n").alias("root_id"), F.lit(0).cast("long").alias("depth"), F.array("n").alias("path"))
    ring = loops.select(F.col("n").alias("node_id"), F.col("m").alias("root_id"), F.lit(-1).cast("long").alias("depth"), F.lit(None).cast("array<string>").alias("path"))
    start.unionByName(ring).write.parquet(f"{path}/part=0")
    for i, gone in enumerate(reversed(removed), 1):
        known = spark.read.schema(SCHEMA).parquet(*[f"{path}/part={j}" for j in range(i)])
        g = gone.join(known, gone["p"] == known["node_id"])
        below = F.col("depth") < 0
        grown = F.concat("path", F.reverse("seg"), F.array("n")) if with_paths else F.lit(None).cast("array<string>")
        g.select(
            F.col("n").alias("node_id"), "root_id",
            F.when(below, F.lit(-1)).otherwise(F.col("depth") + F.col("w")).cast("long").alias("depth"),
            F.when(~below, grown).alias("path"),
        ).write.parquet(f"{path}/part={i}")
    out = spark.read.schema(SCHEMA).parquet(*[f"{path}/part={j}" for j in range(len(removed) + 1)])
    return out if with_paths else out.drop("path")


def _marked(active: DataFrame, k: int) -> DataFrame:
    """``active`` with ``fate``: 1 raked, 2 spliced out, 0 stays; np, nw, nm (and nseg): what a node takes over from a spliced parent."""
    kids = active.groupBy(F.col("p").alias("n")).agg(F.count("*").alias("c"), F.min(F.col("n")).alias("kid"))
    b = active.join(kids, "n", "left").withColumn("c", F.coalesce("c", F.lit(0))).withColumn(
        "h", F.struct(F.xxhash64(F.lit(k), "n"), "n")).withColumn("chain", (F.col("c") == 1) & (F.col("n") != F.col("p")))
    up = b.select(F.col("n").alias("p"), F.col("chain").alias("pchain"), F.col("h").alias("ph"))
    down = b.select(F.col("n").alias("kid"), F.col("c").alias("kc"), F.col("chain").alias("kchain"), F.col("h").alias("kh"))
    s = b.join(up, "p", "left").join(down, "kid", "left")
    top = (~F.coalesce("pchain", F.lit(False)) | (F.col("h") > F.col("ph"))) & (~F.coalesce("kchain", F.lit(False)) | (F.col("h") > F.col("kh")))
    s = s.withColumn("fate", F.when(F.col("c") == 0, 1).when(F.col("chain") & (F.col("kc") > 0) & top, 2).otherwise(0))
    cols = [c for c in active.columns]
    s = s.select(*cols, "fate")
    out = s.where("fate = 2").select(F.col("n").alias("p"), F.col("p").alias("np"), F.col("w").alias("nw"), F.col("m").alias("nm"), *([F.col("seg").alias("nseg")] if "seg" in cols else []))
    return s.join(out, "p", "left").select(*cols, "fate", *[c for c in out.columns if c != "p"])


def several_parents(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """Nodes that name more than one parent: ``node_id, parents`` (sorted)."""
    return (
        edges.where(F.col(child).isNotNull() & F.col(parent).isNotNull())
        .groupBy(F.col(child).alias("node_id")).agg(F.sort_array(F.collect_set(parent)).alias("parents"))
        .where(F.size("parents") > 1)
    )


def descendants(nodes: DataFrame) -> DataFrame:
    """All pairs ``ancestor_id, node_id, distance`` (distance 1 and more) from ``hierarchy(..., with_paths=True)``."""
    return (
        nodes.where("depth > 0").select("node_id", F.posexplode(F.reverse("path")).alias("distance", "ancestor_id"))
        .where("distance > 0").select("ancestor_id", "node_id", F.col("distance").cast("long").alias("distance"))
    )


# Relation types that make one end part, member, subordinate or kind of the other,
# written lower case without blanks, hyphens and underscores.
UP = ("属于", "隶属于", "子类于", "上级为", "partof", "isa", "memberof", "subordinateto", "kindof", "subclassof", "belongsto")
DOWN = ("包含", "下辖", "分为", "下级为", "haspart", "contains", "hasmember", "includes")


def hierarchy_edges(relations: DataFrame, entities: DataFrame, up: tuple[str, ...] = UP, down: tuple[str, ...] = DOWN) -> DataFrame:
    """``child, parent`` of the relations in force whose type is hierarchical and whose ends exist; ids as in ``entities``."""
    kind = F.lower(F.regexp_replace("type", r"[\s_\-]+", ""))
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")))
    r = (
        relations.where(F.col("deprecated_at").isNull())
        .select(kind.alias("k"), key("source_entity").alias("s"), key("target_entity").alias("t"))
        .where(F.col("k").isin(*up, *down))
        .select(F.when(F.col("k").isin(*up), F.col("s")).otherwise(F.col("t")).alias("a"), F.when(F.col("k").isin(*up), F.col("t")).otherwise(F.col("s")).alias("b"))
        .distinct()
    )
    ids = entities.where("id is not null").groupBy(key("id").alias("k")).agg(F.min("id").alias("id"))
    return (
        r.join(ids.select(F.col("k").alias("a"), F.col("id").alias("child")), "a")
        .join(ids.select(F.col("k").alias("b"), F.col("id").alias("parent")), "b")
        .select("child", "parent")
    )


