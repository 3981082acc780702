"""Keyword and vector search, hybrid ranking, recall, resolution."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions.columns import folded_key
from ..session import scratch


def keyword_search(df: DataFrame, cols: list[str], query: str) -> DataFrame:
    """Rows any of whose columns holds the query, case aside."""
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(F.lower(F.col(c).cast("string")).contains(query.lower()), F.lit(False))
    return df.where(cond)


def unit(c: str) -> Column:
    norm = F.sqrt(F.aggregate(F.col(c), F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(F.col(c), lambda x: x.cast("double") / norm)


def cosine(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: x * y), F.lit(0.0).cast("double"), lambda s, x: s + x)


def vector_topk(vectors: DataFrame, vec_id: str, vec: str, query: list[float], k: int = 10, where: Column | None = None) -> DataFrame:
    """The ``k`` vectors most like one query: ``id, score`` with ties in the order of ids; a scan and a top-k, nothing is shuffled."""
    v = vectors if where is None else vectors.where(where)
    n = sum(x * x for x in query) ** 0.5
    q = F.array(*[F.lit(float(x) / n) for x in query])
    u = v.where(F.size(vec) == len(query)).select(F.col(vec_id).alias("id"), unit(vec).alias("u")).withColumn("q", q)
    return u.select("id", F.round(cosine("u", "q"), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def nearest_in_bulk(vectors: DataFrame, vec_id: str, vec: str, queries: DataFrame, k: int = 10, block: int = 1000) -> DataFrame:
    """The ``k`` nearest of all vectors to every query: ``query_id, id, rank, score``; the query itself left out.

    Queries are streamed to the driver in blocks, each multiplied with every
    batch of vectors as a matrix; a task keeps k candidates per query, the
    rest is one aggregate. Results of a block are written before the next.
    """
    import numpy as np

    spark = vectors.sparkSession
    base = scratch(spark)
    data = vectors.where(F.col(vec).isNotNull()).select(F.col(vec_id).cast("long").alias("i"), F.col(vec).alias("v"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    rows = queries.select(F.col(vec_id).alias("i"), F.col(vec).alias("v")).where("v is not null").toLocalIterator()
    n = 0
    while chunk := list(islice(rows, block)):
        ids = np.array([r.i for r in chunk])
        q = np.array([r.v for r in chunk], dtype=np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)

        def score(it: Iterator[pd.DataFrame], ids=ids, q=q) -> Iterator[pd.DataFrame]:
            for pdf in it:
                m = np.stack(pdf["v"].to_numpy()).astype(np.float64)
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                s, own = q @ m.T, pdf["i"].to_numpy()
                s[ids[:, None] == own[None, :]] = -2.0
                c = min(k, s.shape[1])
                top = np.argpartition(-s, c - 1, axis=1)[:, :c]
                r = np.repeat(np.arange(len(ids)), c)
                yield pd.DataFrame({"query_id": ids[r], "id": own[top.ravel()], "score": s[r, top.ravel()]})

        part = data.mapInPandas(score, "query_id long, id long, score double").where("score > -1.5")
        part = part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        part.select("query_id", "id", "rank", F.round("score", 6).alias("score")).write.parquet(f"{base}/block={n}")
        n += 1
    schema = "query_id long, id long, rank int, score double"
    return spark.read.schema(schema).parquet(*[f"{base}/block={i}" for i in range(n)]) if n else spark.createDataFrame([], schema)


def lexical_scores(df: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """``key, lexical``: occurrences of the query's words, scaled between the least and the most of all hits."""
    t = F.lower(text)
    hits = sum(((F.length(t) - F.length(F.replace(t, F.lit(w.lower()), F.lit("")))) / len(w)).cast("int") for w in words)
    x = df.select(F.col(key).alias("key"), hits.alias("n")).where("n > 0")
    ends = x.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("n") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    return x.join(F.broadcast(ends)).select("key", F.round(scaled, 6).alias("lexical"))


def hybrid_score(semantic: Column, lexical: Column, confidence: Column, recency: Column, source: Column) -> Column:
    """Weighted score: with a similarity all five parts, without one the other four, null if nothing matches."""
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    both = 0.50 * (semantic + 1) / 2 + 0.20 * lexical + 0.15 * conf + 0.10 * recency + 0.05 * source
    words = F.when(lexical > 0, 0.40 * lexical + 0.30 * conf + 0.20 * recency + 0.10 * source)
    return F.when(semantic.isNotNull(), both).otherwise(words)


def diverse_picks(scored: DataFrame, group: str, count: int = 5, budget: int = 1000, pool: int = 100) -> DataFrame:
    """Per group up to ``count`` picks ``id, pick`` within a token budget, each as good and as unlike the earlier ones as can be.

    ``scored`` has ``id, score, cosine`` (null without a similarity) and
    ``tokens``. Recall is a top-k feature: the choice is made among the
    ``pool`` best of a group that fit the budget at all. A pick is worth three
    quarters of its score less a quarter of its nearness to the nearest
    earlier pick; what no longer fits the budget is out, so ``count`` folds
    over the pool, held as one array, make the choice.
    """
    w = W.partitionBy(group).orderBy(F.desc("score"), "id")
    best = scored.where(F.col("tokens") <= budget).withColumn("r", F.row_number().over(w)).where(F.col("r") <= pool)
    item = F.struct(F.col("score").cast("double").alias("score"), (-F.col("r")).alias("r"), F.col("id"), F.when(~F.isnan(F.col("cosine").cast("double")), F.col("cosine").cast("double")).alias("cosine"), F.col("tokens").cast("long").alias("tokens"))
    pools = best.groupBy(group).agg(F.collect_list(item).alias("pool"))
    state = lambda left, out: F.struct(left.alias("left"), out.alias("out"))
    kind = dict(pools.dtypes)["pool"]

    def worth(c: Column, out: Column) -> Column:
        near = F.array_max(F.transform(F.filter(out, lambda p: p["cosine"].isNotNull()), lambda p: 1 - F.abs(c["cosine"] - p["cosine"])))
        return F.when(c["cosine"].isNull(), c["score"]).otherwise(0.75 * c["score"] - 0.25 * F.coalesce(near, F.lit(0.0)))

    def step(s: Column, _: Column) -> Column:
        fits = F.filter("pool", lambda c: (c["tokens"] <= s["left"]) & ~F.exists(s["out"], lambda p: p["r"] == c["r"]))
        top = F.array_max(F.transform(fits, lambda c: F.struct(worth(c, s["out"]).alias("w"), c.alias("c"))))["c"]
        return F.when(top.isNull(), s).otherwise(state(s["left"] - top["tokens"], F.concat(s["out"], F.array(top))))

    picks = F.aggregate(F.sequence(F.lit(1), F.lit(count)), state(F.lit(budget).cast("long"), F.array().cast(kind)), step, lambda s: s["out"])
    return pools.select(group, F.posexplode(picks).alias("i", "p")).select(group, F.col("p")["id"].alias("id"), (F.col("i") + 1).cast("long").alias("pick"))


def similar_pairs(df: DataFrame, key: str, text: str, block: str, least: float = 0.85) -> DataFrame:
    """``a, b, ratio`` of texts in one block whose edit ratio reaches ``least``.

    A pair that close has lengths within ``1 - least`` of one another, so
    blocks are cut further by length bands of one third, each text meeting its
    own and the next band; equal texts are compared once per distinct text.
    """
    t = df.where(F.col(text).isNotNull()).select(F.col(block).alias("blk"), F.col(text).alias("t"), F.col(key).alias("k"))
    d = t.select("blk", "t").distinct().withColumn("len", F.length("t")).withColumn("band", F.floor(F.log(F.greatest("len", F.lit(1))) / F.log(F.lit(1 / least))))
    x = d.alias("x").join(d.select("blk", "t", "len", F.explode(F.array("band", F.col("band") + 1)).alias("band")).alias("y"), ["blk", "band"]).where(
        (F.col("x.t") != F.col("y.t")) & (F.least("x.len", "y.len") >= least * F.greatest("x.len", "y.len")))
    ratio = 1 - F.levenshtein("x.t", "y.t") / F.greatest("x.len", "y.len")
    p = x.select("blk", F.least("x.t", "y.t").alias("ta"), F.greatest("x.t", "y.t").alias("tb"), F.round(ratio, 6).alias("ratio")).where(F.col("ratio") >= least).distinct()
    a = t.select("blk", F.col("t").alias("ta"), F.col("k").alias("ka"))
    b = t.select("blk", F.col("t").alias("tb"), F.col("k").alias("kb"))
    return p.join(a, ["blk", "ta"]).join(b, ["blk", "tb"]).select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "ratio").distinct()


def resolve_aliases(df: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """Names replaced by the one their alias stands for; ``aliases`` has ``alias, canonical``."""
    a = aliases.select(F.col("alias").alias("__a"), F.col("canonical").alias("__c")).dropDuplicates(["__a"])
    return df.join(a, df[name] == a["__a"], "left").withColumn(name, F.coalesce("__c", name)).drop("__a", "__c")


def resolution_plan(orphans: DataFrame, anchors: DataFrame, name: str, auto: float = 0.95, review: float = 0.85) -> DataFrame:
    """``name, anchor, score, action``: merge with an anchor of the same key, review a close one, else skip."""
    o = orphans.select(F.col(name).alias("name"), folded_key(name).alias("k")).where("k != ''").distinct()
    a = anchors.select(F.col(name).alias("anchor"), folded_key(name).alias("ak")).where("ak != ''").distinct()
    same = o.join(a, o["k"] == a["ak"]).select("name", "anchor", F.lit(1.0).alias("score"))
    rest = o.join(same.select("name"), "name", "left_anti")
    # a close key keeps one of d + 1 pieces whole, d being the most edits its length allows; pieces are looked up by their first q characters
    most = lambda n: int((1 - review) / review * n + 1e-9)
    q = min((n // (most(n) + 1) for n in range(1, 1000) if most(n)), default=1)
    fits = F.least(F.length("k"), F.length("ak")) >= review * F.greatest(F.length("k"), F.length("ak"))
    if q:
        d = F.floor((1 - review) / review * F.length("k") + 1e-9).cast("int")
        x = rest.withColumn("d", d).where("d > 0").withColumn("p", F.explode(F.expr(f"transform(sequence(0, d), i -> substring(k, cast(floor(i * length(k) / (d + 1)) as int) + 1, {q}))")))
        y = a.where(F.length("ak") >= q).withColumn("p", F.explode(F.expr(f"transform(sequence(1, length(ak) - {q - 1}), i -> substring(ak, i, {q}))")))
        near = x.join(y, "p").where(fits).select("name", "k", "anchor", "ak").distinct()
    else:  # so many edits that no piece need be left
        near = rest.join(a, fits)
    near = near.select("name", "anchor", (1 - F.levenshtein("k", "ak") / F.greatest(F.length("k"), F.length("ak"))).alias("score")).where(F.col("score") >= review)
    best = same.unionByName(near).groupBy("name").agg(F.max_by(F.struct("anchor", "score"), F.struct("score", "anchor")).alias("b")).select("name", "b.*")
    action = F.when(F.col("score") >= auto, "merge").when(F.col("score") >= review, "review").otherwise("skip")
    return o.select("name").distinct().join(best, "name", "left").select("name", "anchor", F.round("score", 6).alias("score"), action.alias("action"))


def f1(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of one set of keys against another."""
    e, f = expected.select(*keys).distinct(), found.select(*keys).distinct()
    hit = e.join(f, keys, "left_semi").agg(F.count("*").alias("hit"))
    x = e.agg(F.count("*").alias("e")).join(F.broadcast(f.agg(F.count("*").alias("f")))).join(F.broadcast(hit))
    p, r = F.when(F.col("f") > 0, F.col("hit") / F.col("f")).otherwise(0.0), F.when(F.col("e") > 0, F.col("hit") / F.col("e")).otherwise(0.0)
    return x.select(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))
