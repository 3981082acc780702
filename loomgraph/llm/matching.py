"""Orders and shipments matched to entity records without a common key.

Writings of all sources are clustered into companies (see ``names``). Each
distinct writing, with its class and place of delivery, is compared with every
company of a similar sound; two Gaussian mixtures with regularised covariances
separate the similarity vectors of matched and unmatched pairs without labels.
Every expectation step is taken under transitivity: two companies that are not
one another can't both be a writing's, so a writing is one of its companies or
none, and the posteriors of its companies share what is left of 1. Orders,
shipments and entity records that are one company's are each other's by that
company, so no triangle of them stays open. The posteriors given out are those
of the last such step; no rule beside the mixtures decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .cn import folded
from .names import MISSING, brand_similarity, cluster_names, learn_places, records_of_entities, records_of_names
from .parse_names import Places

FEATURES = ("f_sound", "f_city", "f_trade", "f_class", "f_place", "f_form")


def city_in(address: str | None, places: Places) -> str:
    """The first city a delivery address names, in characters or letters."""
    if not address:
        return ""
    t = "".join(folded(address).split())
    at = [(t.find(c), c) for c in places.cities if c in t]
    if at:
        return min(at)[1]
    for w in reversed([x.strip().lower() for x in address.split(",")]):
        if w in places.latin:
            return places.latin[w][0]
    return ""


def sources(orders: DataFrame, shipments: DataFrame, places: Places) -> DataFrame:
    """Rows that name a company: ``src_table, src_key, key, klass, hint``; repeated rows once."""
    named = lambda c: F.col(c).isNotNull() & ~F.trim(F.regexp_replace(c, "\\s+", "")).isin(*MISSING)
    o = orders.where(F.col("订单号").isNotNull() & named("供应商")).select(F.col("订单号").alias("src_key"), F.col("供应商").alias("key"), F.coalesce("供应商类别", F.lit("")).alias("klass")).distinct()
    o = o.select(F.lit("purchase_orders").alias("src_table"), "src_key", "key", "klass", F.lit("").alias("hint"))
    s = shipments.where(F.col("发货单号").isNotNull() & named("客户名称")).select(F.col("发货单号").alias("src_key"), F.col("客户名称").alias("key"), F.coalesce("客户类型", F.lit("")).alias("klass"), F.col("收货地址").alias("a")).distinct()

    def place(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str | None, str] = {}
        for pdf in it:
            if len(seen) > 200_000:
                seen.clear()
            h = []
            for a in pdf["a"]:
                if a not in seen:
                    seen[a] = city_in(a, places)
                h.append(seen[a])
            yield pd.DataFrame({"src_table": "logistics_fulfillment", "src_key": pdf["src_key"], "key": pdf["key"], "klass": pdf["klass"], "hint": h})

    return o.unionByName(s.mapInPandas(place, "src_table string, src_key string, key string, klass string, hint string"))


def start(x: np.ndarray) -> np.ndarray:
    """A first guess of the posteriors of similarity vectors: steeply rising with the mean of the similarities that say anything, 0.5 being said of what is missing."""
    known = x != 0.5
    m = np.where(known, x, 0).sum(axis=1) / np.maximum(known.sum(axis=1), 1)
    return np.clip((m - m.min()) / max(m.max() - m.min(), 1e-9), 0.02, 0.98) ** 4


def fit_mixture(x: np.ndarray, n: np.ndarray, g: np.ndarray, ridge: float, prior: np.ndarray | None = None, weight: float = 20.0, spread: float = 0.1) -> np.ndarray:
    """One maximisation: the log likelihood ratio of match and non-match of every vector, from its counts ``n`` and matched counts ``g``.

    The covariances are regularised: ``ridge`` and a part of the squared
    distance of the two means are added to the diagonal, the more the clearer
    a feature separates. Given ``prior`` posteriors, both components have a
    conjugate prior worth ``weight`` pairs, which lie where these posteriors
    put them and vary by ``spread`` in every feature, so that few pairs don't
    overfit; among many it doesn't count.
    """
    k = 0.0 if prior is None else weight
    prior = np.full(len(n), 0.5) if prior is None else prior
    ws = []
    for w, q in ((g, prior * n), (n - g, (1 - prior) * n)):
        ws.append(w + k * q / max(q.sum(), 1e-9))
    means = [(w[:, None] * x).sum(0) / w.sum() for w in ws]
    between = 0.05 * (means[0] - means[1]) ** 2
    out = []
    for w, mean in zip(ws, means):
        d = x - mean
        cov = (w[:, None] * d).T @ d / w.sum() + np.diag(ridge + between + k * spread / w.sum())
        _, det = np.linalg.slogdet(cov)
        out.append(-0.5 * det - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    return np.clip(out[0] - out[1], -50, 50)


def one_or_none(odds: np.ndarray, at: np.ndarray, n: np.ndarray, none: float) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of the companies of writings, and of none, each writing being one of its companies or none.

    ``odds`` are log likelihood ratios, ``at`` the writing of each and ``n``
    how many of the writing's companies have them; ``none`` is the share of
    writings without a company among theirs, the others may be each of theirs
    alike. The posteriors of one company each come back.
    """
    o = np.exp(odds) * ((1 - none) / np.bincount(at, n))[at]
    total = none + np.bincount(at, o * n)
    return o / total[at], none / total


def match_companies(orders: DataFrame, shipments: DataFrame, entities: DataFrame, tolerance: float = 1e-3, most_rounds: int = 100, ridge: float = 0.003) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that name companies, the company each writing is matched to with its posterior, and entity ids by company.

    Similarities are rounded to steps of 0.05, so that the mixtures are fitted
    to counts of distinct vectors, of which the grid allows few thousand,
    whatever the number of pairs; every pair counts. Writings with the same
    vectors count as one with its number, and the rounds run over these until
    no posterior moves by more than ``tolerance``; an error is raised if that
    takes more than ``most_rounds``. A writing is matched to the company whose
    posterior is above a half; one that fits several equally is matched to
    none. Rows without a name give no row; an id with several different rows
    gives what each of them gives.
    """
    spark = orders.sparkSession
    both_of = lambda df, *cs: df.select(F.explode(F.array(*cs)).alias("t"))
    texts = orders.select(F.col("供应商").alias("t")).unionByName(both_of(shipments, "客户名称", "收货地址")).unionByName(both_of(entities.where("canonical_id is null"), "name_cn", "description"))
    places = learn_places(texts)
    src = cut(sources(orders, shipments, places))
    group = cut(src.groupBy("src_table", "key", "klass", "hint").agg(F.count("*").alias("n")))
    best_class = cut(group.groupBy("src_table", "key", "klass").agg(F.sum("n").alias("n")).groupBy("src_table", "key").agg(F.sum("n").alias("n"), F.max_by("klass", F.when(F.col("klass") != "", F.col("n"))).alias("klass")))
    names = best_class.select(F.col("src_table").alias("tab"), "key", "n", "klass")
    ents = records_of_entities(entities, places).where("kind = 'org'")
    members, nodes, share, both = cluster_names(records_of_names(names, places).unionByName(ents), listed=True)
    members, nodes = cut(members), cut(nodes)
    # the left sides: distinct writings with what their rows say
    left = cut(group.join(members.select(F.col("tab").alias("src_table"), "key", "node"), ["src_table", "key"]).join(
        best_class.select("src_table", "key", F.col("klass").alias("usual")), ["src_table", "key"]).withColumn("klass", F.when(F.col("klass") == "", F.coalesce("usual", F.lit(""))).otherwise(F.col("klass")))
        .groupBy("node", "klass", "hint").agg(F.sum("n").alias("n")).withColumn("l", F.xxhash64("node", "klass", "hint")))
    a = nodes.select("node", F.col("letters").alias("a"), F.col("brand").alias("brand_l"), F.col("latin").alias("latin_l"), F.col("city").alias("city_l"), F.col("trade").alias("trade_l"), F.col("form").alias("form_l"))
    c = nodes.where("node = center and not torn").select(F.col("node").alias("c"), F.col("letters").alias("b"), F.col("brand").alias("brand_c"), F.col("latin").alias("latin_c"), F.col("city").alias("city_c"), F.col("trade").alias("trade_c"), F.col("form").alias("form_c"))
    # what a company's satellites add to its centre: missing city or trade
    extra = nodes.where("node != center").groupBy(F.col("center").alias("c")).agg(F.max("city").alias("xc"), F.max("trade").alias("xt"))
    c = c.join(extra, "c", "left").withColumn("city_c", F.when(F.col("city_c") == "", F.coalesce("xc", F.lit(""))).otherwise(F.col("city_c"))).withColumn(
        "trade_c", F.when(F.col("trade_c") == "", F.coalesce("xt", F.lit(""))).otherwise(F.col("trade_c"))).drop("xc", "xt")
    sym = both.unionByName(both.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    agree = lambda x, y: F.when((F.col(x) == "") | (F.col(y) == ""), 0.5).otherwise((F.col(x) == F.col(y)).cast("double"))
    # the plain form stands for any of the longer ones
    form = F.when((F.col("form_l") != F.col("form_c")) & (F.lit("有限公司").isin(F.col("form_l"), F.col("form_c"))), 0.5).otherwise(agree("form_l", "form_c"))
    near_c = a.join(sym, "a").join(c, "b").select("node", "c", "brand_l", "latin_l", "brand_c", "latin_c", "city_c", "trade_c", agree("city_l", "city_c").alias("f_city"), agree("trade_l", "trade_c").alias("f_trade"), form.alias("f_form"))

    def sound(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pdf["f_sound"] = [brand_similarity(x, lx, y, ly) for x, lx, y, ly in zip(pdf["brand_l"], pdf["latin_l"], pdf["brand_c"], pdf["latin_c"])]
            yield pdf.drop(columns=["brand_l", "latin_l", "brand_c", "latin_c"])

    p = near_c.mapInPandas(sound, "node long, c long, city_c string, trade_c string, f_city double, f_trade double, f_form double, f_sound double")
    p = p.join(left, "node").join(share.select(F.col("trade").alias("trade_c"), "klass", "p"), ["trade_c", "klass"], "left")
    pairs = cut(p.select(
        "l", "c", F.round(F.col("f_sound") * 20).cast("int").alias("f_sound"),
        *[F.round(x * 20).cast("int").alias(k) for k, x in (
            ("f_city", F.col("f_city")), ("f_trade", F.col("f_trade")),
            ("f_class", F.when((F.col("klass") == "") | (F.col("trade_c") == ""), 0.5).otherwise(F.least(F.lit(1.0), F.coalesce("p", F.lit(0.0)) * 2))),
            ("f_place", agree("hint", "city_c")), ("f_form", F.col("f_form")))]))
    grid = pairs.groupBy(*FEATURES).agg(F.count("*").alias("n")).toPandas().sort_values(list(FEATURES), ignore_index=True)
    matched = spark.createDataFrame([], "l long, c long, posterior double")
    if len(grid):
        odds, none = converged(pairs, grid, tolerance, most_rounds, ridge)
        table = spark.createDataFrame(pa.Table.from_pandas(grid[list(FEATURES)].assign(odds=odds), preserve_index=False))
        best = pairs.join(F.broadcast(table), list(FEATURES)).groupBy("l").agg(F.max_by("c", F.struct("odds", "c")).alias("c"), F.max("odds").alias("odds"), F.sum(F.exp("odds")).alias("all"), F.count("*").alias("k"))
        matched = best.select("l", "c", (F.exp("odds") / (none / (1 - none) * F.col("k") + F.col("all"))).alias("posterior")).where("posterior > 0.5")
    one = members.select(F.col("tab").alias("src_table"), "key", "node").join(best_class.select("src_table", "key", F.col("klass").alias("usual")), ["src_table", "key"])
    rows = src.join(one, ["src_table", "key"]).withColumn("klass", F.when(F.col("klass") == "", F.coalesce("usual", F.lit(""))).otherwise(F.col("klass"))).select("src_table", "src_key", F.xxhash64("node", "klass", "hint").alias("l"))
    ids = members.where("tab = 'entities'").join(nodes.select("node", "center"), "node").select(F.col("center").alias("c"), F.col("key").alias("entity_id")).distinct()
    return rows, matched, ids


def converged(pairs: DataFrame, grid: pd.DataFrame, tolerance: float, most_rounds: int, ridge: float, least_none: float = 0.01) -> tuple[np.ndarray, float]:
    """Log likelihood ratios of the vectors of ``grid`` and the share of writings without a company, when the rounds have come to rest.

    That share is estimated like the mixtures, but not below ``least_none``.
    """
    spark = pairs.sparkSession
    x, n = grid[list(FEATURES)].to_numpy(dtype=float) / 20, grid["n"].to_numpy(dtype=float)
    ids = F.broadcast(spark.createDataFrame(pa.Table.from_pandas(grid[list(FEATURES)].assign(v=np.arange(len(grid))), preserve_index=False)))
    # what a writing's companies look like: vectors with their counts, at most as many as the grid has
    looks = pairs.join(ids, list(FEATURES)).groupBy("l", "v").agg(F.count("*").alias("k")).groupBy("l").agg(F.sort_array(F.collect_list(F.struct("v", "k"))).alias("looks"))
    looks = cut(looks.groupBy("looks").agg(F.count("*").alias("times")).select("looks.v", "looks.k", "times"))
    first = start(x)
    writings = looks.agg(F.sum("times")).first()[0]
    g, seen, none = first * n, None, 0.1
    for _ in range(most_rounds):
        odds = fit_mixture(x, n, g, ridge, first)

        def expect(it: Iterator[pd.DataFrame], odds=odds, none=none) -> Iterator[pd.DataFrame]:
            total, rest = np.zeros(len(odds)), 0.0
            for pdf in it:
                if len(pdf):
                    size, times = pdf["v"].map(len).to_numpy(), pdf["times"].to_numpy()
                    v, k = (np.concatenate(pdf[f].to_numpy()).astype(np.int64) for f in ("v", "k"))
                    one, no = one_or_none(odds[v], np.repeat(np.arange(len(pdf)), size), k, none)
                    total += np.bincount(v, one * k * np.repeat(times, size), len(odds))
                    rest += float((no * times).sum())
            at = np.flatnonzero(total)
            yield pd.DataFrame({"v": [*at, -1], "g": [*total[at], rest]})

        now = looks.mapInPandas(expect, "v long, g double").groupBy("v").agg(F.sum("g").alias("g")).toPandas()
        one = now[now["v"] >= 0]
        g = np.zeros(len(x))
        g[one["v"]] = np.minimum(one["g"], n[one["v"]])
        if seen is not None and np.abs(g / n - seen).max() <= tolerance:
            return odds, none
        none = max(least_none, now.loc[now["v"] < 0, "g"].sum() / writings)
        seen = g / n
    raise RuntimeError(f"mixtures not at rest after {most_rounds} rounds")


def company_records(orders: DataFrame, shipments: DataFrame, entities: DataFrame) -> DataFrame:
    """``src_table, src_key, entity_id, confidence``: the entity records of every order's supplier and every shipment's customer."""
    rows, matched, ids = match_companies(orders, shipments, entities)
    known = cut(matched.join(ids.select("c").distinct(), "c", "left_semi"))
    return rows.join(known, "l").join(ids, "c").select("src_table", "src_key", "entity_id", F.col("posterior").alias("confidence"))
