"""Writings of one delivery place, by a gazetteer built from the addresses themselves.

Addresses are taken apart (see ``parse_addresses``). Street spellings are
clustered within their locality: those that sound alike are one, and those a
letter apart in sound join the star of a more frequent one with which they
share house numbers. Each cluster is a street and gets an identifier; numbers
and units seen there become gazetteer entries. Every address is then resolved
by a beam search over the entries: localities that fit, street and number,
unit; parts that are left out fit anything. Addresses are joined on
identifier, number and unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, Window as W

from ..session import cut
from .names import MISSING, star_clusters
from .parse_addresses import Gazette, locality_words, parse_address, slipped_words, sound

PARTS = "addr string, prov string, city string, district string, sound string, kind string, number long, building long, room string"


def distinct_addresses(shipments: DataFrame, col: str = "收货地址") -> DataFrame:
    a = shipments.select(F.col(col).alias("addr")).where(F.col("addr").isNotNull() & ~F.trim(F.regexp_replace("addr", r"\s+", "")).isin(*MISSING))
    return a.distinct()


def learn_gazette(addresses: DataFrame, least: int = 1, most: int = 100_000) -> Gazette:
    """Provinces, cities and districts named in the addresses; as many rows as there are localities, and an error over ``most``."""

    def find(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            n: dict[tuple[str, str], int] = {}
            for a in pdf["addr"]:
                for k in locality_words(a):
                    n[k] = n.get(k, 0) + 1
            yield pd.DataFrame([(k, x, v) for (k, x), v in n.items()], columns=["k", "x", "n"])

    got = addresses.mapInPandas(find, "k string, x string, n long").groupBy("k", "x").agg(F.sum("n").alias("n"))
    rows = got.where(F.col("n") >= least).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} localities; give a gazetteer")
    counts = {k: {r.x: r.n for r in rows if r.k == k} for k in ("prov", "city", "dist")}
    slips = {k: slipped_words(c) for k, c in counts.items()}
    return Gazette(*[set(c) - set(slips[k]) for k, c in counts.items()], slips)


def taken_apart(addresses: DataFrame, g: Gazette) -> DataFrame:
    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for a in pdf["addr"]:
                r = parse_address(a, g)
                out.append((a, r["prov"], r["city"], r["district"], sound(r["street"]), r["kind"], r["number"], r["building"], r["room"]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PARTS.split(", ")]).astype({"number": "Int64", "building": "Int64"})

    return addresses.mapInPandas(parse, PARTS)


def streets(whole: DataFrame, rarer: int = 3) -> DataFrame:
    """``city, district, sound, kind, street_id``: the street that each spelling within a locality belongs to.

    Spellings one letter apart in sound, or with two letters swapped, are
    linked if they have a house number in common and one is at least
    ``rarer`` times as frequent as the other; they are looked up under their
    house number and the sound without one letter. Stars around the most
    frequent spellings are the streets.
    """
    at = ["city", "district", "sound", "kind"]
    node = F.xxhash64(*at)
    n = cut(whole.groupBy(*at, "number").agg(F.count("*").alias("n")).withColumn("node", node))
    nodes = n.groupBy(*at, "node").agg(F.sum("n").alias("n"))
    less = F.expr("transform(sequence(1, length(sound)), i -> concat(substring(sound, 1, i - 1), substring(sound, i + 1)))")
    keys = n.where(F.length("sound") >= 4).select("city", "district", "kind", "number", "node", "sound", F.explode(F.array_distinct(F.concat(less, F.array("sound")))).alias("key"))
    x, y = (keys.select("city", "district", "kind", "number", "key", F.col("node").alias(k), F.col("sound").alias(f"s{k}")) for k in "ab")
    pairs = x.join(y, ["city", "district", "kind", "number", "key"]).where((F.col("a") < F.col("b")) & (F.levenshtein("sa", "sb", 2) >= 0)).select("a", "b", "sa", "sb").distinct()
    swapped = (F.length("sa") == F.length("sb")) & (F.array_sort(F.split("sa", "")) == F.array_sort(F.split("sb", "")))
    pairs = pairs.where((F.levenshtein("sa", "sb") <= 1) | swapped)
    count = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"))
    links = pairs.join(count("a"), "a").join(count("b"), "b").where(F.greatest("na", "nb") >= rarer * F.least("na", "nb")).select("a", "b", F.lit(1.0).alias("sim"))
    sat, _ = star_clusters(nodes.select("node", F.floor(F.log2("n")).alias("rank")), cut(links))
    best = sat.join(nodes.select(F.col("node").alias("center"), "n"), "center").groupBy("node").agg(F.max_by("center", F.struct("n", "center")).alias("center"))
    return nodes.join(best, "node", "left").select(*at, F.coalesce("center", "node").alias("street_id"))


def resolved(parts: DataFrame, beam: int = 8) -> DataFrame:
    """``addr, street_id, number, building, room`` of every address; street_id null where no or no single entry fits and parts are missing.

    The beam holds the ``beam`` best localities of an address and all that are as good as the last of them.
    """
    whole = (F.col("city") != "") & (F.col("district") != "") & (F.col("sound") != "") & F.col("number").isNotNull()
    at = ["city", "district", "sound", "kind"]
    street = cut(streets(parts.where(whole)))
    placed = cut(parts.where(whole).join(street, at))
    entries = placed.groupBy(*at, "number", "street_id").agg(F.count("*").alias("w"))
    prov = parts.where("prov != '' and city != ''").groupBy("city", "prov").agg(F.count("*").alias("n")).groupBy("city").agg(F.max_by("prov", "n").alias("e_prov"))
    entries = cut(entries.join(prov, "city", "left").select(F.col("city").alias("e_city"), F.col("district").alias("e_district"), "e_prov", "sound", "kind", "number", "street_id"))
    units = placed.where("building is not null").select("street_id", "number", F.col("building").alias("u_building"), F.col("room").alias("u_room")).distinct()
    part = parts.where(~whole & (F.col("sound") != "") & F.col("number").isNotNull())
    fits = lambda x, y: (F.col(x) == "") | F.col(y).isNull() | (F.col(x) == F.col(y))
    first = part.join(entries, ["sound", "kind", "number"]).where(fits("city", "e_city") & fits("district", "e_district") & fits("prov", "e_prov"))
    known = F.col("e_prov").isNotNull() & (F.col("prov") == F.col("e_prov"))
    first = first.withColumn("score", (F.col("city") == F.col("e_city")).cast("int") * 4 + (F.col("district") == F.col("e_district")).cast("int") * 3 + known.cast("int") * 2)
    # spellings of one street that fit alike are one entry
    first = first.groupBy("addr", "street_id", "number", "building", "room").agg(F.max("score").alias("score"))
    first = first.withColumn("r", F.rank().over(W.partitionBy("addr").orderBy(F.desc("score")))).where(F.col("r") <= beam)
    u = first.join(units, ["street_id", "number"], "left").withColumn(
        "unit", F.when(F.col("building").isNull(), F.when((F.col("room") != "") & (F.col("room") == F.col("u_room")), 2).otherwise(0))
        .when(F.col("building") == F.col("u_building"), F.when((F.col("room") == "") | (F.col("room") == F.col("u_room")), 2).otherwise(1)).otherwise(0))
    second = u.groupBy("addr", "street_id", "number", "building", "room", "score").agg(F.max("unit").alias("unit"))
    total = F.col("score") * 10 + F.col("unit")
    w2 = W.partitionBy("addr").orderBy(total.desc())
    second = second.withColumn("r", F.row_number().over(w2)).withColumn("next", F.lead(total).over(w2)).withColumn("t", total).where("r = 1 and (next is null or t > next)")
    found = second.select("addr", "street_id", "number", "building", "room")
    own = placed.select("addr", "street_id", "number", "building", "room")
    # numbers that no whole address names: their writings are one place if the localities they name don't contradict each other
    rest = part.join(first.select("addr").distinct(), "addr", "left_anti")
    said = lambda c: F.when(F.col(c) != "", F.col(c))
    key = ["sound", "kind", "number"]
    agree = rest.groupBy(*key).agg(*[F.countDistinct(said(c)).alias(f"n_{c}") for c in ("city", "district", "prov")])
    alone = (F.col("n_city") <= 1) & (F.col("n_district") <= 1) & (F.col("n_prov") <= 1)
    rest = rest.join(agree, key).where(alone | (F.col("city") != "") | (F.col("district") != "")).select(
        "addr", F.when(alone, F.xxhash64("sound", "kind")).otherwise(F.xxhash64("prov", "city", "district", "sound", "kind")).alias("street_id"), "number", "building", "room")
    return own.unionByName(found).unionByName(rest)


def places(shipments: DataFrame, col: str = "收货地址") -> DataFrame:
    """``addr, place`` (street, number and unit as one key): the place each address denotes; addresses that fit several places are absent."""
    a = cut(distinct_addresses(shipments, col))
    parts = cut(taken_apart(a, learn_gazette(a)))
    r = cut(resolved(parts))
    at = ["street_id", "number"]
    buildings = r.where("building is not null").groupBy(*at).agg(F.countDistinct("building").alias("nb"), F.min("building").alias("b1"))
    by_room = r.where("building is not null and room != ''").groupBy(*at, "room").agg(F.countDistinct("building").alias("nbr"), F.min("building").alias("b2"))
    x = r.join(buildings, at, "left").join(by_room, [*at, "room"], "left")
    b = F.coalesce("building", F.when((F.col("room") != "") & (F.col("nbr") == 1), F.col("b2")).when((F.col("nb") == 1) & F.coalesce(F.col("nbr") <= 1, F.lit(True)), F.col("b1")))
    x = x.withColumn("bld", b).where(F.col("bld").isNotNull() | F.col("nb").isNull()).select("addr", *at, F.coalesce("bld", F.lit(-1).cast("long")).alias("bld"), "room")
    rooms = x.where("room != ''").groupBy(*at, "bld").agg(F.countDistinct("room").alias("nr"), F.min("room").alias("r1"))
    x = x.join(rooms, [*at, "bld"], "left").where((F.col("room") != "") | F.col("nr").isNull() | (F.col("nr") == 1))
    return x.select("addr", F.concat_ws("/", F.col("street_id").cast("string"), F.col("number").cast("string"), F.col("bld").cast("string"), F.when(F.col("room") != "", F.col("room")).otherwise(F.coalesce("r1", F.lit("")))).alias("place"))


def same_places(shipments: DataFrame, col: str = "收货地址") -> DataFrame:
    """``addr_a, addr_b`` of every two writings that denote the same place.

    Null, empty and dash addresses denote none and give no row; repeated rows
    count once; texts without a street or number are linked to nothing.
    """
    p = cut(places(shipments, col))  # the same result with one row per writing
    return p.alias("x").join(p.alias("y"), "place").where("x.addr < y.addr").select(F.col("x.addr").alias("addr_a"), F.col("y.addr").alias("addr_b"))
