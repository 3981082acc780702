"""Variant spellings of organisations and persons: MinHash banding, Monge-Elkan, star clustering.

Writings are taken apart first (see ``parse_names``), so that equal writings,
scripts, widths, orders and legal forms fall together before anything is
compared. MinHash runs over the padded q-grams of the sound of the brand or
surname; the number of bands and rows comes from the collision curve. Nodes
(sound, city, trade) whose parts don't contradict each other are verified by
Monge-Elkan similarity; star clustering makes the best documented nodes
centres and attaches the others to the one centre they fit.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, Window as W

from ..session import cut
from .cn import near, pinyin, plain_sound, same_sound, sound_class, sounds
from .parse_names import Places, letters, parse_org, parse_person, places_of, properties_of, unknown_words

MISSING = ("", "—", "-", "–")
ORG_TYPES = ("企业", "组织", "供应商", "客户")
PERSON_TYPES = ("人员",)
#: Readings of one brand up to which they are listed singly.
LISTED = 256
REC = ("tab string, key string, kind string, brand string, letters string, latin boolean, city string, trade string, klass string, form string, own_city boolean, n long")


def tune(similarity: float, recall: float, most: int = 512) -> tuple[int, int]:
    """Bands and rows whose collision curve 1-(1-s^r)^b reaches ``recall`` at ``similarity``; the steepest with ``most`` hashes at most."""
    best = (most, 1)
    for r in range(1, 17):
        b = math.ceil(math.log(1 - recall) / math.log(1 - similarity**r))
        if b * r <= most:
            best = (b, r)
    return best


def qgrams(s: str, q: int = 2) -> set[str]:
    p = "#" * (q - 1) + s + "#" * (q - 1)
    return {p[i:i + q] for i in range(len(p) - q + 1)}


def slipped_similarity(length: int, q: int = 2) -> float:
    """The least similarity of the padded q-grams of two words, the longer of ``length`` letters, one slip apart.

    Of the ``length + q - 1`` q-grams a wrong letter changes q, two swapped
    ones q + 1; a missing one changes fewer.
    """
    n = length + q - 1
    return max(0.05, (n - q - 1) / (n + q + 1))


def minhash_pairs(keys: DataFrame, similarity: float | None = 0.4, recall: float = 0.98, seed: int = 7) -> DataFrame:
    """Candidate pairs ``a, b`` (a < b) of the strings in column ``s``.

    Each distinct string is looked up once, against all; a column ``kind``
    keeps strings of different kinds apart. Without a ``similarity`` strings
    are looked up for one slip: with those of their own length and one letter
    more or less, with bands and rows tuned for the similarity one slip leaves
    in words of that length.
    """
    plans: dict[int, tuple] = {}

    def plan(length: int) -> tuple:
        if length not in plans:
            bands, rows = tune(similarity or slipped_similarity(length), recall)
            rng = np.random.default_rng(seed)
            draw = lambda n: rng.integers(1, 2**61, n, dtype=np.uint64) | np.uint64(1)
            plans[length] = (bands, rows, draw(bands * rows), draw(bands * rows), draw(rows), np.arange(bands, dtype=np.uint64))
        return plans[length]

    def sign(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        code: dict[str, int] = {}
        for pdf in it:
            hs, ns, ss = [], [], pdf["s"].to_numpy()
            for s, kind in zip(ss, pdf["kind"]):
                v = np.array([code.setdefault(x, xxhash.xxh64_intdigest(x)) for x in qgrams(s)], dtype=np.uint64)[:, None]
                n = 0
                for length in [0] if similarity else [len(s), len(s) + 1]:
                    bands, rows, mul, add, mix, band = plan(length)
                    h = ((v * mul + add) >> np.uint64(20)).min(axis=0).reshape(bands, rows)
                    h = (h * mix).sum(axis=1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + band * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(xxhash.xxh64_intdigest(f"{kind} {length}"))
                    hs.append(((h ^ (h >> np.uint64(31))) >> np.uint64(1)).astype(np.int64))
                    n += bands
                ns.append(n)
            yield pd.DataFrame({"s": np.repeat(ss, ns), "h": np.concatenate(hs) if hs else np.zeros(0, dtype=np.int64)})

    if "kind" not in keys.columns:
        keys = keys.withColumn("kind", F.lit(""))
    m = cut(keys.select("s", "kind").distinct().repartition(keys.sparkSession.sparkContext.defaultParallelism).mapInPandas(sign, "s string, h long"))
    x, y = m.select(F.col("s").alias("a"), "h"), m.select(F.col("s").alias("b"), "h")
    return x.join(y, "h").where("a < b").select("a", "b").distinct()


def sound_keys(brand: str, latin: bool, text: str) -> set[str]:
    """Keys under which a brand's sound is looked up exactly, without the differences of close sounds.

    Brands in characters meet under their sound classes in any order, and with
    brands in letters under each of their readings. Where characters of
    several readings are so many that their readings can't be listed, only the
    usual one is: slipped and other writings in letters are then left to
    MinHash, as all are. Syllables are folded before they are joined, for
    ``ping an`` and ``pin an`` are close though a vowel follows; letters may be
    divided either way.
    """
    out = {""}
    if latin:
        for part in re.split(r"((?<=[aei]n)g(?=[aeiou]))", plain_sound(text)):
            out = {o + r for o in out for r in ({"", "g"} if part == "g" else {part})}
        return out
    every = [sorted({plain_sound(r) for r in sounds(c)}) if "一" <= c <= "鿿" else [c.lower()] for c in brand]
    if math.prod(map(len, every)) > LISTED:
        every = [[plain_sound(pinyin(c))] for c in brand]
    return {plain_sound("".join(r)) for r in itertools.product(*every)} | {"/" + "/".join(sorted(map(sound_class, brand)))}


def slip_keys(brand: str, latin: bool, text: str) -> set[str]:
    """Keys under which a name meets, besides those of :func:`sound_keys`, every other that :func:`brand_similarity` can put at 0.9 or more.

    That is one slip: words one slip apart have a word in common that lacks at
    most one letter of either. Brands in characters have such words of each of
    their listed readings. Among brands in characters some may stand twice,
    and one character of four, or two of seven, be missing or of another sound;
    they meet under the sound classes of the others. Three such characters, in
    brands of ten or more, have no key.
    """
    words = {text}
    if not latin and brand:
        every = [sorted(sounds(c)) if "一" <= c <= "鿿" else [c.lower()] for c in brand]
        if math.prod(map(len, every)) <= LISTED:
            words |= {"".join(r) for r in itertools.product(*every)}
    out = {"~" + w[:i] + w[i + 1:] for w in words for i in range(len(w))} | {"~" + w for w in words}
    if not latin:
        classes = sorted(set(map(sound_class, brand)))
        for less in range(1 + (len(brand) >= 4) + (len(brand) >= 7)):
            out |= {"/" + "/".join(r) for r in itertools.combinations(classes, max(1, len(classes) - less))}
    return out


def learn_places(texts: DataFrame, least: int = 1, most: int = 100_000, heads: int = 8, share: float = 0.005) -> Places:
    """Cities, provinces and words for trades named in the column ``t``.

    A first pass learns the places that a wording marks as such. A second one
    over company names learns from what is left unexplained at their ends: an
    end behind ``heads`` different beginnings or more, and behind ``share`` of
    all names, is a trade unless a longer one accounts for it; a beginning
    before two or more brands that are known from other places is a city. The
    lexicon is bounded by the number of places and trades; over ``most`` words
    it raises.
    """
    texts = cut(texts.where("t is not null").select("t").distinct())

    def find(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            n: dict[tuple[str, str], int] = {}
            for t in pdf["t"]:
                c, p = places_of(t)
                for x in c:
                    n[("c", x)] = n.get(("c", x), 0) + 1
                for x in p:
                    n[("p", x)] = n.get(("p", x), 0) + 1
            yield pd.DataFrame([(k, x, v) for (k, x), v in n.items()], columns=["k", "x", "n"])

    def bounded(df: DataFrame) -> list:
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} places or trades; give a lexicon")
        return rows

    marked = bounded(texts.mapInPandas(find, "k string, x string, n long").groupBy("k", "x").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    known = Places({r.x for r in marked if r.k == "c"}, {r.x for r in marked if r.k == "p"})

    def ends(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame([x for t in pdf["t"] for x in unknown_words(t, known)], columns=["k", "w", "rest"])

    e = cut(texts.mapInPandas(ends, "k string, w string, rest string").groupBy("k", "w", "rest").agg(F.count("*").alias("n")))
    names = e.where("k = 'name'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("names"))
    trades = bounded(e.where("k = 'trade'").groupBy("w").agg(F.count("*").alias("n")).join(F.broadcast(names)).where((F.col("n") >= heads) & (F.col("n") >= F.col("names") * share)).select("w", "n"))
    brands = e.where("k = 'brand'").select(F.col("w").alias("rest")).distinct()
    cities = bounded(e.where("k = 'city'").select("w", "rest").join(brands, "rest", "left_semi").groupBy("w").agg(F.count("*").alias("n")).where("n >= 2").select("w"))
    new = {r.w for r in trades if not any(o.w.endswith(r.w) and len(o.w) > len(r.w) and o.n >= 0.6 * r.n for o in trades)}
    return Places(known.cities | {r.w for r in cities}, known.provinces, new)


def written(df: DataFrame, tab: str, name: str, klass: str | None) -> DataFrame:
    """Distinct writings of one column: ``tab, key, n, klass`` (the class most of its rows have)."""
    k = F.col(klass) if klass else F.lit(None).cast("string")
    x = df.select(F.col(name).alias("key"), k.alias("klass")).where(F.col("key").isNotNull() & ~F.trim("key").isin(*MISSING))
    x = x.groupBy("key", "klass").agg(F.count("*").alias("n"))
    return x.groupBy("key").agg(F.sum("n").alias("n"), F.max_by("klass", F.when(F.col("klass").isNotNull(), F.struct("n", "klass"))).alias("klass")).select(F.lit(tab).alias("tab"), "key", "n", "klass")


def records_of_names(names: DataFrame, places: Places) -> DataFrame:
    """Writings taken apart."""

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for tab, key, n, klass in zip(pdf["tab"], pdf["key"], pdf["n"], pdf["klass"]):
                r = parse_org(key, places)
                out.append((tab, key, "org", r["brand"], letters(r["brand"]), r["latin"], r["city"] or "", r["trade"] or "", klass or "", r["form"], bool(r["city"]), n))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in REC.split(", ")])

    return names.mapInPandas(parse, REC)


def records_of_entities(entities: DataFrame, places: Places) -> DataFrame:
    """Organisation and person records without canonical_id, each id once, taken apart; parts the name lacks come from the other fields."""
    one = entities.where("id is not null and canonical_id is null").select("id", "name_cn", "name_en", "name_abbr", "type", "description", "properties").groupBy("id").agg(
        F.min(F.struct("name_cn", "name_en", "name_abbr", "type", "description", "properties")).alias("r")).select("id", "r.*")
    one = one.where(F.col("type").isNull() | F.trim("type").isin(*ORG_TYPES, *PERSON_TYPES))

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for i, cn, en, ab, ty, de, pr in pdf[["id", "name_cn", "name_en", "name_abbr", "type", "description", "properties"]].itertuples(index=False):
                ty = (ty or "").strip()
                r = parse_org(cn, places)
                if ty in PERSON_TYPES or (not ty and not r["trade"] and not r["form"]):
                    first, last = parse_person(cn)
                    if not last or len(first) < 2:
                        f2, l2 = parse_person(en)
                        if l2 and (not first or f2.startswith(first)):
                            first, last = f2, l2
                    if last:
                        out.append((("entities", i, "person", first, last, True, "", "", "", "", False, 1)))
                    continue
                if not r["brand"]:
                    continue
                city, trade, klass = properties_of(pr, de, places)
                for other in (ab, en):
                    if not r["trade"] and other and len(other) > 3 and "-" not in other:
                        o = parse_org(other, places)
                        trade = trade or o["trade"]
                out.append(("entities", i, "org", r["brand"], letters(r["brand"]), r["latin"], r["city"] or city or "", r["trade"] or trade or "", klass, r["form"], bool(r["city"]), 1))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in REC.split(", ")])

    return one.mapInPandas(parse, REC)


def edits(a: str, b: str) -> int:
    """Letters missing, too many, wrong, or swapped with their neighbour between two words."""
    n, i = min(len(a), len(b)), 0
    while i < n and a[i] == b[i]:
        i += 1
    k = 0
    while k < n - i and a[-1 - k] == b[-1 - k]:
        k += 1
    a, b = a[i:len(a) - k], b[i:len(b) - k]
    if not a or not b:
        return len(a) or len(b)
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if last and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, last[j - 2] + 1)
            row.append(d)
    return row[-1]


def word_similarity(x: str, y: str) -> float:
    """Similarity of two words in letters, from 0 to 1; one slip in four letters or more leaves 0.95, each further one costs its share."""
    if x == y:
        return 1.0
    n = max(len(x), len(y))
    d = edits(x, y)
    return 0.95 if d == 1 and min(len(x), len(y)) >= 4 else max(0.0, 0.9 * (1 - d / n))


_CHARS: dict[str, float] = {}


def char_similarity(p: str, q: str) -> float:
    """Similarity of two characters: the same 1, one sound 0.97, close sounds 0.93, else as near as their sounds are written, below 0.8."""
    if p == q:
        return 1.0
    known = _CHARS.get(p + q)
    if known is not None:
        return known
    if same_sound(p, q):
        s = 0.97
    else:
        a, b = pinyin(p), pinyin(q)
        s = 0.93 if near(a, b) else 0.8 * (1 - edits(a, b) / max(len(a), len(b), 1))
    if len(_CHARS) > 500_000:
        _CHARS.clear()
    _CHARS[p + q] = s
    return s


def monge_elkan(a: str, b: str, inner=char_similarity) -> float:
    """Mean of the best inner similarity of every part of one name in the other, the lesser of both directions.

    A part's best counterpart may stand anywhere; each that stands elsewhere
    costs a little less than a close sound.
    """
    if not a or not b:
        return float(a == b)

    def one(s: str, t: str) -> float:
        total = 0.0
        for i, p in enumerate(s):
            best, off = -1.0, 0
            for j, q in enumerate(t):
                x = inner(p, q)
                if x > best or (x == best and abs(i - j) < off):
                    best, off = x, abs(i - j)
            total += best - (0.06 if off else 0.0)
        return total / len(s)

    return max(0.0, min(one(a, b), one(b, a)))


def brand_similarity(a: str, la: bool, b: str, lb: bool) -> float:
    """Monge-Elkan similarity of two brands: over their characters, or over their letters as one word where either is written in letters."""
    if a == b:
        return 1.0
    if la or lb:
        x, y = letters(a), letters(b)
        if x == y:
            return 0.99
        best = word_similarity(x, y)
        if best < 0.9 and not (la and lb):  # other readings of the characters
            c, w = (a, y) if lb else (b, x)
            best = max(best, sounded(c, w))
        return best
    return monge_elkan(a, b)


def sounded(brand: str, word: str) -> float:
    """Similarity of a word in letters to that reading of a brand's characters which is nearest to it."""
    every = [sorted(sounds(c)) if "一" <= c <= "鿿" else [c.lower()] for c in brand]
    if math.prod(map(len, every)) <= LISTED:
        return max(word_similarity("".join(r), word) for r in itertools.product(*every))
    row, n = list(range(len(word) + 1)), 0  # one row of distances for all readings so far
    for rs in every:
        rows = []
        for r in rs:
            x = row
            for c in r:
                y = [x[0] + 1]
                for j, w in enumerate(word, 1):
                    y.append(min(x[j] + 1, y[-1] + 1, x[j - 1] + (c != w)))
                x = y
            rows.append(x)
        row, n = [min(v) for v in zip(*rows)], n + max(map(len, rs))
    d = row[-1]
    return 0.99 if not d else 0.95 if d == 1 else max(0.0, 0.9 * (1 - d / max(n, len(word))))


def person_similarity(f1: str, l1: str, f2: str, l2: str) -> float:
    """The same for given name and surname, each as a word; a given name may be an initial. Below 0.9 it is another person."""
    last = word_similarity(l1, l2)
    if last < 1 and min(len(l1), len(l2)) < 3:
        last = min(last, 0.7)
    if not f1 or not f2:
        first = float(f1 == f2)
    elif min(len(f1), len(f2)) == 1 and f1 != f2:
        first = 0.9 if f1[0] == f2[0] else 0.0
    else:
        first = word_similarity(f1, f2)
    return (first + last) / 2 if min(first, last) >= 0.9 else min(first, last)


def sound_pairs(nodes: DataFrame, listed: bool = False) -> DataFrame:
    """Pairs ``a, b`` of sounds that may be one name, each sound with itself among them.

    Names that sound alike have equal keys and need no comparison. MinHash
    looks up every distinct sound for slipped letters. Where ``listed``, slips
    have keys too (:func:`slip_keys`) and none is left to chance; the pairs
    that share a band by chance, as the square of the sounds, don't arise.
    """

    def keys(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for t, k, b, la in zip(pdf["letters"], pdf["kind"], pdf["brand"], pdf["latin"]):
                ks = sound_keys(b, la, t) if k == "org" else {t}
                if listed:
                    ks = ks | slip_keys(b, la or k != "org", t)
                out += [(t, k, sk, la) for sk in ks]
            yield pd.DataFrame(out, columns=["letters", "kind", "sk", "latin"])

    n = cut(nodes.where("letters != ''").select("letters", "kind", F.when(F.col("kind") == "org", F.col("brand")).otherwise(F.lit("")).alias("brand"), "latin").distinct().mapInPandas(keys, "letters string, kind string, sk string, latin boolean"))
    same = n.select(F.col("letters").alias("a"), "kind", "sk").distinct().join(n.select(F.col("letters").alias("b"), "kind", "sk").distinct(), ["kind", "sk"])
    if listed:  # a sound meets itself under every key
        return same.where("a < b").select("a", "b").distinct().unionByName(n.select(F.col("letters").alias("a"), F.col("letters").alias("b")).distinct())
    same = same.where("a <= b").select("a", "b")
    slips = minhash_pairs(n.select(F.col("letters").alias("s"), "kind").distinct(), None, 0.995).where(F.levenshtein("a", "b", 2) >= 0).select("a", "b")  # a slip is two at most, swapped letters
    return same.unionByName(slips).distinct()


def node_links(nodes: DataFrame, least: float = 0.9, both: DataFrame | None = None) -> DataFrame:
    """Verified links ``a, b, sim`` of nodes whose city and trade don't contradict each other."""
    both = sound_pairs(nodes) if both is None else both
    x, y = (nodes.select(*[F.col(c).alias(f"{c}_{k}") for c in ("node", "kind", "brand", "letters", "latin", "city", "trade")]) for k in "xy")
    j = both.join(x, both["a"] == x["letters_x"]).join(y, F.col("b") == F.col("letters_y")).where(
        (F.col("node_x") != F.col("node_y")) & ((F.col("a") != F.col("b")) | (F.col("node_x") < F.col("node_y"))) & (F.col("kind_x") == F.col("kind_y"))
        & ((F.col("city_x") == F.col("city_y")) | (F.col("city_x") == "") | (F.col("city_y") == ""))
        & ((F.col("trade_x") == F.col("trade_y")) | (F.col("trade_x") == "") | (F.col("trade_y") == "")))

    def verify(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            sim = [
                brand_similarity(a, la, b, lb) if k == "org" else person_similarity(a, x, b, y)
                for k, a, la, x, b, lb, y in zip(pdf["kind_x"], pdf["brand_x"], pdf["latin_x"], pdf["letters_x"], pdf["brand_y"], pdf["latin_y"], pdf["letters_y"])
            ]
            yield pd.DataFrame({"a": pdf["node_x"], "b": pdf["node_y"], "sim": sim})

    return j.select("kind_x", "node_x", "brand_x", "latin_x", "letters_x", "node_y", "brand_y", "latin_y", "letters_y").mapInPandas(verify, "a long, b long, sim double").where(F.col("sim") >= least)


def star_clusters(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Satellites with every centre they are linked to, ``node, center, sim``, and the centres, ``node``.

    ``nodes`` has ``node, rank`` (a struct; the greater the better documented),
    ``links`` ``a, b, sim``. In rounds, each undecided node that outranks all
    undecided neighbours becomes a centre and its neighbours satellites. Ranks
    are a few classes, within which the node's hash is a random priority, so
    the rounds grow with the logarithm of the nodes and not with the longest
    chain of rising ranks.
    """
    both = cut(links.select("a", "b", "sim").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")).groupBy("a", "b").agg(F.max("sim").alias("sim")))
    rank = nodes.select("node", F.struct("rank", "node").alias("rank"))
    edges = cut(both.join(rank.select(F.col("node").alias("a"), F.col("rank").alias("ra")), "a").join(rank.select(F.col("node").alias("b"), F.col("rank").alias("rb")), "b"))
    alone = nodes.select("node").join(edges.select(F.col("a").alias("node")).distinct(), "node", "left_anti")
    centers = cut(alone)
    left = edges
    while not left.isEmpty():
        top = left.groupBy("a").agg(F.max("rb").alias("rb"), F.max("ra").alias("ra")).where("ra > rb").select(F.col("a").alias("node"))
        top = cut(top)
        centers = centers.unionByName(top)
        sat = left.join(top.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("node")).distinct()
        gone = top.unionByName(sat)
        rest = left.join(gone.select(F.col("node").alias("a")), "a", "left_anti").join(gone.select(F.col("node").alias("b")), "b", "left_anti")
        # nodes whose undecided neighbours are all gone are centres of their own
        lone = left.select(F.col("a").alias("node")).distinct().join(gone, "node", "left_anti").join(rest.select(F.col("a").alias("node")).distinct(), "node", "left_anti")
        centers = cut(centers.unionByName(lone))
        left = cut(rest)
    return edges.join(centers.select(F.col("node").alias("b")), "b", "left_semi").join(centers.select(F.col("node").alias("a")), "a", "left_anti").select(F.col("a").alias("node"), F.col("b").alias("center"), "sim"), centers


def make_nodes(recs: DataFrame) -> DataFrame:
    """Records with equal parts are one node: ``node, kind, brand, letters, latin, city, trade, form, klass, n, rank``."""
    person = F.col("kind") == "person"
    node = F.xxhash64("kind", F.when(person, F.col("brand")).otherwise(F.lit("")), "letters", "city", "trade")
    r = recs.withColumn("node", node)
    first = F.struct((~F.col("latin")).cast("int"), F.col("n"), F.col("brand"))
    full = F.regexp_extract("form", "(集团有限公司|股份有限公司|有限责任公司|有限公司)", 1)
    g = r.groupBy("node", "kind", "letters", "city", "trade").agg(
        F.max_by(F.struct("brand", "latin"), first).alias("b"), F.sum("n").alias("n"),
        F.max_by(full, F.when(full != "", F.col("n"))).alias("form"), F.max_by("klass", F.when(F.col("klass") != "", F.col("n"))).alias("klass"))
    rank = F.struct(
        ((F.col("city") != "").cast("int") + (F.col("trade") != "").cast("int") + F.when(F.col("kind") == "person", (F.length("brand") > 1).cast("int")).otherwise(0)).alias("parts"),
        (~F.col("latin")).cast("int").alias("own"), F.floor(F.log2("n")).alias("n"))
    return r.select("tab", "key", "node"), g.select("node", "kind", "b.brand", "letters", "b.latin", "city", "trade", F.coalesce("form", F.lit("")).alias("form"), F.coalesce("klass", F.lit("")).alias("klass"), "n").withColumn("rank", rank)


def cluster_names(recs: DataFrame, listed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Members ``tab, key, node``; nodes with ``center`` and ``torn`` (between several); ``trade, klass, p``, how often a trade has a class; the pairs of sounds (see :func:`sound_pairs` for ``listed``)."""
    recs = cut(recs)
    members, nodes = make_nodes(recs)
    nodes = cut(nodes)
    both = cut(sound_pairs(nodes, listed))
    links = node_links(nodes, both=both)
    sat, centers = star_clusters(nodes.select("node", "rank"), links)
    share = nodes.where("klass != '' and trade != ''").groupBy("trade", "klass").agg(F.sum("n").alias("n"))
    share = share.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("trade"))).select("trade", "klass", "p")
    a = nodes.select("node", F.col("klass"), F.col("form").alias("f"), "latin", F.col("brand").alias("own_brand"))
    c = nodes.select(F.col("node").alias("center"), F.col("trade"), F.col("form").alias("cf"), F.col("klass").alias("ck"), F.col("brand").alias("cbrand"))
    s = sat.join(a, "node").join(c, "center").join(share, ["trade", "klass"], "left")
    fits = F.when(F.col("klass") == "", 0.5).when(F.col("trade") == "", (F.col("klass") == F.col("ck")).cast("double")).otherwise(F.coalesce("p", F.lit(0.0)))
    score = F.col("sim") + 0.3 * fits + 0.05 * ((F.col("f") != "") & (F.col("f") == F.col("cf"))).cast("double")
    s = cut(s.select("node", "center", "sim", score.alias("score")))
    w = W.partitionBy("node").orderBy(F.desc("score"))
    best = s.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).where("r = 1")
    sure = best.where(F.col("next").isNull() | (F.col("score") - F.col("next") > 0.02)).select("node", "center")
    torn = best.select("node").join(sure, "node", "left_anti").withColumn("torn", F.lit(True))
    own = nodes.select("node").join(sure, "node", "left").join(torn, "node", "left").select("node", F.coalesce("center", "node").alias("center"), F.coalesce("torn", F.lit(False)).alias("torn"))
    return members, nodes.join(own, "node"), share, both


def name_clusters(recs: DataFrame) -> DataFrame:
    """``tab, key, cluster``: one row per writing or record with the organisation or person it belongs to."""
    members, nodes, _, _ = cluster_names(recs)
    return members.join(nodes.select("node", F.col("center").alias("cluster")), "node").select("tab", "key", "cluster").distinct()


def same_names(recs: DataFrame) -> DataFrame:
    """``tab, key_a, key_b`` of every two writings or records of one table that denote the same organisation or person.

    As many rows as the contract of problem 1 asks for; :func:`name_clusters` gives the same result as one row per member.
    """
    m = cut(name_clusters(recs).withColumnRenamed("cluster", "center"))
    return m.alias("x").join(m.alias("y"), ["tab", "center"]).where("x.key < y.key").select("tab", F.col("x.key").alias("key_a"), F.col("y.key").alias("key_b"))


def name_variants(orders: DataFrame, entities: DataFrame) -> DataFrame:
    """Problem 1 on purchase orders and entities.

    Null, empty and dash names denote nobody and give no row; repeated rows
    count once; other columns are ignored. A writing that lacks its city or
    trade belongs to the one organisation it fits, its class and legal form
    being considered; one that fits several equally is linked to none.
    """
    texts = orders.select(F.col("供应商").alias("t")).unionByName(entities.where("canonical_id is null").select(F.col("name_cn").alias("t"))).unionByName(entities.where("canonical_id is null").select(F.col("description").alias("t")))
    places = learn_places(texts)
    a = records_of_names(written(orders, "purchase_orders", "供应商", "供应商类别"), places)
    return same_names(a.unionByName(records_of_entities(entities, places)))


