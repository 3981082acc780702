"""From datasets to a graph: concepts, instances, links, rules and actions in one build; extraction results checked and merged."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import clean_name, enum_value_name, folded_key, is_blank, junk_name, md5_uuid, rule_name, uuid5
from . import links, rules


def concepts(spark: SparkSession, ontology: str, classes: dict[str, str]) -> DataFrame:
    """One concept per class, ``concept_id, entity_class, dataset``; ids depend on ontology and class only."""
    df = spark.createDataFrame([*classes.items()], "dataset string, entity_class string")
    return df.select(md5_uuid(F.concat(F.lit(f"{ontology}:"), "entity_class")).alias("concept_id"), "entity_class", "dataset")


def property_metadata(df: DataFrame, rows: int = 20) -> DataFrame:
    """``column, type, hidden`` of a dataset's properties: the type of the first filled cell of ``rows`` rows; technical columns are hidden."""
    from .profile import value_type

    head = df.limit(rows)
    cells = head.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in df.columns if c != "content"])).alias("x")).select("x.*")
    t = cells.groupBy("column").agg(F.first(F.when(F.col("v") != "", F.col("v")), ignorenulls=True).alias("v"))
    return t.select("column", F.when(F.col("v").isNull(), "string").otherwise(value_type(F.col("v"))).alias("type"), (F.col("column").isin(*links.TECHNICAL) | F.col("column").startswith("__")).alias("hidden"))


def discovered_actions(spark: SparkSession, classes: dict[str, str], states: dict[str, list[str]], timestamps: dict[str, list[str]], linked: list[tuple[str, str]]) -> DataFrame:
    """``action, target, detail``: create, update and delete per class, transitions between observed states, up to three timestamps to set, link and unlink."""
    out = []
    for d, c in classes.items():
        out += [(f"{verb}_{c}", c, "crud") for verb in ("create", "update", "delete")]
        vs = states.get(d, [])
        out += [(f"set_{c}_state", c, f"{a}->{b}") for a in vs for b in vs if a != b]
        out += [(f"touch_{c}", c, col) for col in timestamps.get(d, [])[:3]]
    for a, b in linked:
        out += [(f"link_{a}_{b}", a, b), (f"unlink_{a}_{b}", a, b)]
    return spark.createDataFrame(sorted(set(out)), "action string, target string, detail string")


def build(datasets: dict[str, DataFrame], ontology: str) -> dict[str, DataFrame]:
    """The whole build as lazy tables: keys, concepts, instances, links, rules.

    Keys come from one profile of all columns (the only rows that reach the
    driver: one per column); everything else stays a plan.
    """
    spark = next(iter(datasets.values())).sparkSession
    unique: dict[str, set[str]] = {}
    for r in links.key_profile(datasets).where("is_unique").select("dataset", "col").collect():
        unique.setdefault(r.dataset, set()).add(r.col)
    keys = {d: links.primary_key(df.columns, unique.get(d, set())) for d, df in datasets.items()}
    classes = {d: links.class_name(d) for d in datasets}
    inst, rule = None, None
    for d, df in datasets.items():
        i = links.instances(df, ontology, classes[d], keys[d]).withColumn("entity_class", F.lit(classes[d]))
        inst = i if inst is None else inst.unionByName(i)
        r = rules.rule_catalogue(df, d)
        rule = r if rule is None else rule.unionByName(r)
    named = {d: k for d, k in keys.items() if k != "__row_hash__"}
    found = links.infer_links(datasets, named) if named else None
    return {"keys": spark.createDataFrame([*keys.items()], "dataset string, key string"), "concepts": concepts(spark, ontology, classes), "instances": inst, "links": found, "rules": rule}


def row_links(src: DataFrame, src_key: str, col: str, tgt: DataFrame, tgt_key: str, ontology: str, rel_type: str) -> DataFrame:
    """Links between instances: ``relation_id, source, target, type, confidence``, each pair once."""
    j = links.key_join(src, col, tgt, tgt_key).select(F.col(src_key).cast("string").alias("source"), F.col("__key").alias("target")).distinct()
    return j.select(uuid5(F.concat_ws(":", F.lit(ontology), "source", F.lit(rel_type), "target", F.lit(col))).alias("relation_id"), "source", "target", F.lit(rel_type).alias("type"), F.lit(0.85).alias("confidence"))


def normalised_extraction(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extracted entities without junk, rule names, enumeration values and repeats; relations between the kept ones, each once, without loops."""
    e = entities.withColumn("name", clean_name("name")).where(~is_blank("name") & ~junk_name("name") & ~rule_name("name") & ~enum_value_name("name"))
    e = e.withColumn("k", folded_key("name")).groupBy("k").agg(F.max_by(F.struct(*e.columns), F.struct(F.length(F.coalesce("description", F.lit(""))), "name")).alias("r")).select("r.*")
    names = e.select(F.col("name").alias("n"))
    r = relations.withColumn("source", clean_name("source")).withColumn("target", clean_name("target")).where(~is_blank("type") & (F.col("source") != F.col("target")))
    r = r.join(names.withColumnRenamed("n", "source"), "source", "left_semi").join(names.withColumnRenamed("n", "target"), "target", "left_semi").dropDuplicates(["source", "target", "type"])
    return e, r


def violations(entities: DataFrame, relations: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """``check, severity, key``: blank names, unknown types, confidences out of range, repeated names, dangling ends, loops, blank types, repeated triples."""
    rel = F.concat_ws("|", "source", "type", "target")
    row = lambda df, check, severity, key: df.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), key.cast("string").alias("key"))
    names = entities.select(F.col("name").alias("n")).distinct()
    parts = [
        row(entities.where(is_blank("name")), "blank_name", "error", F.col("type")),
        row(entities.where(~F.coalesce(F.col("type").isin(*types), F.lit(False))), "unknown_type", "warning", F.col("name")),
        row(entities.where(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))), "confidence_range", "warning", F.col("name")),
        row(entities.groupBy("name").count().where("count > 1"), "repeated_name", "warning", F.col("name")),
        row(relations.join(names.withColumnRenamed("n", "source"), "source", "left_anti"), "dangling_source", "error", rel),
        row(relations.join(names.withColumnRenamed("n", "target"), "target", "left_anti"), "dangling_target", "error", rel),
        row(relations.where("source = target"), "loop", "warning", rel), row(relations.where(is_blank("type")), "blank_type", "error", rel),
        row(relations.groupBy("source", "type", "target").count().where("count > 1"), "repeated_triple", "info", rel),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def containing_name(names: DataFrame, known: DataFrame, col: str) -> DataFrame:
    """``name, match``: a name resolved to the shortest known one that holds it or that it holds, both of two characters or more.

    Names and known names are compared where they share a pair of characters,
    so a known name meets only names it could match.
    """
    two = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(F.col(c), i, F.lit(2)))
    a = names.select(F.col(col).alias("name")).where(F.length(col) >= 2).distinct()
    b = known.select(F.col(col).alias("match")).where(F.length(col) >= 2).distinct()
    x = a.withColumn("g", F.explode(F.array_distinct(two("name")))).join(b.withColumn("g", F.explode(F.array_distinct(two("match")))), "g").where(F.col("match").contains(F.col("name")) | F.col("name").contains(F.col("match")))
    return x.groupBy("name").agg(F.min_by("match", F.struct(F.length("match"), "match")).alias("match"))


def truncated(df: DataFrame, order: list[str], limit: int, most: int = 50) -> DataFrame:
    """The first rows by ``order`` with ``truncated``: whether there are more; the limit is kept between 1 and ``most``."""
    n = max(1, min(most, limit))
    head = df.orderBy(*order).limit(n + 1)
    k = head.agg((F.count("*") > n).alias("truncated"))
    return head.orderBy(*order).limit(n).join(F.broadcast(k))


WRITES = re.compile(r"(?i)\b(create|merge|delete|detach|set|remove|drop|insert|update|alter|call|load)\b")


def read_only(query: str, scope: str | None = None) -> str:
    """The query, if it writes nothing and names the mandatory scope."""
    if WRITES.search(re.sub(r"'[^']*'|\"[^\"]*\"", "", query)):
        raise ValueError("the query writes")
    if scope and scope not in query:
        raise ValueError(f"the query doesn't name {scope}")
    return query


def run_sql(spark: SparkSession, query: str, **args) -> DataFrame:
    """SQL over registered tables with named parameters."""
    return spark.sql(read_only(query), args=args)
