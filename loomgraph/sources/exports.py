"""Sinks: nodes and edges as CSV, JSON, Turtle, Cypher; tables as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def as_text(df: DataFrame) -> DataFrame:
    """Every column as CSV-safe text: nested values as JSON, binary as its size."""
    def one(c: str, t: str) -> Column:
        if t == "binary":
            return F.when(F.col(c).isNotNull(), F.format_string("<%d bytes>", F.length(c)))
        return F.to_json(c) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`").cast("string")

    return df.select(*[F.coalesce(one(c, t), F.lit("")).alias(c) for c, t in df.dtypes if c != "content"])


def one_table(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities and relations in the same nine columns."""
    cols = ("record_type", "id", "name_cn", "name_en", "type", "description", "source", "target", "confidence")
    e = entities.select(F.lit("entity"), "id", "name_cn", "name_en", "type", "description", F.lit(None).cast("string"), F.lit(None).cast("string"), "confidence").toDF(*cols)
    r = relations.select(F.lit("relation"), "id", *[F.lit(None).cast("string")] * 2, "type", F.lit(None).cast("string"), "source_entity", "target_entity", "confidence").toDF(*cols)
    return e.unionByName(r)


def _literal(c: str) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))


def turtle(entities: DataFrame, relations: DataFrame, base: str = "urn:graph:") -> DataFrame:
    """Triples as Turtle lines ``line``: labels, classes and relations."""
    iri = lambda c: F.concat(F.lit(f"<{base}"), F.regexp_replace(F.coalesce(c, F.lit("none")), r"[^\w一-鿿\-]", "_"), F.lit(">"))
    label = entities.select(F.concat_ws(" ", iri("id"), F.lit("<http://www.w3.org/2000/01/rdf-schema#label>"), _literal("name_cn"), F.lit(".")).alias("line"))
    kind = entities.select(F.concat_ws(" ", iri("id"), F.lit("a"), iri("type"), F.lit(".")).alias("line"))
    edge = relations.select(F.concat_ws(" ", iri("source_entity"), iri("type"), iri("target_entity"), F.lit(".")).alias("line"))
    return label.unionByName(kind).unionByName(edge)


def cypher(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """MERGE statements ``line`` for nodes, then edges; ``part`` keeps nodes first."""
    n = entities.select(F.lit(1).alias("part"), F.concat(F.lit("MERGE (n:Entity {id: "), _literal("id"), F.lit("}) SET n.name = "), _literal("name_cn"), F.lit(", n.type = "), _literal("type"), F.lit(";")).alias("line"))
    t = F.regexp_replace(F.coalesce("type", F.lit("RELATED")), "`", "")
    e = relations.select(F.lit(2).alias("part"), F.concat(F.lit("MATCH (a:Entity {id: "), _literal("source_entity"), F.lit("}), (b:Entity {id: "), _literal("target_entity"), F.lit("}) MERGE (a)-[:`"), t, F.lit("`]->(b);")).alias("line"))
    return n.unionByName(e)


def property_graph(entities: DataFrame, relations: DataFrame, path: str) -> None:
    """Vertices and edges in one CSV folder per label."""
    as_text(entities.withColumn("label", F.coalesce("type", F.lit("Entity")))).write.mode("overwrite").partitionBy("label").option("header", True).csv(f"{path}/vertices")
    as_text(relations.withColumn("label", F.coalesce("type", F.lit("RELATED")))).write.mode("overwrite").partitionBy("label").option("header", True).csv(f"{path}/edges")


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])).alias("line"))


def yaml(df: DataFrame) -> DataFrame:
    """``line``: the rows as items of one YAML sequence, each a flow mapping, of which JSON is a part."""
    return json_lines(df).select(F.concat(F.lit("- "), "line").alias("line"))


def html_report(entities: DataFrame, relations: DataFrame, most: int = 1000) -> str:
    """A page with the numbers of entities and relations by type; the ``most`` frequent types are named and the others summed."""
    from html import escape

    def table(title: str, df: DataFrame) -> str:
        n = df.groupBy(F.coalesce("type", F.lit("")).alias("type")).agg(F.count("*").alias("n"))
        top = n.orderBy(F.desc("n"), "type").limit(most).collect()
        total = df.count()
        rest = total - sum(r.n for r in top)
        rows = [(r.type or "-", r.n) for r in top] + ([("others", rest)] if rest else [])
        return f"<h2>{escape(title)}: {total}</h2><table>" + "".join(f"<tr><td>{escape(t)}</td><td>{k}</td></tr>" for t, k in rows) + "</table>"

    return "<!doctype html><meta charset=\"utf-8\"><title>Ontology</title>" + table("Entities", entities) + table("Relations", relations)


def concept_text(entities: DataFrame) -> DataFrame:
    """``id, text`` to embed: names, type, description and properties in one text."""
    return entities.select("id", F.concat_ws(" ", *[F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.trim(c)) for c in ("name_cn", "name_en", "type", "description", "properties")]).alias("text"))
