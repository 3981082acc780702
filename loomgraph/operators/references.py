"""References to records that do not exist, from signed counts per key.

Changes come as deltas, +1 for a reference or record that appears and -1 for
one that is withdrawn. Deltas of one statement (a row's field and its key, or
a record's state) are summed, so what was withdrawn is gone and what came
twice is one; a kept table of these sums is all that is needed to go on with
the next batch of changes. The report is taken from the sums: keys with
positive references and zero existence, and those with other references than
existence in time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut

FIELDS = {"source_entity": "entities", "target_entity": "entities", "ontology_id": "projects"}


def clean_key(c: str):
    """Blanks around an id and letter case do not matter; a blank id is no reference."""
    k = F.lower(F.regexp_replace(F.col(c), r"^\s+|\s+$", ""))
    return F.when(k != "", k)


REF = ["tab", "key", "at", "relation_id", "ref_field"]
STATE = ["tab", "key", "born", "died"]


def reference_deltas(relations: DataFrame, sign: int = 1) -> DataFrame:
    """Change deltas of references: ``tab, key, at, relation_id, ref_field, refs``; ``sign`` -1 for relations that are withdrawn.

    A relation delivered anew with another target is a withdrawal of its old
    row and a delivery of the new one.
    """
    fields = F.array(*[F.struct(F.lit(f).alias("ref_field"), F.lit(t).alias("tab"), clean_key(f).alias("key")) for f, t in FIELDS.items()])
    return (
        relations.select("id", "created_at", F.explode(fields).alias("x"))
        .select(F.col("x.tab").alias("tab"), F.col("x.key").alias("key"), F.col("created_at").alias("at"), F.col("id").alias("relation_id"), F.col("x.ref_field").alias("ref_field"),
                F.lit(sign).cast("long").alias("refs"))
        .where("key is not null and relation_id is not null")
    )


def existence_deltas(entities: DataFrame | None, projects: DataFrame | None, sign: int = 1) -> DataFrame:
    """Change deltas of existence: ``tab, key, born, died, n``; ``sign`` -1 for records, or states of records, that are no longer so."""
    parts = []
    if entities is not None:
        parts.append(entities.select(F.lit("entities").alias("tab"), clean_key("id").alias("key"), F.col("created_at").alias("born"), F.col("deprecated_at").alias("died")))
    if projects is not None:
        parts.append(projects.select(F.lit("projects").alias("tab"), clean_key("id").alias("key"), F.col("created_at").alias("born"), F.col("created_at").alias("died")).withColumn("died", F.when(F.lit(False), F.col("died"))))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.where("key is not null").withColumn("n", F.lit(sign).cast("long"))


def merged(kept: DataFrame | None, deltas: DataFrame, by: list[str], count: str) -> DataFrame:
    """The kept sums with a batch of deltas added; statements whose sum is zero are gone, and what comes again counts once."""
    d = deltas.distinct()
    x = d if kept is None else kept.unionByName(d)
    return x.groupBy(*by).agg(F.sum(count).alias(count)).withColumn(count, F.least(F.lit(1), F.greatest(F.lit(-1), count)).cast("long")).where(F.col(count) != 0)


class ReferenceCounts:
    """Signed counts of references and existence, kept as two tables from batch to batch.

    A relation or record withdrawn before it was delivered counts -1 until its
    delivery comes, so batches may arrive in any order.
    """

    def __init__(self, refs: DataFrame | None = None, existence: DataFrame | None = None):
        self.refs, self.existence = refs, existence

    def change(self, refs: DataFrame | None = None, existence: DataFrame | None = None) -> ReferenceCounts:
        """The counts after a batch of deltas, written once."""
        return ReferenceCounts(
            self.refs if refs is None else cut(merged(self.refs, refs, REF, "refs")),
            self.existence if existence is None else cut(merged(self.existence, existence, STATE, "n")))

    def orphans(self) -> DataFrame:
        """As :func:`orphan_references`, of what the counts hold now."""
        return orphans_of(self.refs, self.existence)


def orphans_of(refs: DataFrame, existence: DataFrame) -> DataFrame:
    """The report from summed references and states of records.

    References are summed into one signed row per key first, with partial
    aggregates, so a target that a third of all relations name stays one row.
    Keys with positive references and no existence are missing; keys whose
    first reference precedes their existence or whose last one follows their
    deletion are suspects. Only references to these are looked at singly.
    """
    r = refs.where("refs > 0").groupBy("tab", "key").agg(F.sum("refs").alias("refs"), F.min("at").alias("first_ref"), F.max("at").alias("last_ref"))
    # one record may stand in several states of the same key; it is gone if each of them is
    x = existence.where("n > 0").groupBy("tab", "key").agg(F.count("*").alias("exists"), F.min("born").alias("born"), F.max("died").alias("died"), (F.count("*") - F.count("died")).alias("alive"))
    bad = r.join(x, ["tab", "key"], "left").where(
        (F.col("refs") > 0) & (F.coalesce("exists", F.lit(0)).eqNullSafe(0) | (F.col("first_ref") < F.col("born")) | (F.col("last_ref") >= F.col("died")))
    ).select("tab", "key", "exists", "alive", "born", "died")
    kind = (
        F.when(F.col("exists").isNull(), "missing").when(F.col("born") > F.col("at"), "late")
        .when((F.col("alive") <= 0) & (F.col("died") <= F.col("at")), "deleted")
    )
    return (
        refs.where("refs > 0").join(bad, ["tab", "key"]).select("relation_id", "ref_field", kind.alias("kind"), "at").where("kind is not null").distinct()
    )


def orphan_references(relations: DataFrame, entities: DataFrame, projects: DataFrame) -> DataFrame:
    """One row per relation and field whose reference fails: ``relation_id, ref_field, kind, at``.

    The tables are taken as one batch of deltas (:class:`ReferenceCounts` goes
    on from there). A null or blank reference refers to nothing and gives no
    row; a relation delivered twice counts once; a record or relation without
    created_at is never late or deleted.
    """
    # a single batch holds no withdrawals, so its statements need no sums before those by key
    return orphans_of(reference_deltas(relations.select("id", "created_at", *FIELDS)), existence_deltas(entities.select("id", "created_at", "deprecated_at"), projects.select("id", "created_at")))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Failing references per field and month of the relation: ``ref_field, period, kind, n``."""
    return orphans.groupBy("ref_field", F.date_format("at", "yyyy-MM").alias("period"), "kind").agg(F.count("*").alias("n"))
