"""Snapshots, lineage, audit chains, reconciliation, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W


def content_hash(df: DataFrame) -> DataFrame:
    """One row: the number of rows and a hash of the whole content that doesn't depend on the order of rows."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.agg(F.count("*").alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("content_hash"))


def input_hash(inputs: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """``by, inputs, hash``: SHA-256 over the distinct inputs of a run, in order."""
    line = F.concat_ws(":", *[F.col(c).cast("string") for c in cols])
    return inputs.groupBy(by).agg(F.sort_array(F.collect_set(line)).alias("x")).select(by, F.size("x").cast("long").alias("inputs"), F.sha2(F.array_join("x", "|"), 256).alias("hash"))


def chained(events: DataFrame, part: list[str], order: list[str], body: Column) -> DataFrame:
    """``event_hash`` and ``previous_hash`` for events of a partition in order; a hash covers its own body."""
    h = F.sha2(body, 256)
    return events.withColumn("event_hash", h).withColumn("previous_hash", F.lag("event_hash").over(W.partitionBy(*part).orderBy(*order)))


def verify_chain(events: DataFrame, part: list[str], order: list[str], body: Column) -> DataFrame:
    """Per partition: events, events whose body doesn't give their hash, links that don't fit the event before."""
    w = W.partitionBy(*part).orderBy(*order)
    x = events.withColumn("__prev", F.lag("event_hash").over(w)).withColumn("__own", F.sha2(body, 256))
    return x.groupBy(*part).agg(F.count("*").alias("events"), F.count_if(~F.col("event_hash").eqNullSafe(F.col("__own"))).alias("altered"), F.count_if(~F.col("previous_hash").eqNullSafe(F.col("__prev"))).alias("broken"))


def reconcile(authority: DataFrame, index: DataFrame, key: str, value: str) -> DataFrame:
    """``key, state``: missing in the index, stale there, or of another content."""
    a, b = authority.select(F.col(key).alias("key"), F.col(value).alias("va"), F.lit(1).alias("ia")), index.select(F.col(key).alias("key"), F.col(value).alias("vb"), F.lit(1).alias("ib"))
    x = a.join(b, "key", "full")
    state = F.when(F.col("ib").isNull(), "missing").when(F.col("ia").isNull(), "stale").when(~F.col("va").eqNullSafe(F.col("vb")), "different")
    return x.select("key", state.alias("state")).where("state is not null")


def lineage(versions: DataFrame, inputs: DataFrame, runs: DataFrame) -> DataFrame:
    """Versions with the runs that read them; ``complete`` is false where a run's input version doesn't exist."""
    return inputs.join(runs, "run_id").join(versions.withColumn("__known", F.lit(True)), "version_id", "left").withColumn("complete", F.coalesce("__known", F.lit(False))).drop("__known")


def quality_rollup(df: DataFrame, by: str, counters: list[str], scores: list[str]) -> DataFrame:
    """Counters summed and scores averaged per group; texts that are no numbers don't count."""
    return df.groupBy(by).agg(*[F.coalesce(F.sum(F.col(c).try_cast("long")), F.lit(0)).alias(c) for c in counters], *[F.round(F.avg(F.col(c).try_cast("double")), 6).alias(c) for c in scores])


def purgeable(df: DataFrame, ts: str, cutoff: Column, key: str, holds: DataFrame) -> DataFrame:
    """Rows older than a cutoff that no hold protects."""
    return df.where(F.col(ts) < cutoff).join(holds.select(key).distinct(), key, "left_anti")


def scoped(df: DataFrame, key: str, manifest: DataFrame, text: str | None = None, query: str | None = None) -> DataFrame:
    """Rows whose key a release's manifest lists and, if given, whose text holds a query."""
    x = df.join(manifest.select(F.col(manifest.columns[0]).alias(key)).distinct(), key, "left_semi")
    return x.where(F.lower(text).contains(query.lower())) if text and query else x


def property_findings(df: DataFrame, key: str, col: str) -> DataFrame:
    """``key, kind`` of JSON property payloads: object, array, scalar, null or invalid."""
    v = F.try_parse_json(col)
    kind = (F.when(F.col(col).isNull(), "null").when(v.isNull(), "invalid").otherwise(
        F.when(F.schema_of_variant(v).startswith("OBJECT"), "object").when(F.schema_of_variant(v).startswith("ARRAY"), "array").otherwise("scalar")))
    return df.select(F.col(key).alias("key"), kind.alias("kind"))
