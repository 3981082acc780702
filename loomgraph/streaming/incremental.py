"""Change events: envelopes, deduplication, cursors, current state. The functions work on batches and streams alike where noted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T, Window as W

from ..functions.columns import is_blank, parsed_time
from ..session import scratch

ENVELOPE = T.StructType([T.StructField(n, T.StringType()) for n in ("event_id", "source_id", "resource", "operation", "primary_key", "payload", "watermark", "source_cursor", "schema_hash", "occurred_at", "received_at")])


def envelopes(raw: DataFrame, col: str = "value") -> DataFrame:
    """JSON texts as envelopes with ``reason``: null if sound, else why the event is rejected. Batch or stream."""
    e = raw.select(F.from_json(col, ENVELOPE).alias("e")).select("e.*")
    op = F.lower("operation")
    reason = (F.when(is_blank("event_id"), "missing event_id").when(is_blank("source_id"), "missing source_id").when(is_blank("resource"), "missing resource")
              .when(is_blank("primary_key"), "missing primary_key").when(op.isNull() | ~op.isin("upsert", "delete"), "unknown operation")
              .when(is_blank("watermark") & is_blank("source_cursor"), "missing cursor").when(F.col("watermark").isNotNull() & parsed_time("watermark").isNull(), "bad watermark"))
    return e.withColumn("reason", reason)


def event_hash(*cols: str) -> Column:
    """SHA-256 over the parts of an event; null parts are empty. Equal hashes are one event."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256)


def event_identity(raw_id: str | None, *cols: str) -> Column:
    return F.coalesce(F.when(~is_blank(raw_id), F.col(raw_id).cast("string")) if raw_id else F.lit(None).cast("string"), event_hash(*cols))


def deduplicated(events: DataFrame, identity: list[str], ledger: DataFrame | None = None) -> DataFrame:
    """Each identity once and, given a ledger of earlier ones, none of those."""
    d = events.dropDuplicates(identity)
    return d if ledger is None else d.join(ledger.select(*identity).distinct(), identity, "left_anti")


def replays(events: DataFrame, identity: str, payload: str) -> DataFrame:
    """``identity, copies, payloads, verdict``: same id and payload is a duplicate, same id and another payload a replay."""
    g = events.groupBy(identity).agg(F.count("*").alias("copies"), F.countDistinct(payload).alias("payloads"))
    return g.where("copies > 1").withColumn("verdict", F.when(F.col("payloads") > 1, "replay").otherwise("duplicate"))


def after_cursor(df: DataFrame, wm: str, pk: str, cursor: tuple | None, overlap: str | None = None) -> DataFrame:
    """Rows behind a cursor (watermark, key), or from the watermark less an overlap on; written as a filter, so that it reaches the scan."""
    if cursor is None:
        return df
    w, k = (F.lit(v).cast(dict(df.dtypes)[c]) for c, v in zip((wm, pk), cursor))
    if overlap:
        return df.where(F.col(wm) >= w - F.expr(f"interval {overlap}"))
    return df.where((F.col(wm) > w) | ((F.col(wm) == w) & (F.col(pk) > k)))


def next_cursor(df: DataFrame, wm: str, pk: str) -> DataFrame:
    """One row: the greatest (watermark, key); nulls for an empty page, which leaves a cursor where it is."""
    return df.agg(F.max(F.struct(F.col(wm).alias("watermark"), F.col(pk).alias("primary_key"))).alias("c"), F.count("*").alias("rows")).select("c.watermark", "c.primary_key", "rows")


def advanced(before: Column, candidate: Column) -> Column:
    """A cursor never moves backwards."""
    return F.greatest(before, candidate)


def flagged_late(df: DataFrame, wm: str, pk: str, cursor: tuple) -> DataFrame:
    """All rows with ``is_late``: at or behind the cursor. Late rows are counted, never dropped."""
    c = F.struct(*[F.lit(v).cast(dict(df.dtypes)[k]) for k, v in zip((wm, pk), cursor)])
    return df.withColumn("is_late", F.struct(F.col(wm), F.col(pk)) <= c)


def current_state(log: DataFrame, key: str, order: list[str], operation: str, delete: str = "delete") -> DataFrame:
    """The last version of each key of a change log; keys whose last change is a deletion are gone. One partial aggregate, no sort."""
    cols = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r")).select(key, "r.*").where(F.lower(operation) != delete)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Two versions of a table merged: per key the later row."""
    both = old.unionByName(new)
    cols = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("r")).select(key, "r.*").select(*both.columns)


def retries(attempts: DataFrame, key: str, budget: int = 3) -> DataFrame:
    """``key, attempts, delay, state``: failed items to retry after a back-off, or dead once the budget is spent."""
    g = attempts.groupBy(key).agg(F.count("*").alias("attempts"), F.max(F.col("ok").cast("int")).alias("ok"))
    state = F.when(F.col("ok") == 1, "done").when(F.col("attempts") >= budget, "dead").otherwise("retry")
    return g.select(key, "attempts", F.least(F.lit(3600.0), F.pow(F.lit(2.0), F.col("attempts") - 1)).alias("delay"), state.alias("state"))


def freshness(last: Column, now: Column, soft: int = 3600, hard: int = 86_400) -> Column:
    """unknown, fresh, soft_stale or hard_stale by the seconds since the last change."""
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(last.cast("timestamp"))
    return F.when(last.isNull(), "unknown").when(age <= soft, "fresh").when(age <= hard, "soft_stale").otherwise("hard_stale")


def sla(last: Column, now: Column, seconds: Column) -> Column:
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(last.cast("timestamp"))
    return F.when(seconds.isNull(), "not_configured").when(last.isNotNull() & (age <= seconds), "within").otherwise("breached")


def tumbling(events: DataFrame, ts: str, size: str, by: list[str], slide: str | None = None) -> DataFrame:
    """Counts and sums per window; batch or stream (with a watermark set)."""
    w = F.window(F.col(ts), size, slide) if slide else F.window(F.col(ts), size)
    return events.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), *by, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str) -> DataFrame:
    """Sessions of one key that end after a gap: start, end (of the last event plus the gap), events."""
    return events.groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, F.col("s.start").cast("timestamp_ntz").alias("session_start"), F.col("s.end").cast("timestamp_ntz").alias("session_end"), "n")


def replay_stream(spark: SparkSession, table: DataFrame, order: str, transform, files: int = 4, mode: str = "append", watermark: str | None = None) -> DataFrame:
    """A table run through Structured Streaming: written as files in event order, read as a stream until all is done, the sink read back.

    The sink is idempotent: each batch overwrites its own folder, so a batch
    that is repeated after a failure leaves no second copy.
    """
    base = scratch(spark)
    table.repartitionByRange(files, order).sortWithinPartitions(order).write.parquet(f"{base}/in")
    s = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    if watermark:
        s = s.withWatermark(order, watermark)
    out = transform(s)

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    q = out.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()
    done = spark.read.schema(T.StructType([*out.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{base}/out")
    if mode == "complete":
        last = done.agg(F.max("batch").alias("batch"))
        done = done.join(F.broadcast(last), "batch", "left_semi")
    return done.drop("batch")


def last_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")
