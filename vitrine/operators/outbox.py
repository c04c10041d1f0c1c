"""Transactional-outbox operators over the outbox frame ``O``.

P14-P22 selections and lifecycle class, ST1 relay, ST2 routing, ST7 failure
accounting, ST12 retention, A2/A3 status roll-ups, D6/D7 status updates.
All take an explicit ``as_of`` instead of reading the wall clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import messaging as M

RETENTION_DAYS = 7


def _oldest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("created_at").asc(), F.col("id").asc())


def recent_events(O: DataFrame, since: Column, n: int | None = None) -> DataFrame:
    """Created at or after ``since``, newest first, all or the first n."""
    o = O.filter(F.col("created_at") >= since).orderBy(F.col("created_at").desc(), F.col("id").desc())
    return o.limit(n) if n is not None else o


def history(O: DataFrame, aggregate_id: str, aggregate_type: str) -> DataFrame:
    """Events of one aggregate (id + type), oldest first."""
    return _oldest_first(O.filter((F.col("aggregate_id") == aggregate_id)
                                  & (F.col("aggregate_type") == aggregate_type)))


def audit_trail(O: DataFrame, aggregate_id: str) -> DataFrame:
    """Events of one aggregate id, newest first."""
    return (O.filter(F.col("aggregate_id") == aggregate_id)
            .orderBy(F.col("created_at").desc(), F.col("id").desc()))


def by_event_type(O: DataFrame, event_type: str) -> DataFrame:
    """Events of a type, oldest first."""
    return _oldest_first(O.filter(F.col("event_type") == event_type))


def is_unprocessed() -> Column:
    return ~F.col("processed")


def is_fresh() -> Column:
    return ~F.col("processed") & (F.col("retry_count") == 0)


def is_retry_due(as_of: Column) -> Column:
    """Query form of the reference (Q9): 0 < retry < 5 and next attempt due."""
    r = F.col("retry_count")
    return (~F.col("processed") & (r > 0) & (r < M.MAX_OUTBOX_RETRIES)
            & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= as_of)))


def is_dead() -> Column:
    return ~F.col("processed") & (F.col("retry_count") >= M.MAX_OUTBOX_RETRIES)


def unprocessed(O: DataFrame) -> DataFrame:
    """P18."""
    return O.filter(is_unprocessed())


def fresh(O: DataFrame, n: int | None = None) -> DataFrame:
    """Never attempted, oldest first, first n."""
    o = _oldest_first(O.filter(is_fresh()))
    return o.limit(n) if n is not None else o


def retryable(O: DataFrame, as_of: Column, n: int | None = None) -> DataFrame:
    """P20: due for another attempt, oldest first, first n."""
    o = _oldest_first(O.filter(is_retry_due(as_of)))
    return o.limit(n) if n is not None else o


def dead_letter(O: DataFrame) -> DataFrame:
    """P21."""
    return O.filter(is_dead())


def lifecycle(as_of: Column) -> Column:
    """One label per row: processed / fresh / retry_due / retry_waiting /
    dead / unclassified (a null retry count matches no rule, Q9)."""
    r = F.col("retry_count")
    return (F.when(F.col("processed"), "processed")
            .when(r.isNull(), "unclassified")
            .when(r == 0, "fresh")
            .when(r >= M.MAX_OUTBOX_RETRIES, "dead")
            .when(is_retry_due(as_of), "retry_due")
            .when(r > 0, "retry_waiting")
            .otherwise("unclassified"))


def classify(O: DataFrame, as_of: Column) -> DataFrame:
    return O.withColumn("status", lifecycle(as_of))


def relay(O: DataFrame, as_of: Column, batch: int | None = None) -> DataFrame:
    """ST1: fresh rows plus due retries become messages: topic (F15), headers
    (F16), partition key = aggregate id. Unbounded by default (one Spark job
    relays the whole backlog); ``batch`` keeps the reference's per-run bound,
    taken oldest first from each source as the reference does."""
    f = O.filter(is_fresh())
    r = O.filter(is_retry_due(as_of))
    if batch is not None:
        f, r = _oldest_first(f).limit(batch), _oldest_first(r).limit(batch)
    return to_messages(f.unionByName(r))


def to_messages(src: DataFrame) -> DataFrame:
    """Outbox rows -> topic messages (no offsets yet)."""
    return src.select(
        F.concat(F.lit("outbox-"), F.col("id").cast("string")).alias("id"),
        M.topic_for("aggregate_type").alias("topic"),
        "event_type",
        F.col("event_data").alias("payload"),
        M.outbox_headers("id", "aggregate_id", "aggregate_type", "event_type", "created_at")
         .alias("headers"),
        F.col("created_at").alias("timestamp"),
        F.col("aggregate_id").alias("partition_key"),
        F.col("id").alias("outbox_id"))


def route(messages: DataFrame, path: str, mode: str = "append") -> None:
    """ST2: one stream to n topics: a write partitioned by topic, one folder each."""
    messages.write.mode(mode).partitionBy("topic").parquet(path)


def mark_processed(O: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """Set processed and processed_at for the acknowledged ids."""
    acked = ids.select(F.col("id").alias("_ack")).distinct().withColumn("_hit", F.lit(True))
    j = O.join(acked, O.id == acked._ack, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return j.select(*[F.when(hit, F.lit(True)).otherwise(F.col(c)).alias(c) if c == "processed"
                      else F.when(hit, as_of).otherwise(F.col(c)).alias(c) if c == "processed_at"
                      else F.col(c) for c in O.columns])


def apply_failures(O: DataFrame, failures: DataFrame, as_of: Column) -> DataFrame:
    """ST7/D7: for each failed id: retry + 1, next attempt by F18, error text.
    A row whose count reaches 5 is dead letter (P21). ``failures``: id, error."""
    f = (failures.groupBy(F.col("id").alias("_fid"))
         .agg(F.max("error").alias("_err")))
    j = O.join(f, O.id == f._fid, "left")
    hit = F.col("_fid").isNotNull()
    out = []
    for c in O.columns:
        if c == "retry_count":
            out.append(F.when(hit, F.coalesce(F.col(c), F.lit(0)) + 1).otherwise(F.col(c))
                       .cast("int").alias(c))
        elif c == "next_retry_at":
            out.append(F.when(hit, M.outbox_backoff(as_of, F.col("retry_count")))
                       .otherwise(F.col(c)).alias(c))
        elif c == "error_message":
            out.append(F.when(hit, F.col("_err")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def purge(O: DataFrame, as_of: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """ST12: drop processed rows whose processed_at is before as_of - days (F21);
    the caller overwrites the table with the result."""
    cutoff = as_of - F.make_dt_interval(F.lit(days))
    old = F.col("processed") & (F.col("processed_at") < cutoff)
    return O.filter(~F.coalesce(old, F.lit(False)))


def status_stats(O: DataFrame) -> DataFrame:
    """A2: counts by (processed, retry_count)."""
    return O.groupBy("processed", "retry_count").agg(F.count(F.lit(1)).alias("event_count"))


def outbox_stats(O: DataFrame) -> DataFrame:
    """A3: unprocessed count and the number of (processed, retry) groups (the
    reference calls it totalEventTypes, Q16)."""
    return O.agg(
        F.count_if(~F.col("processed")).alias("unprocessed_count"),
        F.count_distinct(F.struct("processed", F.coalesce(F.col("retry_count"), F.lit(-1))))
         .alias("status_groups"))
