"""Registered outbox queries (P14-P22, ST1, ST7, ST12, A2, A3, D6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import outbox as OB
from vitrine.plans import views as V
from vitrine.plans.registry import register

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

DUE_SQL = f"""(NOT processed AND retry_count > 0 AND retry_count < 5
               AND (next_retry_at IS NULL OR next_retry_at <= {AS_OF}))"""
STATUS_SQL = f"""CASE WHEN processed THEN 'processed' WHEN retry_count IS NULL THEN 'unclassified'
     WHEN retry_count = 0 THEN 'fresh' WHEN retry_count >= 5 THEN 'dead'
     WHEN {DUE_SQL} THEN 'retry_due' WHEN retry_count > 0 THEN 'retry_waiting'
     ELSE 'unclassified' END"""


def outbox(spark, sf):
    return V.outbox(spark, sf)


@register("outbox_lifecycle", f"SELECT id, aggregate_type, {STATUS_SQL} AS status FROM outbox_v",
          ("outbox_v",))
def q_outbox_lifecycle(spark, sf):
    return OB.classify(outbox(spark, sf), V.as_of()).select("id", "aggregate_type", "status")


@register("outbox_unprocessed", "SELECT id, retry_count FROM outbox_v WHERE NOT processed",
          ("outbox_v",))
def q_outbox_unprocessed(spark, sf):
    return OB.unprocessed(outbox(spark, sf)).select("id", "retry_count")


@register("outbox_fresh", """
SELECT id, created_at FROM outbox_v WHERE NOT processed AND retry_count = 0
ORDER BY created_at, id LIMIT 50""", ("outbox_v",))
def q_outbox_fresh(spark, sf):
    return OB.fresh(outbox(spark, sf), 50).select("id", "created_at")


@register("outbox_retryable", f"""
SELECT id, retry_count, next_retry_at FROM outbox_v WHERE {DUE_SQL}
ORDER BY created_at, id LIMIT 50""", ("outbox_v",))
def q_outbox_retryable(spark, sf):
    return OB.retryable(outbox(spark, sf), V.as_of(), 50).select("id", "retry_count", "next_retry_at")


@register("outbox_fresh_all", "SELECT id, created_at FROM outbox_v WHERE NOT processed AND retry_count = 0", ("outbox_v",))
def q_outbox_fresh_all(spark, sf):
    """P19 without its bound."""
    return OB.fresh(outbox(spark, sf)).select("id", "created_at")


@register("outbox_retryable_all", f"SELECT id, retry_count, next_retry_at FROM outbox_v WHERE {DUE_SQL}", ("outbox_v",))
def q_outbox_retryable_all(spark, sf):
    """P20 without its bound."""
    return OB.retryable(outbox(spark, sf), V.as_of()).select("id", "retry_count", "next_retry_at")


@register("outbox_recent_all", f"SELECT id, created_at FROM outbox_v WHERE created_at >= {AS_OF} - INTERVAL 2 DAY", ("outbox_v",))
def q_outbox_recent_all(spark, sf):
    """P14 without its bound."""
    return OB.recent_events(outbox(spark, sf), V.as_of() - F.make_dt_interval(F.lit(2))).select("id", "created_at")


@register("outbox_dead_letter", "SELECT id, error_message FROM outbox_v WHERE NOT processed AND retry_count >= 5",
          ("outbox_v",))
def q_outbox_dead_letter(spark, sf):
    return OB.dead_letter(outbox(spark, sf)).select("id", "error_message")


@register("outbox_recent", f"""
SELECT id, created_at FROM outbox_v WHERE created_at >= {AS_OF} - INTERVAL 2 DAY
ORDER BY created_at DESC, id DESC LIMIT 100""", ("outbox_v",))
def q_outbox_recent(spark, sf):
    since = V.as_of() - F.make_dt_interval(F.lit(2))
    return OB.recent_events(outbox(spark, sf), since, 100).select("id", "created_at")


@register("outbox_history", """
SELECT id, event_type, created_at FROM outbox_v WHERE aggregate_id = '42' AND aggregate_type = 'Product'""",
          ("outbox_v",))
def q_outbox_history(spark, sf):
    return OB.history(outbox(spark, sf), "42", "Product").select("id", "event_type", "created_at")


@register("outbox_audit_trail", "SELECT id, aggregate_type, created_at FROM outbox_v WHERE aggregate_id = '7'",
          ("outbox_v",))
def q_outbox_audit_trail(spark, sf):
    return OB.audit_trail(outbox(spark, sf), "7").select("id", "aggregate_type", "created_at")


@register("outbox_by_event_type", "SELECT id, aggregate_id FROM outbox_v WHERE event_type = 'ProductPurchased'",
          ("outbox_v",))
def q_outbox_by_event_type(spark, sf):
    return OB.by_event_type(outbox(spark, sf), "ProductPurchased").select("id", "aggregate_id")


@register("outbox_relay", f"""
SELECT 'outbox-' || CAST(id AS VARCHAR) AS id,
       CASE lower(aggregate_type) WHEN 'product' THEN 'product-events' WHEN 'order' THEN 'order-events'
            WHEN 'user' THEN 'user-events' ELSE 'general-events' END AS topic,
       event_type, event_data AS payload, aggregate_id AS partition_key,
       'outbox-event-' || CAST(id AS VARCHAR) AS idempotency_key, 'vitrine' AS source,
       strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at_header
FROM outbox_v WHERE (NOT processed AND retry_count = 0) OR {DUE_SQL}""", ("outbox_v",))
def q_outbox_relay(spark, sf):
    m = OB.relay(outbox(spark, sf), V.as_of())
    h = F.col("headers")
    return m.select("id", "topic", "event_type", "payload", "partition_key",
                    h["idempotency-key"].alias("idempotency_key"), h["source"].alias("source"),
                    h["created-at"].alias("created_at_header"))


@register("outbox_apply_failures", f"""
, f AS (SELECT id FROM outbox_v WHERE {DUE_SQL} AND CAST(aggregate_id AS BIGINT) % 2 = 1),
o2 AS (
  SELECT o.id, o.processed, o.retry_count + 1 AS retry_count,
         {AS_OF} + to_minutes(CAST(1 << (o.retry_count + 1) AS BIGINT)) AS next_retry_at,
         'timeout' AS error_message
  FROM outbox_v o JOIN f ON o.id = f.id)
SELECT id, retry_count, next_retry_at, error_message,
       CASE WHEN retry_count >= 5 THEN 'dead' ELSE 'retry_waiting' END AS status FROM o2""",
          ("outbox_v",))
def q_outbox_apply_failures(spark, sf):
    O = outbox(spark, sf)
    due = OB.retryable(O, V.as_of()).filter(F.col("aggregate_id").cast("bigint") % 2 == 1)
    failures = due.select("id", F.lit("timeout").alias("error"))
    after = OB.classify(OB.apply_failures(O, failures, V.as_of()), V.as_of())
    return after.join(failures.select("id"), "id", "left_semi").select(
        "id", "retry_count", "next_retry_at", "error_message", "status")


@register("outbox_mark_processed", f"""
SELECT id, CASE WHEN NOT processed AND retry_count = 0 THEN 'processed' ELSE {STATUS_SQL} END AS status,
       NOT processed AND retry_count = 0 AS stamped FROM outbox_v""", ("outbox_v",))
def q_outbox_mark_processed(spark, sf):
    O = outbox(spark, sf)
    acks = OB.relay(O.filter(OB.is_fresh()), V.as_of()).select(F.col("outbox_id").alias("id"))
    after = OB.classify(OB.mark_processed(O, acks, V.as_of()), V.as_of())
    return after.select("id", "status", F.coalesce(F.col("processed_at") == V.as_of(), F.lit(False)).alias("stamped"))


@register("outbox_purge", f"""
SELECT id, processed, created_at FROM outbox_v
WHERE NOT coalesce(processed AND processed_at < {AS_OF} - INTERVAL 7 DAY, false)""", ("outbox_v",))
def q_outbox_purge(spark, sf):
    return OB.purge(outbox(spark, sf), V.as_of(), 7).select("id", "processed", "created_at")


@register("outbox_status_stats", """
SELECT processed, retry_count, count(*) AS event_count FROM outbox_v GROUP BY processed, retry_count""",
          ("outbox_v",))
def q_outbox_status_stats(spark, sf):
    return OB.status_stats(outbox(spark, sf))


@register("outbox_stats", """
SELECT count(*) FILTER (WHERE NOT processed) AS unprocessed_count,
       count(DISTINCT (processed, coalesce(retry_count, -1))) AS status_groups FROM outbox_v""",
          ("outbox_v",))
def q_outbox_stats(spark, sf):
    return OB.outbox_stats(outbox(spark, sf))
