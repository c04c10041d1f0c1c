"""Registered monitoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import broker as B
from vitrine.operators import catalog as C
from vitrine.operators import monitor as MO
from vitrine.operators import outbox as OB
from vitrine.operators import sync as S
from vitrine.plans import views as V
from vitrine.plans.queries_events import folded_index, topic_log
from vitrine.plans.registry import register

#: Consumer groups of the catalogue: configuration, like the reference's listener registry.
CONSUMER_GROUPS = ("search-sync", "analytics", "notifications")

LIVE_INDEX_SQL = """
, L AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY "offset" DESC) AS rn
                       FROM pevents_v WHERE event_type IN ('ProductCreated', 'ProductUpdated', 'ProductDeleted'))
        WHERE rn = 1),
live AS (SELECT product_id FROM L WHERE event_type <> 'ProductDeleted')"""


COMPONENT_SQL = LIVE_INDEX_SQL + """,
component AS (
  SELECT 'database' AS component, CASE WHEN (SELECT count(*) FROM product_v WHERE sku IS NULL OR price IS NULL) = 0
         AND (SELECT count(*) = count(DISTINCT id) FROM product_v) THEN 'UP' ELSE 'DOWN' END AS status
  UNION ALL SELECT 'messageBroker', CASE WHEN (SELECT bool_and(dense) FROM (
         SELECT count(*) = max("offset") AND min("offset") = 1 AS dense FROM topic_v GROUP BY topic)) THEN 'UP' ELSE 'DOWN' END
  UNION ALL SELECT 'outboxService', CASE WHEN (SELECT count(*) FROM outbox_v WHERE NOT processed AND retry_count >= 5) = 0
         THEN 'UP' ELSE 'WARN' END
  UNION ALL SELECT 'syncService', CASE WHEN (SELECT count(*) FROM part) = (SELECT count(*) FROM live) THEN 'UP' ELSE 'WARN' END)"""


def components(spark, sf):
    P = V.product(spark, sf)
    return (MO.database_component(P).unionByName(MO.broker_component(topic_log(spark, sf, [])))
            .unionByName(MO.outbox_component(V.outbox(spark, sf)))
            .unionByName(MO.sync_component(S.sync_stats(P, folded_index(spark, sf)))))


@register("component_health", COMPONENT_SQL + " SELECT * FROM component", ("pevents_v", "topic_v", "outbox_v", "product_v"))
def q_component_health(spark, sf):
    """The status of each component, from its tables."""
    return components(spark, sf)


@register("system_health", COMPONENT_SQL + """
SELECT CASE WHEN bool_and(status = 'UP') THEN 'UP' ELSE 'DOWN' END AS status, count(*) AS components,
       count(*) FILTER (WHERE status <> 'UP') AS not_up FROM component""", ("pevents_v", "topic_v", "outbox_v", "product_v"))
def q_system_health(spark, sf):
    """UP only if every component is."""
    return MO.health(components(spark, sf))


@register("system_metrics", LIVE_INDEX_SQL + """,
t AS (SELECT topic, max("offset") AS m FROM topic_v GROUP BY topic),
b AS (SELECT topic, ("offset" - 1) // 50 AS batch_no, count(*) AS messages,
             count(*) FILTER (WHERE retry_count > 0) AS failed FROM topic_v GROUP BY 1, 2)
SELECT (SELECT count(*) FROM part) AS product_count,
       (SELECT count(*) FILTER (WHERE NOT processed) FROM outbox_v) AS unprocessed_count,
       (SELECT count(DISTINCT (processed, retry_count)) FROM outbox_v) AS status_groups,
       (SELECT count(*) FROM part) AS source_count,
       (SELECT count(*) FROM live) AS index_count,
       (SELECT count(*) FROM part) = (SELECT count(*) FROM live) AS in_sync,
       (SELECT count(*) FROM t) AS topics,
       CAST(3 AS BIGINT) AS consumer_groups,
       (SELECT CAST(sum(m) AS BIGINT) FROM t) AS messages,
       (SELECT CAST(sum(messages) AS BIGINT) FROM b) AS total_messages,
       (SELECT count(*) FROM b) AS total_batches,
       (SELECT CAST(sum(failed) AS BIGINT) FROM b) AS total_failures""",
          ("pevents_v", "topic_v", "outbox_v"))
def q_system_metrics(spark, sf):
    """A4 + A3 + A5 + A6 + A7 in one row."""
    P = V.product(spark, sf)
    M = topic_log(spark, sf, ["event_type", "retry_count"])
    topics = B.broker_stats(M).agg(F.count(F.lit(1)).alias("topics"), F.lit(len(CONSUMER_GROUPS)).cast("bigint").alias("consumer_groups"),
                                   F.sum("messages").alias("messages"))
    return MO.one_row(C.row_count(P, "product_count"), OB.outbox_stats(V.outbox(spark, sf)),
                      S.sync_stats(P, folded_index(spark, sf)), topics, B.batch_stats(M))
