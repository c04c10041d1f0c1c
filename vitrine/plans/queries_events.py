"""Registered event queries: topic offsets (W1), backlog and commit positions (ST3/ST4),
idempotency (ST6), retry split (ST8), fold (ST9/W3/ST11), metric merge (J8), error output (S5),
topic / publishing / delivery statistics (A6-A9), view and purchase roll-ups
(A10-A13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import messaging as MX
from vitrine.operators import broker as B
from vitrine.operators import fold as FO
from vitrine.operators import outbox as OB
from vitrine.operators import sync as S
from vitrine.plans import views as V
from vitrine.plans.registry import money, register

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


TOPIC_ORDER = ["timestamp", "event_id"]


def topic_rows(spark, sf):
    """The rows of the product-events topic with offsets assigned (W1): narrow ones, the messages are made of them
    where they are read."""
    return B.assign_offsets(V.product_event_rows(spark, sf), TOPIC_ORDER)


def product_topic(spark, sf):
    """The product-events topic with offsets assigned."""
    return V.product_messages(topic_rows(spark, sf), "offset")


def topic_log(spark, sf, columns=None):
    """Every outbox row published to its topic, offsets per topic (W1). ``columns``: those that the
    reader needs besides topic, timestamp, outbox_id and offset; all by default."""
    O = V.outbox(spark, sf)
    msgs = OB.to_messages(O).join(
        O.select(F.col("id").alias("outbox_id"), "retry_count", "processed_at", "created_at"),
        "outbox_id")
    if columns is not None:
        msgs = msgs.select("topic", "timestamp", "outbox_id", *columns)
    return B.assign_offsets(msgs, ["timestamp", "outbox_id"])


@register("topic_offsets", "SELECT id, topic, \"offset\" FROM topic_v", ("topic_v",))
def q_topic_offsets(spark, sf):
    return topic_log(spark, sf).select("id", "topic", "offset")


# --- fold -----------------------------------------------------------------------
FOLD_CTES = """
, L AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY "offset" DESC) AS rn
                       FROM pevents_v WHERE event_type IN ('ProductCreated', 'ProductUpdated', 'ProductDeleted'))
        WHERE rn = 1),
m AS (SELECT product_id, "offset",
             CASE WHEN event_type = 'ProductViewed' AND event_id % 100 <> 24 THEN
                  CASE WHEN event_id % 50 = 3 THEN 1 ELSE 1 + event_id % 2 END END AS view_inc,
             CASE WHEN event_id % 100 = 24 THEN 100 + event_id % 7 END AS set_to,
             CASE WHEN event_type = 'ProductPurchased' THEN 1 + event_id % 3 END AS buy_inc,
             CASE WHEN event_type = 'ProductViewed' AND event_id % 100 = 13 THEN 42.5 END AS pop_set
      FROM pevents_v WHERE event_type IN ('ProductViewed', 'ProductPurchased')),
live AS (SELECT m.*, max(CASE WHEN set_to IS NOT NULL THEN m."offset" END) OVER (PARTITION BY m.product_id) AS set_off
         FROM m JOIN L ON m.product_id = L.product_id AND m."offset" > L."offset"
         WHERE L.event_type <> 'ProductDeleted'),
agg AS (SELECT product_id, sum(CASE WHEN "offset" > coalesce(set_off, -1) THEN view_inc END) AS clicks_after,
               count(view_inc) AS n_views, max(CASE WHEN "offset" = set_off THEN set_to END) AS set_to,
               sum(buy_inc) AS buys_after, count(buy_inc) AS n_buys,
               arg_max_null(pop_set, "offset") AS last_pop
        FROM live GROUP BY product_id),
d AS (
  SELECT L.*, agg.product_id IS NOT NULL AS any_metric, agg.last_pop,
         (L.event_type = 'ProductCreated') AS created,
         CASE WHEN agg.set_to IS NOT NULL THEN agg.set_to + coalesce(agg.clicks_after, 0)
              WHEN coalesce(agg.n_views, 0) > 0
              THEN coalesce(CASE WHEN L.event_type = 'ProductCreated' THEN 0 END, 0) + agg.clicks_after
              ELSE CASE WHEN L.event_type = 'ProductCreated' THEN 0 END END AS click_count,
         CASE WHEN coalesce(agg.n_buys, 0) > 0
              THEN coalesce(CASE WHEN L.event_type = 'ProductCreated' THEN 0 END, 0) + agg.buys_after
              ELSE CASE WHEN L.event_type = 'ProductCreated' THEN 0 END END AS purchase_count,
         CAST(CAST(CASE WHEN L.event_type = 'ProductCreated' THEN L.price_cents
                        ELSE L.price_cents + (L.event_id % 7) * 100 END AS DECIMAL(18,0)) * 0.01
              AS DECIMAL(10,2)) AS price
  FROM L LEFT JOIN agg ON agg.product_id = L.product_id
  WHERE L.event_type <> 'ProductDeleted')"""
FOLD_SQL = FOLD_CTES + """
SELECT product_id,
       CASE WHEN created THEN p_name ELSE p_name || ' v' || CAST(event_id AS VARCHAR) END AS name,
       CAST(price AS DOUBLE) AS price,
       CASE WHEN created THEN date_trunc('second', ts) END AS created_at,
       date_trunc('second', ts) AS updated_at,
       CAST(click_count AS BIGINT) AS click_count, CAST(purchase_count AS BIGINT) AS purchase_count,
       CASE WHEN any_metric THEN coalesce(last_pop, CAST(coalesce(click_count, 0) AS DOUBLE) * 1.0 + CAST(coalesce(purchase_count, 0) AS DOUBLE) * 10.0)
            WHEN created THEN CAST(0.0 AS DOUBLE) END AS popularity_score,
       CASE WHEN price < 50 THEN '0-50' WHEN price < 100 THEN '50-100' WHEN price < 200 THEN '100-200'
            WHEN price < 500 THEN '200-500' WHEN price < 1000 THEN '500-1000' ELSE '1000+' END AS price_range,
       array_to_string(list_sort(CASE WHEN created
            THEN list_distinct([p_type, p_brand, p_brand,
                 CASE WHEN price < 50 THEN '0-50' WHEN price < 100 THEN '50-100' WHEN price < 200 THEN '100-200'
                      WHEN price < 500 THEN '200-500' WHEN price < 1000 THEN '500-1000' ELSE '1000+' END])
            ELSE list_filter([p_type, p_brand, p_brand,
                 CASE WHEN price < 100 THEN 'budget' WHEN price > 500 THEN 'premium' END], lambda x: x IS NOT NULL)
            END), '|') AS tags,
       trim(concat_ws(' ', CASE WHEN created THEN p_name ELSE p_name || ' v' || CAST(event_id AS VARCHAR) END,
                      concat_ws(' ', p_type, p_brand, p_name),
                      upper(substr(p_type, 1, 3)) || '-' || lpad(CAST(product_id AS VARCHAR), 6, '0'),
                      p_type || ' ' || p_brand,
                      'brand ' || p_brand || ' size ' || CAST(p_size AS VARCHAR))) AS all_text
FROM d"""


def _fold_out(doc):
    return doc.select("product_id", "name", money("price").alias("price"), "created_at",
                      "updated_at", "click_count", "purchase_count", "popularity_score",
                      "price_range", F.array_join(F.array_sort("tags"), "|").alias("tags"),
                      "all_text")


@register("fold_events", FOLD_SQL, ("pevents_v",))
def q_fold_events(spark, sf):
    doc, _ = FO.fold_events(product_topic(spark, sf))
    return _fold_out(doc)


@register("fold_replayed_log", FOLD_SQL, ("pevents_v",))
def q_fold_replayed_log(spark, sf):
    """ST6: the log delivered twice (a full replay with new offsets) folds to
    the same documents once duplicates are dropped by idempotency key."""
    rows = topic_rows(spark, sf)
    replay = B.publish(rows.drop("offset"), rows, TOPIC_ORDER)
    doc, _ = FO.fold_events(V.product_messages(rows.unionByName(replay), "offset"))
    return _fold_out(doc)


@register("fold_dropped_metrics", """
, L AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY "offset" DESC) AS rn
                       FROM pevents_v WHERE event_type IN ('ProductCreated', 'ProductUpdated', 'ProductDeleted'))
        WHERE rn = 1)
SELECT m.product_id, m."offset", m.event_type
FROM pevents_v m LEFT JOIN L ON L.product_id = m.product_id
WHERE m.event_type IN ('ProductViewed', 'ProductPurchased')
  AND (L.product_id IS NULL OR (L.event_type = 'ProductDeleted' AND m."offset" > L."offset"))""", ("pevents_v",))
def q_fold_dropped_metrics(spark, sf):
    _, dropped = FO.fold_events(product_topic(spark, sf))
    return dropped


@register("latest_lifecycle", """
SELECT product_id, event_type, "offset" FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY "offset" DESC) AS rn
  FROM pevents_v WHERE event_type IN ('ProductCreated', 'ProductUpdated', 'ProductDeleted')) WHERE rn = 1""",
          ("pevents_v",))
def q_latest_lifecycle(spark, sf):
    E = FO.parse_events(product_topic(spark, sf))
    L = FO.latest_lifecycle(E)
    return L.select("product_id", F.col("L.event_type").alias("event_type"),
                    F.col("L.offset").alias("offset"))


@register("fold_merge_mode", """
, LC AS (SELECT product_id, max(CASE WHEN event_type = 'ProductDeleted' THEN "offset" END) AS last_del,
               max(CASE WHEN event_type = 'ProductCreated' THEN "offset" END) AS last_cr
        FROM pevents_v WHERE event_type IN ('ProductCreated', 'ProductUpdated', 'ProductDeleted')
        GROUP BY product_id),
FA AS (SELECT e.product_id, min(e."offset") AS first_after FROM pevents_v e JOIN LC ON LC.product_id = e.product_id
       WHERE e.event_type IN ('ProductCreated', 'ProductUpdated', 'ProductDeleted')
         AND e."offset" > coalesce(LC.last_del, -1) GROUP BY e.product_id),
C AS (SELECT LC.product_id, greatest(coalesce(LC.last_cr, -1), coalesce(FA.first_after, -1)) AS c_off
      FROM LC LEFT JOIN FA ON FA.product_id = LC.product_id),
L AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY "offset" DESC) AS rn
                     FROM pevents_v WHERE event_type IN ('ProductCreated', 'ProductUpdated', 'ProductDeleted'))
      WHERE rn = 1),
m AS (SELECT product_id, "offset",
             CASE WHEN event_type = 'ProductViewed' AND event_id % 100 <> 24 THEN
                  CASE WHEN event_id % 50 = 3 THEN 1 ELSE 1 + event_id % 2 END END AS view_inc,
             CASE WHEN event_id % 100 = 24 THEN 100 + event_id % 7 END AS set_to,
             CASE WHEN event_type = 'ProductPurchased' THEN 1 + event_id % 3 END AS buy_inc
      FROM pevents_v WHERE event_type IN ('ProductViewed', 'ProductPurchased')),
live AS (SELECT L.product_id, m."offset", m.view_inc, m.buy_inc, m.set_to,
                max(CASE WHEN m.set_to IS NOT NULL THEN m."offset" END) OVER (PARTITION BY L.product_id) AS set_off
         FROM L LEFT JOIN C ON C.product_id = L.product_id
         LEFT JOIN m ON m.product_id = L.product_id AND m."offset" > coalesce(C.c_off, -1)
         WHERE L.event_type <> 'ProductDeleted')
SELECT product_id,
       CAST(coalesce(max(CASE WHEN "offset" = set_off THEN set_to END), 0)
            + coalesce(sum(CASE WHEN "offset" > coalesce(set_off, -1) THEN view_inc END), 0) AS BIGINT) AS click_count,
       CAST(coalesce(sum(buy_inc), 0) AS BIGINT) AS purchase_count
FROM live GROUP BY product_id""", ("pevents_v",))
def q_fold_merge_mode(spark, sf):
    doc, _ = FO.fold_events(product_topic(spark, sf), mode="merge")
    return doc.select("product_id", F.coalesce("click_count", F.lit(0)).cast("bigint").alias("click_count"),
                      F.coalesce("purchase_count", F.lit(0)).cast("bigint").alias("purchase_count"))


# --- sync against the folded index ---------------------------------------------------
def folded_index(spark, sf):
    doc, _ = FO.fold_events(product_topic(spark, sf))
    return doc


RECONCILE_SQL = FOLD_CTES + """,
idx AS (
  SELECT product_id,
         CASE WHEN created THEN p_name ELSE p_name || ' v' || CAST(event_id AS VARCHAR) END AS name,
         concat_ws(' ', p_type, p_brand, p_name) AS description,
         [p_type, p_brand] AS categories, price,
         upper(substr(p_type, 1, 3)) || '-' || lpad(CAST(product_id AS VARCHAR), 6, '0') AS sku,
         MAP {'brand': p_brand, 'size': CAST(p_size AS VARCHAR)} AS attributes,
         CAST([] AS VARCHAR[]) AS images,
         CASE WHEN created THEN date_trunc('second', ts) END AS created_at,
         date_trunc('second', ts) AS updated_at,
         CAST(click_count AS BIGINT) AS click_count, CAST(purchase_count AS BIGINT) AS purchase_count,
         CASE WHEN any_metric THEN coalesce(last_pop, CAST(coalesce(click_count, 0) AS DOUBLE) * 1.0
                                                     + CAST(coalesce(purchase_count, 0) AS DOUBLE) * 10.0)
              WHEN created THEN CAST(0.0 AS DOUBLE) END AS popularity_score
  FROM d),
act AS (
  SELECT coalesce(p.id, i.product_id) AS id,
         CASE WHEN i.product_id IS NULL THEN 'insert' WHEN p.id IS NULL THEN 'delete'
              WHEN p.name IS DISTINCT FROM i.name OR p.description IS DISTINCT FROM i.description
                OR p.categories IS DISTINCT FROM i.categories OR p.price IS DISTINCT FROM i.price
                OR p.sku IS DISTINCT FROM i.sku
                OR list_sort(map_entries(p.attributes)) IS DISTINCT FROM list_sort(map_entries(i.attributes))
                OR p.images IS DISTINCT FROM i.images OR p.created_at IS DISTINCT FROM i.created_at
                OR p.updated_at IS DISTINCT FROM i.updated_at OR p.click_count IS DISTINCT FROM i.click_count
                OR p.purchase_count IS DISTINCT FROM i.purchase_count
                OR p.popularity_score IS DISTINCT FROM i.popularity_score THEN 'update'
              ELSE 'noop' END AS action
  FROM product_v p FULL OUTER JOIN idx i ON i.product_id = p.id)"""


@register("reconcile_actions", RECONCILE_SQL + """
SELECT id, action FROM act""", ("pevents_v", "product_v"))
def q_reconcile_actions(spark, sf):
    """Source catalogue vs the event-folded index: one action per id."""
    return S.reconcile(V.product(spark, sf), folded_index(spark, sf))


@register("sync_diff", RECONCILE_SQL + """
SELECT id, CASE action WHEN 'insert' THEN 'missing' WHEN 'delete' THEN 'orphaned' ELSE 'differs' END AS kind
FROM act WHERE action <> 'noop'""", ("pevents_v", "product_v"))
def q_sync_diff(spark, sf):
    """SET1: missing / orphaned / differing ids between catalogue and index."""
    return S.sync_diff(V.product(spark, sf), folded_index(spark, sf))


@register("sync_stats", """
, L AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY "offset" DESC) AS rn
                       FROM pevents_v WHERE event_type IN ('ProductCreated', 'ProductUpdated', 'ProductDeleted'))
        WHERE rn = 1)
SELECT (SELECT count(*) FROM part) AS source_count,
       (SELECT count(*) FROM L WHERE event_type <> 'ProductDeleted') AS index_count,
       (SELECT count(*) FROM part) = (SELECT count(*) FROM L WHERE event_type <> 'ProductDeleted') AS in_sync""",
          ("pevents_v",))
def q_sync_stats(spark, sf):
    return S.sync_stats(V.product(spark, sf), folded_index(spark, sf))


# --- topics and delivery ----------------------------------------------------------------
PROGRESS_SQL = f"""
, now AS (SELECT topic, coalesce(min(CASE WHEN processed_at IS NULL THEN "offset" END) - 1, max("offset")) AS "offset",
                 max("offset") AS last_offset, count(*) FILTER (WHERE processed_at IS NULL) AS waiting
          FROM topic_v GROUP BY topic),
ago AS (SELECT topic, coalesce(min(CASE WHEN processed_at IS NULL OR processed_at >= {AS_OF} - INTERVAL 7 DAY THEN "offset" END) - 1,
                               max("offset")) AS "offset" FROM topic_v GROUP BY topic)"""


def progress_week_ago(M):
    """Commit positions as they were at AS_OF - 7 days."""
    cutoff = V.as_of() - F.make_dt_interval(F.lit(7))
    return B.progress(M.withColumn("processed_at", F.when(F.col("processed_at") < cutoff, F.col("processed_at"))))


@register("broker_poll", PROGRESS_SQL + """
SELECT topic, id, "offset" FROM (
  SELECT t.topic, t.id, t."offset", row_number() OVER (PARTITION BY t.topic ORDER BY t."offset") AS r
  FROM topic_v t JOIN ago USING (topic) WHERE t."offset" > ago."offset") WHERE r <= 100""", ("topic_v",))
def q_broker_poll(spark, sf):
    """ST3: the first 100 messages of each topic after last week's commit position."""
    M = topic_log(spark, sf)
    return B.poll(M, progress_week_ago(M), 100).select("topic", "id", "offset")


@register("broker_backlog", PROGRESS_SQL + """
SELECT t.topic, t.id, t."offset" FROM topic_v t JOIN now USING (topic) WHERE (t."offset" > now."offset")""", ("topic_v",))
def q_broker_backlog(spark, sf):
    """ST3 without a bound: every message after its topic's commit position."""
    M = topic_log(spark, sf)
    return B.poll(M, B.progress(M)).select("topic", "id", "offset")


@register("broker_commit", PROGRESS_SQL + """
SELECT topic, greatest(now."offset", ago."offset") AS "offset", last_offset, waiting FROM now JOIN ago USING (topic)""", ("topic_v",))
def q_broker_commit(spark, sf):
    """ST4: last week's commit positions moved on by what has been processed since."""
    M = topic_log(spark, sf)
    now = B.progress(M)
    return B.commit(progress_week_ago(M), now).join(now.drop("offset"), "topic")


@register("broker_stats", """
SELECT topic, count(*) AS messages, count(DISTINCT event_type) AS event_types, max("offset") AS last_offset,
       min("timestamp") AS first_at, max("timestamp") AS last_at FROM topic_v GROUP BY topic""", ("topic_v",))
def q_broker_stats(spark, sf):
    return B.broker_stats(topic_log(spark, sf))


@register("publisher_stats", """
, b AS (SELECT topic, CAST("timestamp" AS DATE) AS day, count(*) AS messages,
               count(*) FILTER (WHERE retry_count > 0) AS failed, max("timestamp") AS last
        FROM topic_v GROUP BY 1, 2)
SELECT topic, CAST(sum(messages) AS BIGINT) AS total_messages, count(*) AS total_batches,
       CAST(sum(failed) AS BIGINT) AS total_failures, sum(messages) / count(*) AS avg_batch_size,
       max(last) AS last_publish FROM b GROUP BY topic""", ("topic_v",))
def q_publisher_stats(spark, sf):
    return B.publisher_stats(topic_log(spark, sf))


CONSUMER_SQL = """
, per AS (SELECT topic, event_type, count(*) AS consumed, count(processed_at) AS processed,
               count(*) FILTER (WHERE retry_count > 0) AS failed,
               count(*) FILTER (WHERE retry_count > 0 AND retry_count < 5) AS retried,
               count(*) FILTER (WHERE retry_count >= 5) AS dead,
               avg(epoch_ms(processed_at) - epoch_ms(created_at)) AS avg_ms_per_message,
               max(processed_at) AS last_processed, max("offset") AS max_offset
        FROM topic_v GROUP BY 1, 2)"""


@register("consumer_stats", CONSUMER_SQL + " SELECT * FROM per", ("topic_v",))
def q_consumer_stats(spark, sf):
    return B.consumer_stats(topic_log(spark, sf))


@register("group_stats", CONSUMER_SQL + """
SELECT topic, count(*) AS event_types, CAST(sum(consumed) AS BIGINT) AS consumed, CAST(sum(failed) AS BIGINT) AS failed,
       CAST(sum(dead) AS BIGINT) AS dead, avg(avg_ms_per_message) AS avg_ms_per_message FROM per GROUP BY 1""",
          ("topic_v",))
def q_group_stats(spark, sf):
    return B.group_stats(B.consumer_stats(topic_log(spark, sf)))


@register("message_ids", """
SELECT id, sha256(concat_ws('|', topic, partition_key, CAST("offset" AS VARCHAR))) AS message_id FROM topic_v""", ("topic_v",))
def q_message_ids(spark, sf):
    """the replay-safe id of every message."""
    return topic_log(spark, sf).select("id", MX.message_id("topic", "partition_key", "offset").alias("message_id"))


@register("corrupt_events", """
SELECT 'msg-' || CAST(event_id AS VARCHAR) AS id, event_type,
       CASE WHEN event_id % 17 = 0 THEN 'cut' ELSE 'no product' END AS kind
FROM pevents_v WHERE event_id % 17 = 0
   OR (event_id % 19 = 0 AND event_type IN ('ProductCreated', 'ProductUpdated', 'ProductDeleted'))""", ("pevents_v",))
def q_corrupt_events(spark, sf):
    """What the error output holds of a topic in which every 17th payload is cut short and every 19th
    has no product id. The payload tells which it was."""
    i = F.col("event_id")
    cut = F.expr("substring(payload, 1, length(payload) - 2)")
    nameless = F.regexp_replace("payload", '"productId":', '"other":')
    M = B.assign_offsets(V.product_events(spark, sf).withColumn(
        "payload", F.when(i % 17 == 0, cut).when(i % 19 == 0, nameless).otherwise(F.col("payload"))), ["timestamp", "event_id"])
    return FO.corrupt_events(M).select("id", "event_type", F.when(F.col("payload").endswith("}"), "no product").otherwise("cut").alias("kind"))


@register("consumer_retry_split", """
SELECT id, CASE WHEN retry_count < 3 THEN 'retry' ELSE 'dead' END AS outcome,
       CASE WHEN retry_count < 3 THEN CAST(retry_count + 1 AS VARCHAR) ELSE CAST(retry_count AS VARCHAR) END AS retry_header,
       CASE WHEN retry_count < 3 THEN CAST(1000 * (1 << retry_count) AS BIGINT) END AS backoff_ms
FROM topic_v WHERE retry_count > 0""", ("topic_v",))
def q_consumer_retry_split(spark, sf):
    M = topic_log(spark, sf)
    failed = (M.filter(F.col("retry_count") > 0)
              .withColumn("headers", F.map_concat("headers", F.create_map(
                  F.lit("retry-count"), F.col("retry_count").cast("string")))))
    out = B.split_retry_dead(failed)
    return out.select("id", "outcome", F.col("headers")["retry-count"].alias("retry_header"),
                      "backoff_ms")


# --- metric roll-ups ---------------------------------------------------------------------
@register("view_counts", "SELECT product_id, count(*) AS total_views FROM views_v GROUP BY 1", ("views_v",))
def q_view_counts(spark, sf):
    return FO.view_counts(V.views(spark, sf))


@register("daily_views", """
SELECT product_id, CAST(ts AS DATE) AS day, count(*) AS views FROM views_v GROUP BY 1, 2""", ("views_v",))
def q_daily_views(spark, sf):
    return FO.daily_views(V.views(spark, sf))


@register("view_stats", """
SELECT count(*) AS total_views, count(DISTINCT product_id) AS products_viewed,
       count(DISTINCT CAST(ts AS DATE)) AS active_days, count(DISTINCT user_id) AS viewers FROM views_v""",
          ("views_v",))
def q_view_stats(spark, sf):
    return FO.view_stats(V.views(spark, sf))


@register("purchase_stats", """
SELECT product_id, CAST(sum(quantity) AS BIGINT) AS quantity,
       CAST(CAST(sum(unit_price * quantity) AS DECIMAL(20,2)) AS DOUBLE) AS revenue,
       count(DISTINCT order_id) AS orders, count(DISTINCT user_id) AS buyers
FROM purchases_v GROUP BY 1""", ("purchases_v",))
def q_purchase_stats(spark, sf):
    s = FO.purchase_stats(V.purchases(spark, sf), V.purchase_parts(spark, sf))
    return s.select("product_id", "quantity", money("revenue").alias("revenue"), "orders", "buyers")


@register("popularity_recompute", """
SELECT id, click_count, purchase_count, round(CAST(click_count AS DOUBLE) * 1.0 + CAST(purchase_count AS DOUBLE) * 10.0, 4) AS popularity_score
FROM product_v""", ("product_v",))
def q_popularity_recompute(spark, sf):
    """A13 (sync model) from the view and purchase tables."""
    P = FO.popularity_from_counters(V.product(spark, sf), V.views(spark, sf),
                                    V.purchases(spark, sf), model="sync")
    return P.select("id", "click_count", "purchase_count",
                    F.round("popularity_score", 4).alias("popularity_score"))


@register("apply_metrics", """
, d AS (SELECT * FROM doc_v),
mv AS (SELECT product_id, count(*) AS c FROM views_v GROUP BY 1)
SELECT d.product_id,
       CASE WHEN mv.product_id IS NOT NULL THEN d.click_count + mv.c ELSE d.click_count END AS click_count,
       CASE WHEN mv.product_id IS NOT NULL THEN CAST(d.click_count + mv.c AS DOUBLE) * 1.0 + CAST(d.purchase_count AS DOUBLE) * 10.0
            ELSE d.popularity_score END AS popularity_score
FROM d LEFT JOIN mv ON mv.product_id = d.product_id""", ("doc_v", "views_v"))
def q_apply_metrics(spark, sf):
    """All views merged into the documents as counter deltas."""
    D = S.full_sync(V.product(spark, sf), V.as_of())
    metrics = V.views(spark, sf).groupBy("product_id").agg(F.count(F.lit(1)).alias("clicks")).select(
        "product_id", "clicks", F.lit(None).cast("bigint").alias("purchases"),
        F.lit(None).cast("double").alias("popularity_set"))
    out, _ = FO.apply_metrics(D, metrics)
    return out.select("product_id", "click_count", "popularity_score")


@register("sync_ids", """
, gone AS (SELECT DISTINCT user_id * 14 + event_id % 14 AS id FROM events WHERE event_type = 'error'),
asked AS (SELECT product_id AS id FROM views_v UNION SELECT id FROM gone)
SELECT id AS product_id, name, click_count FROM product_v WHERE id IN (SELECT id FROM asked) AND id NOT IN (SELECT id FROM gone)""",
          ("product_v", "views_v"))
def q_sync_ids(spark, sf):
    """ST15: targeted resync of the viewed and the deleted products into the event-folded
    index: present in the catalogue -> rebuilt documents, absent -> deleted."""
    P = V.product(spark, sf).join(V.delete_ids(spark, sf).distinct(), "id", "left_anti")
    asked = V.views(spark, sf).select(F.col("product_id").alias("id")).unionByName(V.delete_ids(spark, sf)).distinct()
    new = S.sync_ids(P, folded_index(spark, sf), asked, V.as_of())
    return new.join(asked.withColumnRenamed("id", "product_id"), "product_id", "left_semi").select("product_id", "name", "click_count")
