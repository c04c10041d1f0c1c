"""Registered validation and batch-write queries (V1-V6, D1-D5, P4, P6, J5,
J6, S12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import messaging as MX
from vitrine.operators import catalog as C
from vitrine.operators import dml as DM
from vitrine.operators import quality as Q
from vitrine.plans import views as V
from vitrine.plans.registry import money, register
from vitrine.sources import tables as T


def _errors_text(c="errors"):
    return F.array_join(F.array_sort(F.transform(
        F.map_entries(F.col(c)), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))), ";")


@register("validate_create", "SELECT request_id, errors FROM create_chk_v WHERE errors <> ''",
          ("create_chk_v",))
def q_validate_create(spark, sf):
    chk = Q.validate_create(V.create_requests(spark, sf))
    _, bad = Q.split_valid(chk)
    return bad.select("request_id", _errors_text().alias("errors"))


def _create(spark, sf):
    return DM.create_products(V.product(spark, sf), V.create_requests(spark, sf), V.as_of())


REJECTED_SQL = """
SELECT request_id, 'VALIDATION_ERROR' AS code FROM create_chk_v WHERE errors <> ''
UNION ALL SELECT request_id, 'PRODUCT_ALREADY_EXISTS' FROM create_ok_v WHERE duplicate"""


@register("create_rejections", REJECTED_SQL, ("create_ok_v",))
def q_create_rejections(spark, sf):
    """V1/V5: each rejected create request with its code."""
    _, _, rejects = _create(spark, sf)
    return rejects.select("request_id", "code")


@register("rejection_summary", f"SELECT code, count(*) AS rejected FROM ({REJECTED_SQL}) GROUP BY code", ("create_ok_v",))
def q_rejection_summary(spark, sf):
    """V6: rejected create requests by code."""
    _, _, rejects = _create(spark, sf)
    return Q.rejection_summary(rejects)


@register("create_products", """
SELECT (SELECT max(p_partkey) FROM part) + 1 + request_id AS id, sku_norm AS sku, name,
       CAST(CAST(price AS DECIMAL(10,2)) AS DOUBLE) AS price
FROM create_ok_v WHERE NOT duplicate""", ("create_ok_v",))
def q_create_products(spark, sf):
    P = V.product(spark, sf)
    newP, _, _ = DM.create_products(P, V.create_requests(spark, sf), V.as_of())
    return (newP.join(P.select("id"), "id", "left_anti")
            .select("id", "sku", "name", money("price").alias("price")))


@register("create_events", """
SELECT CAST((SELECT max(p_partkey) FROM part) + 1 + request_id AS VARCHAR) AS aggregate_id,
       'ProductCreated' AS event_type, sku_norm AS payload_sku,
       strftime(TIMESTAMP '2024-01-31 00:00:00', '%Y-%m-%dT%H:%M:%S') AS payload_created_at
FROM create_ok_v WHERE NOT duplicate""", ("create_ok_v",))
def q_create_events(spark, sf):
    _, events, _ = _create(spark, sf)
    return events.select("aggregate_id", "event_type",
                         F.get_json_object("event_data", "$.sku").alias("payload_sku"),
                         F.get_json_object("event_data", "$.createdAt").alias("payload_created_at"))


UPDATE_SQL = """
, asked AS (SELECT r.*, upper(trim(r.sku)) AS new_sku, p.id IS NOT NULL AS known,
                   coalesce(r.price <= 0, false)
                   OR len(list_filter(coalesce(r.images, []), lambda x: NOT regexp_matches(x, '^https?://'))) > 0 AS broken
            FROM update_req_v r LEFT JOIN product_v p ON p.id = r.id),
firsts AS (SELECT new_sku, arg_min(id, request_id) AS first_id FROM asked
           WHERE new_sku IS NOT NULL AND known AND NOT broken GROUP BY new_sku),
j AS (SELECT a.*, CASE WHEN broken THEN 'VALIDATION_ERROR' WHEN NOT known THEN 'PRODUCT_NOT_FOUND'
                       WHEN coalesce(q.id, f.first_id) <> a.id THEN 'PRODUCT_ALREADY_EXISTS' END AS code
      FROM asked a LEFT JOIN product_v q ON q.sku = a.new_sku LEFT JOIN firsts f ON f.new_sku = a.new_sku),
step AS (SELECT j.id, j.request_id, j.name AS r_name, j.price AS r_price, j.new_sku AS r_sku,
                coalesce(last_value(j.name IGNORE NULLS) OVER w, p.name) AS name,
                coalesce(last_value(CAST(j.price AS DECIMAL(10,2)) IGNORE NULLS) OVER w, p.price) AS price,
                coalesce(last_value(j.new_sku IGNORE NULLS) OVER w, p.sku) AS sku,
                p.version + row_number() OVER w AS version
         FROM j JOIN product_v p ON p.id = j.id WHERE code IS NULL
         WINDOW w AS (PARTITION BY j.id ORDER BY j.request_id)),
fin AS (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY id ORDER BY request_id DESC) = 1)"""


@register("update_products", UPDATE_SQL + """
SELECT p.id, coalesce(f.name, p.name) AS name, CAST(CAST(coalesce(f.price, p.price) AS DECIMAL(10,2)) AS DOUBLE) AS price,
       coalesce(f.sku, p.sku) AS sku, CAST(coalesce(f.version, p.version) AS BIGINT) AS version,
       round(CASE WHEN f.id IS NULL THEN p.popularity_score
                  ELSE CAST(click_count AS DOUBLE) * 0.3 + CAST(purchase_count AS DOUBLE) * 0.7 END, 4) AS popularity_score
FROM product_v p LEFT JOIN fin f ON f.id = p.id""", ("update_req_v", "product_v"))
def q_update_products(spark, sf):
    """The whole catalogue after the batch."""
    newP, _, _ = DM.update_products(V.product(spark, sf), V.update_requests(spark, sf), V.as_of())
    return newP.select("id", "name", money("price").alias("price"), "sku", "version",
                       F.round("popularity_score", 4).alias("popularity_score"))


@register("update_rejections", UPDATE_SQL + """
SELECT request_id, code FROM j WHERE code IS NOT NULL""", ("update_req_v", "product_v"))
def q_update_rejections(spark, sf):
    _, _, rejects = DM.update_products(V.product(spark, sf), V.update_requests(spark, sf), V.as_of())
    return rejects.select("request_id", "code")


@register("update_events", UPDATE_SQL + """
SELECT 2000000000000000 + request_id AS event_id, CAST(id AS VARCHAR) AS aggregate_id, name, sku,
       CAST(CAST(price AS DECIMAL(10,2)) AS DOUBLE) AS price,
       array_to_string(list_filter([CASE WHEN r_name IS NOT NULL THEN 'name' END,
                                    CASE WHEN r_price IS NOT NULL THEN 'price' END,
                                    CASE WHEN r_sku IS NOT NULL THEN 'sku' END], lambda x: x IS NOT NULL), ',')
           AS changed_fields
FROM step""", ("update_req_v", "product_v"))
def q_update_events(spark, sf):
    """One event per accepted request, with the row as it is after it."""
    _, events, _ = DM.update_products(V.product(spark, sf), V.update_requests(spark, sf), V.as_of())
    field = lambda c: F.get_json_object("event_data", f"$.{c}")
    fields = F.from_json(field("changedFields"), "array<string>")
    return events.select(F.col("id").alias("event_id"), "aggregate_id", field("name").alias("name"),
                         field("sku").alias("sku"), field("price").cast("double").alias("price"),
                         F.array_join(fields, ",").alias("changed_fields"))


DELETE_SQL = """
WITH ids AS (SELECT DISTINCT e.user_id * 14 + e.event_id % 14 AS id FROM events e WHERE e.event_type = 'error')"""


@register("delete_products", DELETE_SQL + """
SELECT 'remaining' AS kind, p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT id FROM ids)
UNION ALL SELECT 'deleted', id FROM ids WHERE id IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'not_found', id FROM ids WHERE id NOT IN (SELECT p_partkey FROM part)""")
def q_delete_products(spark, sf):
    """D3: every product that remains, every deletion event, every id that was not there."""
    newP, events, missing = DM.delete_products(V.product(spark, sf), V.delete_ids(spark, sf), V.as_of())
    rows = lambda kind, df, c: df.select(F.lit(kind).alias("kind"), F.col(c).cast("bigint").alias("id"))
    return (rows("remaining", newP, "id").unionByName(rows("deleted", events, "aggregate_id"))
            .unionByName(rows("not_found", missing, "detail")))


@register("record_purchases", """
SELECT id, purchase_count,
       round(CAST(click_count AS DOUBLE) * 0.3 + CAST(purchase_count AS DOUBLE) * 0.7, 4) AS popularity_score
FROM product_v""", ("product_v",))
def q_record_purchases(spark, sf):
    P0 = V.product(spark, sf).withColumn("purchase_count", F.lit(0).cast("bigint"))
    newP, _, _ = DM.record_purchases(P0, V.purchases(spark, sf), V.as_of())
    return newP.select("id", "purchase_count", F.round("popularity_score", 4).alias("popularity_score"))


@register("purchase_events", """
SELECT CAST(product_id AS VARCHAR) AS aggregate_id, 'Product' AS aggregate_type, 'product-events' AS topic, p.sku,
       CAST(u.quantity AS INTEGER) AS quantity,
       CAST(CAST(unit_price * quantity AS DECIMAL(18,2)) AS DOUBLE) AS total_price
FROM purchases_v u JOIN product_v p ON p.id = u.product_id""", ("purchases_v", "product_v"))
def q_purchase_events(spark, sf):
    _, events, _ = DM.record_purchases(V.product(spark, sf), V.purchases(spark, sf), V.as_of())
    field = lambda c: F.get_json_object("event_data", f"$.{c}")
    return events.select("aggregate_id", "aggregate_type", MX.topic_for("aggregate_type").alias("topic"),
                         field("sku").alias("sku"), field("quantity").cast("int").alias("quantity"),
                         F.get_json_object("event_data", "$.totalPrice")
                         .cast("decimal(18,2)").cast("double").alias("total_price"))


@register("purchase_rejections", """
SELECT product_id, order_id, line_number FROM purchases_v
WHERE product_id NOT IN (SELECT id FROM product_v WHERE id % 10 <> 3)""", ("purchases_v", "product_v"))
def q_purchase_rejections(spark, sf):
    """Purchases of products that are gone (here those whose id ends in 3) are rejected."""
    P = V.product(spark, sf).filter("id % 10 <> 3")
    _, _, rejected = DM.record_purchases(P, V.purchases(spark, sf), V.as_of())
    return rejected.select("product_id", "order_id", "line_number")


@register("increment_clicks", "SELECT id, click_count FROM product_v", ("product_v",))
def q_increment_clicks(spark, sf):
    P0 = V.product(spark, sf).withColumn("click_count", F.lit(0).cast("bigint"))
    ids = V.views(spark, sf).select(F.col("product_id").alias("id"))
    return DM.increment(P0, ids, "click_count").select("id", "click_count")


@register("exists_by_sku", """
SELECT DISTINCT upper(trim(sku)) AS sku FROM create_req_v WHERE upper(trim(sku)) IN (SELECT sku FROM product_v)""",
          ("create_req_v", "product_v"))
def q_exists_by_sku(spark, sf):
    keys = V.create_requests(spark, sf).select(F.trim(F.upper("sku")).alias("sku")).distinct()
    return C.exists_by_sku(keys, V.product(spark, sf))


@register("lookup_by_sku", """
SELECT id, sku, name FROM product_v WHERE sku IN (SELECT upper(trim(sku)) FROM create_req_v)""",
          ("create_req_v", "product_v"))
def q_lookup_by_sku(spark, sf):
    keys = V.create_requests(spark, sf).select(F.trim(F.upper("sku")).alias("sku"))
    return C.lookup_by_sku(V.product(spark, sf), keys).select("id", "sku", "name")


@register("missing_ids", """
SELECT DISTINCT id FROM update_req_v WHERE id NOT IN (SELECT p_partkey FROM part)""", ("update_req_v",))
def q_missing_ids(spark, sf):
    keys = V.update_requests(spark, sf).select("id").distinct()
    return C.missing_ids(keys, V.product(spark, sf))


@register("insert_ignore", """
SELECT sku, count(*) AS n FROM (
  SELECT sku FROM product_v
  UNION ALL SELECT sku_norm FROM (SELECT sku_norm, request_id,
                                         min(request_id) OVER (PARTITION BY sku_norm) AS first_id
                                  FROM create_ok_v WHERE sku_norm NOT IN (SELECT sku FROM product_v))
            WHERE request_id = first_id) GROUP BY sku""", ("create_ok_v", "product_v"))
def q_insert_ignore(spark, sf):
    """Seed rows with insert-if-absent on SKU (first request per SKU)."""
    P = V.product(spark, sf)
    ok, _ = Q.split_valid(Q.validate_create(V.create_requests(spark, sf)))
    rows = DM.from_create(ok)
    first = rows.groupBy("sku").agg(F.min("request_id").alias("request_id"))
    seeds = rows.join(first, ["sku", "request_id"]).select(P.select("sku").columns)
    merged = T.insert_ignore(P.select("sku"), seeds, "sku")
    return merged.groupBy("sku").agg(F.count(F.lit(1)).alias("n"))


@register("validate_queries", """
SELECT event_id AS query_id,
       coalesce((event_id % 7 - 1) >= 0 AND event_id % 120 >= 1 AND event_id % 120 <= 100, false) AS valid
FROM events WHERE event_type = 'click'""")
def q_validate_queries(spark, sf):
    """V4 over a batch of search requests (one per click event)."""
    e = T.table(spark, sf, "events").filter(F.col("event_type") == "click")
    reqs = e.select(F.col("event_id").alias("query_id"),
                    (F.col("event_id") % 7 - 1).cast("int").alias("page"),
                    (F.col("event_id") % 120).cast("int").alias("size"))
    return Q.validate_queries(reqs).select("query_id", "valid")
