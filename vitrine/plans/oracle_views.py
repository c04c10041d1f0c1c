"""The canonical views of ``plans.views`` written once more in DuckDB SQL.

``with_views(sql, *names)`` prefixes a query with the CTEs it needs (and their
dependencies), so every oracle starts from the same definitions.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
IMAGE_HOST = "https://img.vitrine.test/p/"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, deps: tuple[str, ...], body: str) -> None:
    VIEWS[name] = (deps, body)


_view("views_v", (), """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id,
       user_id, ts, event_type
FROM events WHERE event_type IN ('view', 'click')""")

_view("purchases_v", (), """
SELECT l.l_partkey AS product_id, l.l_orderkey AS order_id, l.l_linenumber AS line_number,
       o.o_custkey AS user_id, CAST(CAST(l.l_quantity AS BIGINT) AS INTEGER) AS quantity,
       CAST(CAST((CAST(round(l.l_extendedprice * 100) AS BIGINT) // CAST(l.l_quantity AS BIGINT))
                 AS DECIMAL(18,0)) * 0.01 AS DECIMAL(10,2)) AS unit_price,
       o.o_orderdate AS purchased_at
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")

_view("product_v", ("views_v",), f"""
SELECT p.p_partkey AS id, p.p_name AS name,
       concat_ws(' ', p.p_type, p.p_brand, p.p_name) AS description,
       [p.p_type, p.p_brand] AS categories,
       CAST(CAST((CAST(round(p.p_retailprice * 100) AS BIGINT) * p.p_size) // 50 AS DECIMAL(18,0))
            * 0.01 AS DECIMAL(10,2)) AS price,
       upper(substr(p.p_type, 1, 3)) || '-' || lpad(CAST(p.p_partkey AS VARCHAR), 6, '0') AS sku,
       MAP {{'brand': p.p_brand, 'size': CAST(p.p_size AS VARCHAR), 'type': p.p_type}} AS attributes,
       CASE WHEN p.p_partkey % 4 = 0 THEN CAST([] AS VARCHAR[])
            ELSE ['{IMAGE_HOST}' || p.p_partkey || '/1.jpg', '{IMAGE_HOST}' || p.p_partkey || '/2.jpg']
       END AS images,
       {AS_OF} - to_days(CAST(p.p_partkey % 90 AS INTEGER)) AS created_at,
       {AS_OF} - to_days(CAST(p.p_partkey % 90 AS INTEGER))
               + to_hours(CAST(p.p_partkey % 24 AS INTEGER)) AS updated_at,
       p.p_partkey % 3 AS version,
       CAST(coalesce(c.n, 0) AS BIGINT) AS click_count,
       CAST(coalesce(b.q, 0) AS BIGINT) AS purchase_count,
       (CAST(coalesce(c.n, 0) AS BIGINT) * 3 + CAST(coalesce(b.q, 0) AS BIGINT) * 7) / 10.0
           AS popularity_score
FROM part p
LEFT JOIN (SELECT product_id, count(*) AS n FROM views_v GROUP BY product_id) c
       ON c.product_id = p.p_partkey
LEFT JOIN (SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY l_partkey) b
       ON b.l_partkey = p.p_partkey""")

_view("outbox_v", (), f"""
SELECT event_id AS id,
       json_extract_string(props, '$.k') AS aggregate_id,
       CASE event_type WHEN 'view' THEN 'Product' WHEN 'click' THEN 'Product'
            WHEN 'purchase' THEN 'Order' WHEN 'signup' THEN 'User' ELSE 'System' END AS aggregate_type,
       CASE event_type WHEN 'view' THEN 'ProductViewed' WHEN 'click' THEN 'ProductViewed'
            WHEN 'purchase' THEN 'ProductPurchased' WHEN 'signup' THEN 'UserSignedUp'
            WHEN 'error' THEN 'SystemError' ELSE 'Unknown' END AS event_type,
       '{{"productId":' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS VARCHAR)
         || ',"userId":' || CAST(user_id AS VARCHAR)
         || ',"valueCents":' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || '}}' AS event_data,
       ts AS created_at,
       (event_id % 10 < 6) AS processed,
       CASE WHEN event_id % 10 < 6 THEN ts + INTERVAL 1 MINUTE END AS processed_at,
       CAST(CASE event_id % 10 WHEN 7 THEN 2 WHEN 8 THEN 5 WHEN 9 THEN 3 ELSE 0 END AS INTEGER)
           AS retry_count,
       CASE WHEN event_id % 20 = 7 THEN NULL
            WHEN event_id % 10 = 9 THEN {AS_OF} + INTERVAL 1 DAY
            ELSE ts + to_minutes(CAST(1 << (CASE event_id % 10 WHEN 7 THEN 2 WHEN 8 THEN 5
                                                  WHEN 9 THEN 3 ELSE 0 END) AS BIGINT)) END
           AS next_retry_at,
       CASE WHEN event_id % 10 >= 7
            THEN 'delivery failed (attempt ' || CAST(CASE event_id % 10 WHEN 7 THEN 2 WHEN 8 THEN 5
                                                       ELSE 3 END AS VARCHAR) || ')' END
           AS error_message
FROM events""")


_view("doc_v", ("product_v",), f"""
SELECT CAST(id AS VARCHAR) AS id, id AS product_id, name, description, categories, price, sku,
       attributes, images, created_at, updated_at, click_count, purchase_count, popularity_score,
       trim(concat_ws(' ', name, description, sku, array_to_string(categories, ' '),
            array_to_string(list_transform(list_sort(map_keys(attributes)), lambda k: attributes[k]), ' ')))
           AS all_text,
       list_concat(categories, list_filter([
            CASE WHEN price < 100 THEN 'budget' WHEN price > 500 THEN 'premium'
                 WHEN price IS NOT NULL THEN 'mid-range' END,
            CASE WHEN popularity_score IS NOT NULL AND popularity_score > 50 THEN 'popular' END,
            CASE WHEN popularity_score IS NOT NULL AND purchase_count > 100 THEN 'bestseller' END,
            CASE WHEN coalesce(price > 0, false) THEN 'available' END], lambda x: x IS NOT NULL)) AS tags,
       coalesce(price > 0, false) AS in_stock,
       CASE WHEN price IS NULL THEN 'unknown' WHEN price <= 25 THEN '0-25' WHEN price <= 50 THEN '25-50'
            WHEN price <= 100 THEN '50-100' WHEN price <= 250 THEN '100-250'
            WHEN price <= 500 THEN '250-500' ELSE '500+' END AS price_range,
       least(1.0 + coalesce(popularity_score / 100.0 * 0.5, 0.0)
             + CASE WHEN created_at IS NOT NULL AND datesub('day', created_at, {AS_OF}) < 30
                    THEN 0.2 ELSE 0.0 END
             + CASE WHEN coalesce(len(images) > 0, false) THEN 0.1 ELSE 0.0 END, 2.0) AS score_boost
FROM product_v""")


_view("pevents_v", (), """
SELECT e.event_id, e.ts, e.user_id, e.product_id,
       row_number() OVER (ORDER BY e.ts, e.event_id) AS "offset",
       CASE WHEN e.event_id % 10 = 0 THEN 'ProductCreated' WHEN e.event_id % 10 = 1 THEN 'ProductUpdated'
            WHEN e.event_id % 10 = 2 THEN 'ProductDeleted' WHEN e.event_id % 10 <= 7 THEN 'ProductViewed'
            ELSE 'ProductPurchased' END AS event_type,
       p.p_name, p.p_type, p.p_brand, p.p_size,
       (CAST(round(p.p_retailprice * 100) AS BIGINT) * p.p_size) // 50 AS price_cents
FROM (SELECT *, CASE WHEN event_id // 10 % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT)
                     ELSE user_id * 14 + event_id % 14 END AS product_id FROM events) e
JOIN part p ON p.p_partkey = e.product_id""")

_view("topiclog_v", ("outbox_v",), """
SELECT id AS outbox_id, 'outbox-' || CAST(id AS VARCHAR) AS id,
       CASE lower(aggregate_type) WHEN 'product' THEN 'product-events' WHEN 'order' THEN 'order-events'
            WHEN 'user' THEN 'user-events' ELSE 'general-events' END AS topic,
       event_type, created_at AS "timestamp", aggregate_id AS partition_key, retry_count,
       processed_at, created_at
FROM outbox_v""")

_view("topic_v", ("topiclog_v",), """
SELECT *, row_number() OVER (PARTITION BY topic ORDER BY "timestamp", outbox_id) AS "offset"
FROM topiclog_v""")


_view("create_req_v", (), """
SELECT p_partkey AS request_id,
       CASE WHEN p_partkey % 50 = 1 THEN '' WHEN p_partkey % 50 = 11 THEN repeat('x', 300)
            ELSE concat_ws(' ', p_name, p_brand) END AS name,
       concat_ws(' ', p_type, p_name) AS description,
       CASE WHEN p_partkey % 50 = 2 THEN CAST([] AS VARCHAR[]) WHEN p_partkey % 50 = 12 THEN [p_type, ' ']
            ELSE [p_type, p_brand] END AS categories,
       CASE WHEN p_partkey % 50 = 3 THEN CAST(-10 AS DECIMAL(18,4))
            WHEN p_partkey % 50 = 4 THEN CAST(CAST((CAST(round(p_retailprice * 100) AS BIGINT) * p_size) // 50
                                                   AS DECIMAL(18,0)) * 0.01 AS DECIMAL(18,4)) + CAST('0.001' AS DECIMAL(18,4))
            WHEN p_partkey % 50 = 13 THEN CAST(123456789 AS DECIMAL(18,4))
            ELSE CAST(CAST((CAST(round(p_retailprice * 100) AS BIGINT) * p_size) // 50 AS DECIMAL(18,0)) * 0.01
                      AS DECIMAL(18,4)) END AS price,
       CASE WHEN p_partkey % 50 = 5 THEN '' WHEN p_partkey % 50 = 6 THEN lower('NEW-' || lpad(CAST(p_partkey AS VARCHAR), 6, '0'))
            WHEN p_partkey % 50 = 17 THEN 'NEW-' || lpad(CAST(p_partkey - 1 AS VARCHAR), 6, '0')
            WHEN p_partkey % 50 = 8 THEN upper(substr(p_type, 1, 3)) || '-' || lpad(CAST(p_partkey AS VARCHAR), 6, '0')
            ELSE 'NEW-' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') END AS sku,
       MAP {'brand': p_brand, 'color': CASE WHEN p_partkey % 50 = 9 THEN '' ELSE split_part(p_name, ' ', 1) END} AS attributes,
       CASE WHEN p_partkey % 50 = 10 THEN ['ftp://img.vitrine.test/x.jpg']
            ELSE ['https://img.vitrine.test/new/' || CAST(p_partkey AS VARCHAR) || '.jpg'] END AS images
FROM part""")

_view("create_chk_v", ("create_req_v",), r"""
SELECT *, concat_ws(';',
  CASE WHEN len(list_filter(map_entries(attributes), lambda e: e.key IS NULL OR regexp_full_match(e.key, '\s*')
                            OR e.value IS NULL OR regexp_full_match(e.value, '\s*'))) > 0
       THEN 'attributes:must not be blank' END,
  CASE WHEN categories IS NULL OR len(categories) = 0 THEN 'categories:At least one category is required'
       WHEN len(list_filter(categories, lambda x: x IS NULL OR regexp_full_match(x, '\s*'))) > 0
       THEN 'categories:Category name cannot be blank' END,
  CASE WHEN length(description) > 5000 THEN 'description:Product description must not exceed 5000 characters' END,
  CASE WHEN len(list_filter(images, lambda x: NOT coalesce(regexp_matches(x, '^https?://.*'), false))) > 0
       THEN 'images:Image URL must be a valid HTTP/HTTPS URL' END,
  CASE WHEN name IS NULL OR regexp_full_match(name, '\s*') THEN 'name:Product name is required'
       WHEN length(name) > 255 THEN 'name:Product name must not exceed 255 characters' END,
  CASE WHEN price IS NULL THEN 'price:Product price is required'
       WHEN price < 0.01 THEN 'price:Product price must be greater than 0'
       WHEN NOT (price = round(price, 2) AND abs(price) < 100000000)
       THEN 'price:Price must have at most 8 integer digits and 2 decimal places' END,
  CASE WHEN sku IS NULL OR regexp_full_match(sku, '\s*') THEN 'sku:Product SKU is required'
       WHEN length(sku) > 100 THEN 'sku:SKU must not exceed 100 characters'
       WHEN NOT regexp_full_match(sku, '[A-Z0-9_-]+')
       THEN 'sku:SKU must contain only uppercase letters, numbers, hyphens, and underscores' END) AS errors
FROM create_req_v""")

_view("create_ok_v", ("create_chk_v", "product_v"), """
SELECT *, upper(trim(sku)) AS sku_norm,
       (request_id <> min(request_id) OVER (PARTITION BY upper(trim(sku)))
        OR upper(trim(sku)) IN (SELECT sku FROM product_v)) AS duplicate
FROM create_chk_v WHERE errors = ''""")

_view("update_req_v", (), """
SELECT e.event_id AS request_id, e.user_id * 14 + e.event_id % 14 AS id,
       CASE WHEN e.event_id % 3 = 0 THEN concat_ws(' ', 'Renamed', e.user_id * 14 + e.event_id % 14, 'by', e.event_id)
            END AS name,
       CASE WHEN e.event_id % 11 = 0 THEN CAST(-1 AS DECIMAL(18,4))
            WHEN e.event_id % 2 = 0 THEN CAST(CAST((e.event_id % 500) * 100 + 99 AS DECIMAL(18,0)) * 0.01 AS DECIMAL(18,4))
            END AS price,
       CASE WHEN e.event_id % 7 = 0
            THEN upper(substr(p.p_type, 1, 3)) || '-' || lpad(CAST(p.p_partkey AS VARCHAR), 6, '0')
            WHEN e.event_id % 7 = 3 THEN 'MOVED-' || CAST((e.user_id * 14 + e.event_id % 14) % 40 AS VARCHAR) END AS sku,
       CASE WHEN e.event_id % 13 = 0 THEN ['ftp://img'] END AS images
FROM events e LEFT JOIN part p ON p.p_partkey - 1 = e.user_id * 14 + e.event_id % 14
WHERE e.event_type = 'signup'""")


_view("search_req_v", (), """
SELECT e.event_id AS query_id,
       CASE WHEN e.event_id % 11 = 0 THEN '' WHEN e.event_id % 7 = 0 THEN p.p_name
            WHEN e.event_id % 5 = 0 THEN substr(p.w, 1, length(p.w) - 1)
            WHEN e.event_id % 5 = 1 THEN substr(p.w, 1, 1) || substr(p.w, 3, 1) || substr(p.w, 2, 1) || substr(p.w, 4, 100)
            ELSE p.w END AS q,
       CASE WHEN e.event_id % 3 = 0 THEN [p.p_type] END AS categories,
       CASE WHEN e.event_id % 4 = 0 THEN CAST(50 AS DECIMAL(10,2)) END AS min_price,
       CASE WHEN e.event_id % 4 = 0 THEN CAST(500 AS DECIMAL(10,2)) END AS max_price,
       CAST(e.event_id % 3 AS INTEGER) AS page,
       CASE WHEN e.event_id % 2 = 0 THEN 10 ELSE 20 END AS size,
       ['name', 'price', 'createdAt', 'popularityScore', 'rating'][e.event_id % 5 + 1] AS sort_by,
       CASE WHEN e.event_id % 2 = 1 THEN 'asc' ELSE 'desc' END AS sort_direction
FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
      WHERE event_type = 'view') e
JOIN (SELECT p_partkey, p_name, p_type, split_part(p_name, ' ', 1) AS w0, split_part(p_name, ' ', 2) AS w1 FROM part) p0
  ON p0.p_partkey = e.k
CROSS JOIN LATERAL (SELECT p0.p_name, p0.p_type, CASE WHEN e.event_id % 2 = 0 THEN p0.w0 ELSE p0.w1 END AS w) p""")

_view("prefix_req_v", (), """
SELECT e.event_id AS query_id,
       split_part(p.p_name, ' ', 1) || ' ' || substr(split_part(p.p_name, ' ', 2), 1, CAST(e.event_id % 3 + 1 AS INTEGER)) AS q
FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
      WHERE event_type = 'click') e JOIN part p ON p.p_partkey = e.k""")


def _order(names: tuple[str, ...]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in VIEWS[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs for ``names``; extra CTEs may follow in sql
    when it starts with a comma-led continuation (``, x AS (...) SELECT``)."""
    parts = [f"{n} AS ({VIEWS[n][1]}\n)" for n in _order(names)]
    body = sql.lstrip()
    if body.startswith(","):
        return "WITH " + ",\n".join(parts) + "\n" + body
    return "WITH " + ",\n".join(parts) + "\n" + body
